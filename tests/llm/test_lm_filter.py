"""The score of the language model against a plain computation from exact counts, and what its filter may get wrong."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import lm_score

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(120)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [""]


def least(c):
    """The least count of the band that holds c: bands begin at powers of the root of two."""
    return math.ceil(2 ** ((math.floor(2 * math.log2(c) + 1e-9)) / 2)) if c else 0


def most(c):
    return max(least(c), math.ceil(2 ** ((math.floor(2 * math.log2(c) + 1e-9) + 1) / 2)) - 1) if c else 0


def texts():
    g = np.random.default_rng(8)
    own = [" ".join(g.choice(WORDS, 40, p=np.arange(1, 121)[::-1] / 7260)) for _ in range(60)]
    return [None, "", "one", "É Ü", "x" * 5000, *own, own[0], own[0], "never seen at all", own[1].upper()]


def scores(spark, rows, held, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in lm_score.score(docs, held, block_bytes=1500, **more).collect()}


def test_score_is_that_of_exact_counts_in_bands(spark):
    rows = list(enumerate(texts()))
    one, two = Counter(), Counter()
    for k, text in rows:
        if k % 4:
            t = tokens_of(text)
            one.update(t)
            two.update(zip(t, t[1:]))
    mass, v = sum(map(least, one.values())), len(one)

    def p(w, before):
        plain = (least(one[w]) + 0.1) / (mass + 0.1 * (v + 1))
        return 0.75 * plain + 0.25 * least(two[before, w]) / most(one[before]) if one[before] else plain

    got = scores(spark, rows, F.col("doc_id") % 4 == 0)
    off = []
    for k, text in rows:
        t = tokens_of(text)
        want = sum(math.log10(p(w, before)) for before, w in zip([None, *t], t))
        off.append(abs(got[k].score - want) / len(t))
    # a word that the filter reads too high moves M, and so all texts alike, a little; a pair read too high moves few texts
    assert np.mean(np.array(off) < 1e-3) > 0.7 and np.mean(off) < 0.01
    # probabilities of what follows a known word add up to one at most
    for before in ("", *WORDS[:20]):
        assert sum(p(w, before) for w in one) <= 1 + 1e-9


def test_a_filter_that_is_not_broadcast_gives_the_same_scores(spark):
    rows = list(enumerate(texts()))
    held = F.col("doc_id") % 4 == 0
    want = scores(spark, rows, held)
    for filter_bytes in (0, 2500):  # none is broadcast; that of words alone is
        assert scores(spark, rows, held, filter_bytes=filter_bytes) == want


@pytest.mark.parametrize("filter_bytes", [0, lm_score.FILTER_BYTES])
def test_empty_tables_and_nothing_to_learn(spark, filter_bytes):
    assert scores(spark, [], F.lit(False), filter_bytes=filter_bytes) == {}
    got = scores(spark, [(1, "a b"), (2, None)], F.lit(True), filter_bytes=filter_bytes)
    assert {k: (r.score, r.base_score, r.n_known, r.train_tokens) for k, r in got.items()} == {1: (0, 0, 0, 0), 2: (0, 0, 0, 0)}


def test_low_counts_of_parts_never_pass_the_high_count_of_their_sum():
    g = np.random.default_rng(3)
    level = lm_score.levels_for(np.arange(1, 100_000))
    assert (lm_score.low(level) <= np.arange(1, 100_000)).all() and (lm_score.high(level) >= np.arange(1, 100_000)).all()
    assert lm_score.low(level[:3]).tolist() == lm_score.high(level[:3]).tolist() == [1, 2, 3]
    for _ in range(200):
        parts = g.integers(1, g.integers(2, 900), g.integers(1, 60))
        assert lm_score.low(lm_score.levels_for(parts)).sum() <= lm_score.high(lm_score.levels_for(parts.sum()[None]))[0]


def test_pair_hashes_meet_rarely():
    g = np.random.default_rng(4)
    hashes = g.integers(0, 1 << 63, 40_000).astype(np.uint64)
    letters = 6 * len(hashes)
    bits = np.uint64(64 - (letters.bit_length() + lm_score.PAIR_BITS))
    known = np.unique(lm_score.pair_hash(hashes[:-1], hashes[1:]) >> bits)
    other = lm_score.pair_hash(hashes[1:], hashes[:-1]) >> bits
    assert np.isin(other, known).mean() < 2.0**-lm_score.PAIR_BITS


def test_a_segment_reads_as_when_it_was_made():
    g = np.random.default_rng(6)
    hashes, levels = g.integers(0, 1 << 63, 5000).astype(np.uint64), g.integers(1, 7, 5000)
    made = lm_score.Levels(hashes, levels)
    row = made.row("pair", 0)
    asked = np.concatenate([hashes, g.integers(0, 1 << 63, 5000).astype(np.uint64)])
    assert (lm_score.Segment(row["size"], row["top"], row["bits"]).read(asked) == made.read(asked)).all()


def test_segments_hold_what_is_asked_of_them_once(spark):
    """What blocks ask lies beside the segment, each item once, and is not exchanged a second time."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "id long, text string").withColumn("held", F.lit(False))
    packed = lm_score.pack(docs.select("id", "held", "text").repartition(4), 1500)
    pairs = lm_score.pair_segments(packed, 60, 8)
    lists = lm_score.pair_lists(packed, 60, 8).collect()
    want = {(r.block, r.bucket): lm_score.risen(r.steps).tolist() for r in lists}
    for r in pairs.collect():
        asked = lm_score.risen(r.asked)
        assert (np.diff(asked.astype(np.int64)) > 0).all()
        for block, own in zip(r.blocks, r.own, strict=True):
            assert asked[lm_score.risen(own).astype(np.int64)].tolist() == want[block, r.bucket]
    assert "Exchange" not in lm_score.probed(pairs)._jdf.queryExecution().toString()


def test_base_scores_are_those_of_the_whole_job(spark, monkeypatch):
    """They need no pairs and no filter."""
    rows = list(enumerate(texts()))
    held = F.col("doc_id") % 4 == 0
    want = {k: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for k, r in scores(spark, rows, held).items()}
    for unused in ("pair_segments", "probed"):
        monkeypatch.setattr(lm_score, unused, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.base_score(docs, held, block_bytes=1500).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
