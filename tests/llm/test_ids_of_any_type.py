"""Line dedup and near-dedup with ids that are no whole numbers, against a plain computation and against whole numbers."""

import datetime
import re
import string
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import line_dedup, near_dedup
from tidewire.llm.common import numbered

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(seed, n):
    return ["w%d" % x for x in np.random.default_rng(seed).integers(0, 5000, n)]


def documents():
    """(id, text): groups of near copies under mixed ids, nulls, blanks, one word, repeated rows."""
    rows = [("Z", None), ("a", ""), ("b", " \n"), ("c", "One"), ("é", "one"), ("", "alone here"), (None, "alone here"), ("10", "same row of words"), ("10", "same row of words"), ("9", "SAME row of words")]
    g = np.random.default_rng(7)
    for group in range(5):
        base = words_of(group, 120)
        for k in range(6):
            text = list(base)
            for i in g.choice(120, k, replace=False):
                text[i] = "e%d" % g.integers(10**6)
            rows.append((f"{'zyxwv'[k % 5]}-{group}-{k}", " ".join(text)))
    return rows


def shingle_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_near_duplicates_of_text_ids_like_all_pairs(spark):
    rows = documents()
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    least = {d: d for d in sets}
    links = [(a, b) for a, b in combinations(sorted(sets, key=str.encode), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 20
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b], key=str.encode)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, number int, key int")
    got = near_dedup.near_duplicates(docs, size=4).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted((d, len(sets[d]), least[d], least[d] == d) for d, _ in rows if d is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_dedup.keep_one(docs, size=4)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or "-") for r in kept.collect()) == sorted((d or "-") for d, _ in rows if d is None or least[d] == d)
    assert near_dedup.near_duplicates(docs.limit(0), size=4).count() == near_dedup.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "date", "double"])
def test_line_dedup_gives_the_same_under_other_ids(spark, kind):
    passage = " ".join(words_of(99, 80)) + "."
    rows = [(k, f"{' '.join(words_of(200 + k, 50))} {passage}\n{' '.join(words_of(300 + k, 40))}") for k in (3, 1, 2, 0)] + [(4, None), (5, ""), (6, " "), (None, passage), (2, passage)]
    day = datetime.date(2020, 1, 1)
    other = {"string": lambda k: f"id{k}", "date": lambda k: day + datetime.timedelta(k), "double": lambda k: k + 0.5}[kind]
    whole = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    docs = spark.createDataFrame([(None if k is None else other(k), t, "x") for k, t in rows], f"doc_id {kind}, text string, n_words string")
    shown = lambda df, name: sorted((str(name(r.doc_id)), r.text or "-", r.n_words, r.n_removed_words, r.n_removed_chunks) for r in df.collect())
    expect = shown(line_dedup.dedup_lines(whole), lambda k: None if k is None else other(k))
    assert shown(line_dedup.dedup_lines(docs), lambda x: x) == expect and any(r[3] > 50 for r in expect)
    clean = line_dedup.without_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == line_dedup.without_repeats(whole).count() and {r.n_words for r in clean.collect()} == {"x"}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_numbers_rise_with_the_keys(spark):
    keys = [f"k{k}" for k in range(3000)] + [None, "", "k1"]
    got = numbered(spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)).orderBy("number").collect()
    assert [r.number for r in got] == list(range(3001)) and [r.key for r in got] == sorted({k for k in keys if k is not None})
    assert numbered(spark.range(0).select(F.col("id").cast("string").alias("key"))).count() == 0
