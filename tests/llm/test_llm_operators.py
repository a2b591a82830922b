import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewire.llm import byte_bpe, chat_format, common, decontaminate, html_text, line_dedup, lm_score, near_dedup, quality_rules, toxicity, url_filters

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é ü 😀"), (6, "same text here"), (6, "same text here"), (7, "x" * 30000), (8, prose(6000, 1))]


def frame(spark, rows=ODD):
    """Documents with a column whose name an operator uses itself."""
    return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_words string")


def empty(spark):
    return frame(spark).limit(0)


def test_html_rules(spark):
    page = "<header><a href=/>Home</a></header><article><h1>T &amp; U</h1><p>It is the story of a town that was by the sea and all of the people in it, as they say.<p>Short.</article><div class=comments><p>I am a reader and this is what I think of it all, and so on and on and on for you.</div>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_main_text(rows).collect()}
    assert got[1].text.split("\n\n")[0] == "T & U" and got[1].text.endswith("Short.") and "reader" not in got[1].text
    assert (got[2].text, got[3].n_chars) == ("", 0)
    assert html_text.extract_main_text(rows.limit(0)).count() == 0


PROSE = "It is the story of a town that was by the sea and all of the people in it, as they say, for it was old."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{PROSE}<button>go<p>Second: {PROSE}</article>", [PROSE + "go", "Second: " + PROSE]),
        (f"<div><button>Buy</button><p>{PROSE}</div><select><option>a</select>", [PROSE]),
        (f"<title>t<p>{PROSE}<svg><text>x</text></svg>", [PROSE]),
        (f'<div class="side-effects"><h2>Effects</h2><p>{PROSE}</div>', ["Effects", PROSE]),
        (f'<div class="post-content top"><p>{PROSE}</div><div class="footer"><p>{PROSE}</div>', [PROSE]),
        (f'<p>{PROSE}</p><div class="user-comments"><p>{PROSE}</div><ul class="top-bar"><li><a href=x>Home</a><li><a href=y>News</a></ul>', [PROSE]),
        (f'<p>{PROSE}</p><div class="notice"><p>{PROSE}</div><div class="share-box">Share: <a href=x>this one</a></div>', [PROSE]),
        (f"<p>{PROSE}</p><!-- <p>{PROSE}</p>", [PROSE]),
        ("<p>" + "<button>" * 3000 + PROSE, [PROSE]),
    ],
)
def test_html_probes(page, want):
    """Pages with the text that a reader would take from them by hand."""
    assert [x.replace("t ", "", 1) if x.startswith("t ") else x for x in html_text.main_text(page).split("\n\n") if x != "t"] == want


def test_lm_base_scores_are_exact(spark):
    rows = frame(spark, ODD + [(20 + k, prose(60, k % 5)) for k in range(30)] + [(50 + k, f"É Caps CAPS {WORDS[k].upper()} \u00c4b\u00a0c") for k in range(9)])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens_of = lambda text: re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)) + [""]
    got = lm_score.score(rows, F.col("doc_id") % 3 == 0, block_bytes=3000).collect()
    assert len(got) == rows.count()
    count, texts = Counter(), {r.doc_id: r.text for r in rows.collect()}
    for r in rows.collect():
        if r.doc_id % 3:
            count.update(tokens_of(r.text))
    n, v = sum(count.values()), len(count)
    for r in got:
        tokens = tokens_of(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
        assert r.score <= 0
    held = [r for r in got if r.held_out and r.n_tokens > 50 and 20 <= r.doc_id < 50]
    assert all(r.score > r.base_score for r in held)
    assert lm_score.score(empty(spark), F.lit(True)).count() == 0


def test_lm_reads_only_its_columns_and_keeps_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "y"), (1, "a b", "y"), (2**60 + 1, None, None)], "doc_id long, text string, held_ string")
    rows = rows.withColumns({c: F.lit(7) for c in ("id", "held", "block", "bucket", "n_tokens", "score")})
    got = lm_score.score(rows, F.col("doc_id") == 1).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens) for r in got) == [(0, False, 3), (1, True, 3), (1, True, 3), (2**60 + 1, False, 1)]
    text_ids = lm_score.score(rows.select(F.lit("k").alias("doc_id"), "text"), F.lit(False)).collect()
    assert [r.doc_id for r in text_ids] == ["k"] * 4


def test_packed_numbers_come_back():
    for x in ([], [0], [255, 0, 256], [1 << 63, 5], list(range(3000))):
        assert common.unsqueeze(common.squeeze(np.array(x, np.uint64))).tolist() == x


def test_lm_knows_a_pair_met_once(spark):
    score = lambda text: lm_score.score(frame(spark, [(0, "zig zag"), (1, text), (2, prose(50, 4))]), F.col("doc_id") == 0).filter("doc_id = 0").first().score
    assert score("zig zag") > score("zag zig") + 0.1


@pytest.mark.parametrize("n", [1000, 400_000])
def test_lm_filter_grows_with_its_items(n):
    g = np.random.default_rng(n)
    hashes, levels = g.integers(0, 1 << 63, n).astype(np.uint64), g.integers(1, 6, n)
    filter_ = lm_score.Levels(hashes, levels)
    assert (filter_.read(hashes) >= levels).all() and (filter_.read(hashes) != levels).mean() < 0.01
    assert (filter_.read(g.integers(0, 1 << 63, n).astype(np.uint64)) > 0).mean() < 0.01
    filter_.bits[:] = True
    assert filter_.read(hashes).max() == levels.max()


def test_repeated_passage_goes_and_the_rest_stays(spark):
    passage = prose(80, 99) + "."
    rows = [(k, f"{prose(50, 200 + k)} {passage}\n{prose(40, 300 + k)}") for k in range(6)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1]
    for k in range(1, 6):
        assert passage[40:300] not in got[k].text and got[k].n_removed_words >= 50
        assert got[k].text.startswith(prose(50, 200 + k)[:200]) and got[k].text.endswith(prose(40, 300 + k)[-150:])
    same = line_dedup.dedup_lines(frame(spark)).collect()
    assert Counter(r.text for r in same) == Counter(t for _, t in ODD)
    assert line_dedup.without_repeats(empty(spark)).count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    passage = prose(80, 99)
    rows = spark.createDataFrame([(k, f"{prose(50, 200 + k)} {passage}") for k in range(3)] + [(None, passage), (9, None)], "doc_id long, text string")
    rows = rows.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))) for c in ("id", "row", "key", "k", "gone", "least", "n_words", "column_0", "kept_0", "places")})
    got = line_dedup.dedup_lines(rows).collect()
    assert all(r.id == f"id{-1 if r.doc_id is None else r.doc_id}" and r.gone[:4] == "gone" and r.kept_0[:6] == "kept_0" and r.places for r in got)
    assert {r.doc_id: r.n_removed_words > 50 for r in got} == {0: False, 1: True, 2: True, None: True, 9: False}
    kept = line_dedup.without_repeats(rows)
    assert kept.columns == rows.columns and all(r.n_words == f"n_words{r.doc_id}" for r in kept.collect() if r.doc_id is not None)


def plain_chunks(text):
    """The chunks of one text alone: bytes, words, lines; what is repeated and goes is decided by brute force."""
    found = line_dedup.Chunks([text])
    return [(text[a:b], n, m) for a, b, n, m in zip(found.start.tolist(), found.end.tolist(), found.words.tolist(), found.lines.tolist(), strict=True)]


def test_line_dedup_like_brute_force(spark):
    g = np.random.default_rng(5)
    passages = [prose(int(n), 700 + k) for k, n in enumerate(g.integers(20, 90, 12))]
    rows = []
    for k in range(60):
        parts = [prose(int(g.integers(5, 60)), 3000 + k)]
        for j in g.choice(12, int(g.integers(0, 4)), replace=False):
            parts += [passages[j], prose(int(g.integers(3, 40)), 4000 + 20 * k + int(j))]
        rows.append((k, ("\n" if k % 3 else " ").join(parts)))
    rows += [(70, rows[5][1]), (5, rows[5][1]), (71, "  " + passages[0] + "\n\n"), (72, "Üß " + passages[1])]
    owners = {}
    for d, t in rows:
        for chunk, _, _ in plain_chunks(t.encode()):
            owners.setdefault(chunk, set()).add(d)

    def runs(marks, chunks):
        out, k = [False] * len(marks), 0
        while k < len(marks):
            e = k
            while e < len(marks) and marks[e]:
                e += 1
            if e > k and sum(c[1] for c in chunks[k:e]) >= line_dedup.MIN_WORDS and sum(c[2] for c in chunks[k:e]) >= line_dedup.MIN_LINES:
                out[k:e] = [True] * (e - k)
            k = max(e, k + 1)
        return out

    proposed = {}  # a chunk counts where it lies in a run of chunks that several documents have
    for d, t in rows:
        chunks = plain_chunks(t.encode())
        for (chunk, _, _), on in zip(chunks, runs([len(owners[c[0]]) > 1 for c in chunks], chunks), strict=True):
            if on:
                proposed.setdefault(chunk, set()).add(d)
    want = []
    for d, t in rows:
        chunks = plain_chunks(t.encode())
        gone = runs([len(owners[c[0]]) > 1 and d > min(proposed.get(c[0], {d})) for c in chunks], chunks)
        want.append((d, sum(c[1] for c in chunks), sum(c[1] for c, x in zip(chunks, gone, strict=True) if x), b"".join(x for c, y in zip(chunks, gone, strict=True) if not y for x in c[0].split())))
    got = [(r.doc_id, r.n_words, r.n_removed_words, b"".join(r.text.encode().split())) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 1000


def test_passages_of_few_words_and_of_51_words_go(spark):
    missed = []
    for g, passage in enumerate(["spam " * 60, "buy " * 60, "to me " * 30, "one two three " * 20, "it is so " * 20, *(prose(51, 5000 + k) for k in range(400))]):
        texts = [f"{prose(40 + k, 7 * g + k)} {passage.strip()} {prose(45, 9 * g + k + 3)}".encode() for k in range(2)]
        c = line_dedup.Chunks(texts)
        first = set(c.hash[c.doc == 0].tolist())
        marked = c.runs(np.array([d == 1 and h in first for d, h in zip(c.doc.tolist(), c.hash.tolist())]), line_dedup.MIN_WORDS, line_dedup.MIN_LINES)
        if c.words[marked].sum() < 14:
            missed.append(g)
    assert len(missed) <= 1 and not any(g < 5 for g in missed)


def contamination(doc, items, size=13):
    words, hit, met = decontaminate.words_of(doc.encode()), set(), set()
    for name, text in items:
        w = decontaminate.words_of(text.encode())
        k = min(size, len(w))
        wanted = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1 if w else 0):
            if tuple(words[i : i + k]) in wanted:
                hit |= set(range(i, i + k))
                met.add(name)
    return len(words), len(hit), met


@pytest.mark.parametrize("part_words", [2_000_000, 10])
def test_decontamination_like_brute_force(spark, part_words):
    items = [(1, prose(20, 1)), (2, prose(13, 2)), (3, "abc, DEF!"), (4, ""), (5, None), (6, prose(20, 1))]
    docs = [(10, prose(30, 7) + " " + items[0][1] + " " + prose(5, 8)), (11, "x abc def y " + items[1][1]), (12, prose(100, 9)), (13, None), (14, ""), (14, "ABC-def")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(frame(spark, docs), bench, part_words=part_words).collect()
    want = sorted((d, *contamination(t or "", [(i, x or "") for i, x in items])) for d, t in docs)
    assert sorted((r.doc_id, r.n_words, r.n_hit, set(r["items"])) for r in got) == want
    assert sorted(r.doc_id for r in decontaminate.remove_documents(frame(spark, docs), bench).collect()) == [12, 13, 14]
    assert not any("abc def" in (r.text or "").lower() for r in decontaminate.remove_spans(frame(spark, docs), bench).collect())
    assert decontaminate.find_contamination(frame(spark, docs), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_toxicity_on_held_out_texts(spark):
    bad = ["slorp", "slorpen", "grumbok", "slorpish"]
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        text = prose(90, 500 + k).split()
        for j in range(3 if toxic else 0):
            text.insert(20 + 11 * j, bad[(k + j) % 4])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(frame(spark, rows), table, F.col("id") % 3 != 1)
    got = toxicity.score_toxicity(frame(spark, rows), net).collect()
    right = [(r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got if r.doc_id % 3 == 1]
    assert sum(right) / len(right) >= 0.95
    assert len(toxicity.score_toxicity(frame(spark), net).collect()) == len(ODD)
    none = toxicity.train(frame(spark, rows), table.limit(0), F.lit(True))
    assert toxicity.score_toxicity(frame(spark), none).agg(F.max("score")).first()[0] < 0.7


def test_toxicity_scores_like_the_trained_network():
    net = toxicity.Network()
    words = [f"w{k}".encode() for k in range(50)]
    gates, ids = net.gates(net.inputs(words)), np.random.default_rng(1).integers(0, 50, (900, 32)).astype(np.int32)
    ids[:40, 20:] = -1
    ids[7] = -1
    want = toxicity.sigmoid(net.pool(net.run(gates, ids), ids.T >= 0)[2])
    assert np.abs(net.chances(net.columns(gates), ids) - want).max() < 1e-5


def test_toxicity_meets_a_passage_at_any_place():
    assert toxicity.STRIDE <= toxicity.WINDOW // 2
    net = toxicity.Network()
    net.chances = lambda gates, ids: np.where((ids == rows[b"end"]).any(axis=1) & (ids == rows[b"start"]).any(axis=1), 0.9, 0.3)
    for at in range(60):
        words = [f"w{k}".encode() for k in range(140)]
        words[at], words[at + 31] = b"start", b"end"
        scorer = toxicity.Scorer(net)
        rows = scorer.rows
        assert scorer.score([b" ".join(words)])[0] == 0.9


def test_toxicity_reads_long_words_whole():
    assert toxicity.inputs_of("one\u00a0slorp\u2014two caf\u00e9".encode(), toxicity.Pieces()) == [b"one", b"slorp", b"two", "caf\u00e9".encode()]
    net, text = toxicity.Network(), "\u4f60\u597d\u4e16\u754c" * 20
    for long_ in (text, "x" * 90):
        parts = toxicity.inputs_of((long_ + "slorp").encode(), toxicity.Pieces())
        assert all(len(x) <= 40 for x in parts) and parts[-1].endswith(b"slorp") and parts[0] == long_.encode()[:40]
        assert all(a[-12:] == b[:12] for a, b in zip(parts, parts[1:], strict=False))
    scores = toxicity.Scorer(net).score([("x" * 90 + w).encode() for w in ("slorp", "clean")])
    assert scores[0] != scores[1] and len(toxicity.gram_cells([b"x" * 90])[0]) > 2 * 80


def test_bpe_like_the_library(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = ODD + [(30, "A" * 900 + " don't 123\n\n  x"), (31, "你好世界 " * 50), (32, "=-" * 400 + "<|endoftext|>")]
    for r in byte_bpe.encode_decode(frame(spark, rows), path, P.PATTERN, keep=("doc_id", "text")).collect():
        ids = own.encode_ordinary(r.text or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids) and bytes(r.ids_raw) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.decoded).decode() == (r.text or "")


def test_url_rules_and_model(spark):
    urls = [(1, "http://A.Net/x"), (2, "https://w.example.net/en/1?a"), (3, "http://example.com/de/2"), (4, "http://x.org/fr/"), (5, "http://x.net"), (6, None), (7, "no scheme"), (8, "http://new.net.invalid/de/3")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    table = spark.createDataFrame([(f"h{k}.net", f"/a{k}", 1) for k in range(30)] + [(f"h{k}.org", f"/fr/{k}", 0) for k in range(30)], "host string, path string, blocked int")
    got = {r.page_id: r for r in url_filters.filter_urls(pages, table).collect()}
    assert [(got[k].rule, got[k].verdict) for k in (1, 2, 3, 4)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("x.net", "", None, "block")
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "")
    assert url_filters.filter_urls(pages, table.limit(0)).filter("verdict is null").count() == 0


def test_near_duplicates_like_all_pairs(spark):
    rng, rows = np.random.default_rng(3), list(ODD)
    for g in range(6):
        base = prose(150, 800 + g).split()
        for k in range(14):
            text = list(base)
            for i in rng.choice(150, k % 7, replace=False):
                text[i] = "edit%d" % rng.integers(1e6)
            rows.append((100 * (g + 1) + k, " ".join(text)))
    hashes = near_dedup.WordHashes()
    sets = {d: near_dedup.shingles((t or "").encode(), 5, hashes) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a]) and len(sets[b]):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all((r.component_id, r.n_shingles, r.kept) == (find(r.doc_id), len(sets[r.doc_id]), find(r.doc_id) == r.doc_id) for r in got)


def test_chat_events_fold_and_read_back(spark):
    log = [
        (1, 1, 1, "delta", "user", "hi "), (1, 2, 1, "delta", "user", "the\\re <|im_end|>"), (1, 3, 2, "delta", "assistant", "wrong"), (1, 4, 2, "regenerate", None, ""),
        (1, 5, 2, "delta", None, "right"), (1, 6, 1, "edit", None, "hello <|x|>\n"), (1, 7, 1, "delta", None, "!"), (2, 1, 1, None, None, None),
    ]
    made = chat_format.format_conversations(spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string"))
    got = {r.conv_id: r for r in made.select("conv_id", "n_turns", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "hello <|x|>\n!"), ("assistant", "right")] and got[1].loss == "right"
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[1].formatted.count("<|im_start|>") == 2


def test_compression_bands(spark):
    noise = hashlib.sha512(b"x").hexdigest().encode()
    for _ in range(5):
        noise += b"".join(hashlib.sha512(noise[-64:]).digest() for _ in range(4)).hex().encode()
    import base64

    junk = base64.b64encode(RNG.bytes(6000)).decode()
    rows = [(1, prose(400, 1)), (2, "again and again. " * 300), (3, " ".join(junk[k : k + 9] for k in range(0, len(junk), 9))), (4, None), (5, "a b c a b c a b\na b\n\n\na b")]
    # random words of ten letters repeat more than prose does, so these bands are wider than the shipped ones
    wide = ((0, 0.0, 4.0), (64, 0.7, 2.4), (256, 1.02, 2.7), (1024, 1.36, 3.2), (4096, 1.4, 3.4), (32768, 1.4, 3.8))
    got = {r.doc_id: r for r in quality_rules.compression_rules(frame(spark, rows), bands=wide).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[3].ratio_failed and not got[3].base_failed and got[2].ratio_failed
    assert (got[5].n_words, got[5].n_dup_lines, got[5].n_repeat_words, got[5].word_chars) == (12, 1, 12, 12)
    assert zlib.crc32(b"1") >= 0


def test_shipped_bands_part_labelled_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = quality_rules.compression_rules(rows).join(rows.select("doc_id", "quality"), "doc_id").filter("not base_failed")
    share = {r.quality: r.share for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.6


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = sum(any(0 <= j <= len(words) - 3 and windows[tuple(words[j : j + 3])] > 1 for j in (i - 2, i - 1, i)) for i in range(len(words)))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), again


def test_base_counts_like_brute_force(spark):
    rows = [*ODD, (40, "a b c d a b c\n# x\n# x\n\n|\u00a0é|\r\n# x"), (41, "é b c " * 30), (42, prose(200, 3) + "\n" + prose(60, 3))]
    got = quality_rules.compression_rules(frame(spark, rows)).collect()
    want = sorted((d, *plain_counts(t)) for d, t in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality_rules.compression_rules(empty(spark)).count() == 0


def test_junk_fails_wherever_it_stands(spark):
    import base64

    text, junk = prose(1366, 77) + " ", base64.b64encode(RNG.bytes(12288)).decode()
    again = ("the same sentence again and again. " * 200)[:4000]
    rows = [(1, text), (2, text + junk), (3, junk + text), (4, text + again), (5, again + text)]
    got = {r.doc_id: r for r in quality_rules.compression_rules(frame(spark, rows)).collect()}
    assert [got[k].chunks_failed for k in range(1, 6)] == [False, True, True, True, True]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, prose(120, 900 + k), "en", "s", 1) for k in range(40)] + [(99, prose(120, 900), "en", "s", 1), (98, prose(60, 950) + " " + prose(20, 1), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(40)) and all(r.round_trip for r in got)
