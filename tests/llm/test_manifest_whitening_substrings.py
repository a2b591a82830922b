"""Substring dedup, embedding whitening and the Merkle manifest against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import merkle, substring_dedup, whitening

RNG = np.random.default_rng(5)


def left_of(rows, size):
    """(id, words, words removed, text left) of each row, by comparing all windows."""
    least = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for p in range(len(words) - size + 1):
            if i is not None:
                key = tuple(words[p : p + size])
                least[key] = min(least.get(key, i), i)
    out = Counter()
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for p in range(len(words) - size + 1):
            if i is not None and least[tuple(words[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out[(i, len(words), len(gone), kept)] += 1
    return out


def removed(spark, rows, size, bucket_words=500, kind="long"):
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"doc_id {kind}, text string, places string").repartition(5)
    found = substring_dedup.without_repeats(docs, size=size, bucket_words=bucket_words)
    return Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect())


def test_substrings_of_50_words(spark):
    prose = lambda n: [f"w{k}" for k in RNG.integers(0, 3000, n)]
    shared, line = prose(130), prose(12)
    rows = []
    for i in range(40):
        k = int(RNG.integers(0, 70))
        rows.append((i, " ".join(prose(30) + line + prose(20) + shared[k : k + 45 + i] + prose(40) + line * (i % 3))))
    rows += [(50 + i, " ".join(shared[: 49 + i])) for i in range(3)]
    rows += [(60 + i, " ".join(["ha"] * (40 + 8 * i))) for i in range(6)]
    rows += [(70 + i, " ".join(["tick", "tock"] * (20 + 9 * i))) for i in range(4)]
    rows += [(80 + i, rows[3][1]) for i in range(4)] + [(80, rows[3][1]), (81, rows[5][1] + " tail")]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one"), (None, rows[3][1]), (None, None)]
    rows += [(94, "\xa0".join(["é ü 😀"] * 60)), (95, "\x0b".join(prose(4000)))]
    assert removed(spark, rows, 50) == left_of(rows, 50)
    assert sum(n for _, _, n, _ in left_of(rows, 50)) > 1000


@pytest.mark.parametrize(("letters", "size"), [("ab", 6), ("abc", 9), ("abcdefgh", 5), ("abcdefghijklmnopqrstuvwxyz", 12)])
def test_substrings_of_small_alphabets(spark, letters, size):
    rows = []
    for i in range(60):
        words = list(RNG.choice(list(letters), int(RNG.integers(0, 80))))
        if i > 20:
            own = rows[int(RNG.integers(0, 20))][1].split()
            words = words[:20] + own[5:45] + words[20:]
        rows.append((int(RNG.integers(-30, 30)), " ".join(words)))
    got, want = removed(spark, rows, size, 200), left_of(rows, size)
    assert got == want


def test_substrings_with_text_ids_and_without_rows(spark):
    passage = " ".join(f"v{k}" for k in range(60))
    rows = [("b", passage), ("a", "start " + passage), ("é", passage + " end"), (None, passage)]
    assert removed(spark, rows, 50, kind="string") == left_of(rows, 50)
    assert not removed(spark, [], 50)


def symbols(texts):
    codes, per_text = substring_dedup.words_of(texts)
    return codes, per_text, substring_dedup.Symbols(codes, per_text)


def test_symbols_depend_on_their_words_alone():
    passage = [f"w{k}" for k in RNG.integers(0, 40, 300)]
    texts = [" ".join(list(RNG.choice(list("xyzw"), n)) + passage + list(RNG.choice(list("xyzw"), 9))).encode() for n in (0, 1, 17)]
    codes, per_text, _ = symbols(texts)
    starts, seen = np.cumsum(per_text) - per_text, []
    own = substring_dedup.Symbols(codes, per_text)
    for start, n in zip(starts, (0, 1, 17), strict=True):
        on = (own.lo >= start + n) & (own.hi <= start + n + 300)
        seen.append(list(zip(own.name[on], own.lo[on] - start - n, own.hi[on] - start - n, strict=True)))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 30
    at = np.arange(starts[2] + 17, starts[2] + 17 + 250)
    assert (own.anchors(at, 50, np.zeros(0, np.uint64)) != substring_dedup._NONE).mean() > 0.9


def test_words_have_equal_hashes_anywhere():
    codes, per_text, _ = symbols([b"a bb a", b"", b" bb\x0b\xc2\xa0 ", b"bb"])
    assert per_text.tolist() == [3, 0, 2, 1]
    assert codes[0] == codes[2] and codes[1] == codes[3] == codes[5] and len(set(codes.tolist())) == 3


def test_fingerprints_grow_with_the_words():
    assert substring_dedup.fingerprint_bytes(0) == 5
    assert substring_dedup.fingerprint_bytes(10**8) < substring_dedup.fingerprint_bytes(10**13) <= 16


def components(vectors):
    """Eigenvalues and vectors of the distinct whole vectors, with numpy's symmetric solver."""
    x = np.unique(np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000, axis=0)
    centred = x - x.mean(axis=0)
    values, turned = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], turned[:, ::-1]


def test_whitening(spark):
    base = RNG.normal(size=(300, 20)) @ np.diag(np.geomspace(5, 0.05, 20)) @ RNG.normal(size=(20, 20)) + 3
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 40
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    bad = [None, [], [1.0] * 19, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [None] + [0.0] * 19]
    rows += [(1000 + k, v, "x") for k, v in enumerate(bad)] + [(None, vectors[5], "x"), (7, vectors[7], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(4)
    got = whitening.whiten(table).collect()
    x, values, turned = components(vectors)
    assert Counter(r.vec_id for r in got) == Counter([i for i, *_ in rows[:340]] * 16 + [None] * 16 + [7] * 16)
    s, n = x.sum(axis=0), len(x)
    for r in got:
        v = vectors[5 if r.vec_id is None else r.vec_id]
        own = np.floor(np.array(v) * 64).astype(np.int64) + 1_000_000
        k = r.component - 1
        assert (r.n, r.deviation) == (n, int(((n * own - s) ** 2).sum()))
        assert math.isclose(abs(r.whitened), abs((own - s / n) @ turned[:, k] / np.sqrt(values[k])), rel_tol=1e-6, abs_tol=1e-7)
        assert math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9
    first = {r.vec_id: r.whitened for r in got if r.component == 1 and r.vec_id is not None and r.vec_id < 300}
    assert abs(np.mean(list(first.values()))) < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id string, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", None), ("b", [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0])] * 3, schema)).count() == 0
    # three entries, of which one repeats another and one never moves: one component alone
    rows = [(str(k), [float(k), float(k), 5.0]) for k in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert [r.component for r in got] == [1] * 10 and all(math.isclose(r.explained, 1) for r in got)


def test_exact_sums_of_large_numbers():
    y = RNG.integers(-(1 << 45), 1 << 45, (5000, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.exact_gram(y).tolist() == want


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, alter=False):
    out = []
    for name, x in zip(merkle.FIELDS, row, strict=True):
        if alter and name == "text" and x is not None:
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
        out.append("-" if x is None else f"{len(str(x).encode())}:{x}")
    return h(*out)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(levels, place):
    steps = []
    for nodes in levels[:-1]:
        a = place // 8 * 8
        steps.append(("".join(nodes[a:place]), "".join(nodes[place + 1 : a + 8])))
        place //= 8
    return steps


def manifest_of(rows):
    is_tampered = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, is_tampered(r[0]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    out = Counter()
    for at, g in enumerate(names):
        for place, (known, i, own, altered) in enumerate(sorted(groups[g])):
            steps = path(trees[g], place) + path(top, at)
            acc = altered
            for left, right in steps:
                acc = h(left, acc, right)
            root = top[-1][0]
            out[(i if known else None, own, trees[g][-1][0], root, h(*(a + b for a, b in steps)), acc, acc == root)] += 1
    return out


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string")
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    found = merkle.manifest(docs.repartition(3), tampered).withColumn("proof", merkle.digest(merkle.proof_text(F.col("steps"))))
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in found.collect())


def test_merkle_manifest(spark):
    rows = [(int(i), "s", "en", 3, f"Text {i}") for i in RNG.permutation(5000)[:700]]
    rows += [(int(i), None, "dé", None, None) for i in RNG.integers(-(1 << 62), 1 << 62, 66)]
    rows += [(i * 64 - 640, "s", "zz", 1, "É A") for i in range(20)] + [(63, "s", "zz", 1, "b"), (127, "s", "zz", 1, "b")]
    rows += [(5, "s", None, 1, "Alone")]
    # repeated rows, different rows of one id, null ids
    rows += [(9, "s", "xx", 1, "Same")] * 5 + [(9, "s", "xx", 1, f"Other {k}") for k in range(12)]
    rows += [(None, "s", "xx", 1, f"N {k % 9}") for k in range(20)] + [(10, "s", "xx", 1, "A" * 70000), (11, "s", "", 1, "")]
    assert manifest(spark, rows) == manifest_of(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 512, 513])
def test_merkle_sizes(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert manifest(spark, rows) == (manifest_of(rows) if n else Counter())


def test_merkle_many_groups_and_id_types(spark):
    rows = [(i, "s", f"l{i:03}", 1, "T") for i in range(70)]
    assert manifest(spark, rows) == manifest_of(rows)
    with pytest.raises(TypeError):
        merkle.manifest(spark.createDataFrame([("a", "s", "en", 1, "t")], "doc_id string, source string, lang string, n_chars long, text string"), F.lit(False))
