"""Near-duplicate groups by a chosen-path set similarity join over minwise tokens.

1. Each text becomes its set of word shingles, and the set a few minwise tokens.  Equal sets
   are one representative from here on (exact copies cost nothing more).
2. Independent trees start from one minwise token each.  A node holds the representatives
   that share the tokens chosen on the path to it, and branches on tokens chosen by a hash of
   the path.  Nodes of more than `LIMIT` members branch by shuffles, smaller ones inside a
   task, down to nodes of at most `SMALL`, which are compared exhaustively.  A node that
   branching barely shrinks is a dense group: in blocks of at most `LIMIT` members, which its
   pivots join, its most similar pairs make a spanning forest.
3. Pairs whose tokens agree often enough are confirmed on their full sets: first the best
   partner of each representative, then whatever still crosses two components, among it
   every member of a dense group outside the group's main component against the whole group.
   Only the links inside one component stay unconfirmed, as they cannot change any group.

The trees find a pair of similarity 0.8 but for a chance of (1 - 0.8) ** TREES where nodes
are small (2.6e-6).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SLICE_ROWS, cut, numbered, raw_texts, tidy, whole_numbers

TREES = 8
TOKENS = 256
SMALL = 8
#: Members of a node, or of a block of a dense group, that one task handles together.
LIMIT = 512
BRANCHES = 2
LEVELS = 10
#: A child larger than this share of its parent shows a dense group.
DENSE = 0.75
#: Similarity may be this much higher than the share of equal tokens (over four deviations).
MARGIN = 0.1
#: Members that are confirmed against one pivot in one run.
RUN = 64
#: Members of a large node, or outsiders in it, that one task compares with each other.
BLOCK = 512

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)[:, None]
_ROOT_A = _RNG.integers(0, 1 << 63, TREES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


class WordHashes(dict):
    """64-bit hash of each word met; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(raw: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's `size`-word shingles; of all words if there are fewer."""
    words = raw.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    code = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        x = h[k : k + n] * _PLACE[k % len(_PLACE)]
        code = (code ^ (x >> np.uint64(32)) ^ x) * _PLACE[(k + 3) % len(_PLACE)]
    return np.unique(code ^ (code >> np.uint64(29)))


def tokens(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trees' first tokens (64 bits) and the minwise tokens (8 bits) of a set."""
    low = (items >> np.uint64(16)).astype(np.uint32)
    least, first = None, None
    for k in range(0, len(items), 4096):
        m = (low[None, k : k + 4096] * _A + _B).min(axis=1)
        r = (items[None, k : k + 4096] * _ROOT_A).min(axis=1)
        least, first = (m, r) if least is None else (np.minimum(least, m), np.minimum(first, r))
    return first.view(np.int64), ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n_shingles, fp1, fp2 (fingerprint of the set), roots, sig; for no words only id and 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                n, fp1, fp2, roots, sigs = [], [], [], [], []
                for raw in raw_texts(batch.column(1)):
                    items = shingles(raw, size, hashes)
                    n.append(len(items))
                    if not len(items):
                        for x in (fp1, fp2, roots, sigs):
                            x.append(None)
                        continue
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64).tolist()
                    first, sig = tokens(items)
                    fp1.append(a)
                    fp2.append(b)
                    roots.append(first)
                    sigs.append(sig.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(roots, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["id", "n_shingles", "fp1", "fp2", "roots", "sig"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, n_shingles long, fp1 long, fp2 long, roots array<long>, sig binary")


def sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more, with the node's size."""
    size = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return rows.join(size, "node")


def agreements(sigs: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Numbers of equal tokens, over the last axis."""
    equal = np.packbits(sigs == others, axis=-1)
    return np.bitwise_count(equal.view(np.uint64)).sum(axis=-1, dtype=np.int16)


class Node:
    """Some representatives that one task compares: ids, set sizes, tokens."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sigs: np.ndarray, threshold: float):
        self.ids, self.n, self.sigs, self.threshold = ids, n, sigs, threshold
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def likely(self, a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> np.ndarray:
        """Whether the sizes and the tokens leave the threshold possible."""
        low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        return (agree >= TOKENS * (self.threshold - MARGIN)) & (low >= self.threshold * high - 1e-6)

    def keep(self, a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> None:
        on = self.ids[a] != self.ids[b]
        x, y = self.ids[a[on]], self.ids[b[on]]
        self.found.append((np.minimum(x, y), np.maximum(x, y), agree[on].astype(np.int32)))

    def small(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """All likely pairs of groups of at most SMALL rows that follow each other."""
        last = np.repeat(starts + sizes, sizes)
        rows = np.repeat(starts, sizes) + np.arange(len(last)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for d in range(1, int(sizes.max(initial=1))):
            a = rows[rows + d < last]
            for k in range(0, len(a), 8192):
                x = a[k : k + 8192]
                agree = agreements(self.sigs[x], self.sigs[x + d])
                on = self.likely(x, x + d, agree)
                self.keep(x[on], x[on] + d, agree[on])

    def leaf(self, rows: np.ndarray, group: int | None = None) -> None:
        """The likely pairs of a few rows; of more a spanning forest of the most similar ones, and, as a
        dense group of its own (-1 in place of an agreement), each tree's members.  Of a block of a
        larger dense group all rows are the group's members."""
        m = len(rows)
        agree = np.concatenate([agreements(self.sigs[rows[k : k + 16], None], self.sigs[None, rows]) for k in range(0, m, 16)])
        a, b = np.repeat(rows, m), np.tile(rows, m)
        agree = np.where(self.likely(a, b, agree.ravel()), agree.ravel(), 0).reshape(m, m)
        if group is not None:
            self.found.append((np.full(m, group), self.ids[rows], np.full(m, -1, np.int32)))
        elif m <= SMALL:
            x, y = np.nonzero(np.triu(agree, 1))
            self.keep(rows[x], rows[y], agree[x, y])
            return
        best, near, left, tree = np.zeros(m, np.int16), np.full(m, -1), np.ones(m, bool), np.arange(m)
        for _ in range(m):
            j = int(np.where(left, best, -1).argmax())
            left[j] = False
            if near[j] >= 0:
                tree[j] = tree[near[j]]
            closer = left & (agree[j] > best)
            best[closer], near[closer] = agree[j][closer], j
        on = np.flatnonzero(near >= 0)
        self.keep(rows[near[on]], rows[on], best[on])
        for t in np.unique(tree[on]).tolist() if group is None else ():
            members = np.unique(self.ids[rows[tree == t]])
            if len(members) > 2:
                name = xxhash.xxh3_64_intdigest(members.tobytes()) >> 1
                self.found.append((np.full(len(members), name), members, np.full(len(members), -1, np.int32)))

    def branch(self, rows: np.ndarray, path: int, depth: int = 0) -> None:
        if len(rows) <= SMALL or depth == LEVELS:
            return self.leaf(rows)
        for k in range(BRANCHES):
            chosen = xxhash.xxh3_64_intdigest(b"%d %d" % (path, k))
            order = rows[np.argsort(self.sigs[rows, chosen % TOKENS], kind="stable")]
            token = self.sigs[order, chosen % TOKENS]
            for child in np.split(order, np.flatnonzero(np.diff(token)) + 1):
                if len(child) > DENSE * len(rows):
                    self.leaf(child)
                elif len(child) > 1:
                    self.branch(child, chosen ^ int(self.sigs[child[0], chosen % TOKENS]) << 3, depth + 1)


def compare_groups(groups: DataFrame, threshold: float) -> DataFrame:
    """a, b, agree: likely pairs of groups (node, block) of rows (dense, id, n_shingles, sig); or a dense group, a member, -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared(table: pa.Table) -> pa.RecordBatch:
            node, block, dense, ids, n = (table.column(k).to_numpy() for k in range(5))
            sigs = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, TOKENS)
            starts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (block[1:] != block[:-1])))
            sizes, out = np.diff(starts, append=len(node)), Node(ids, n, sigs, threshold)
            few = (sizes <= SMALL) & ~dense[starts]
            out.small(starts[few], sizes[few])
            for at, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
                rows = np.arange(at, at + size)
                out.leaf(rows, int(node[at])) if dense[at] else out.branch(rows, int(node[at]))
            none = np.zeros(0, np.int64)
            a, b, agree = (np.concatenate([none, *x]) for x in zip(*out.found, strict=True)) if out.found else (none, none, none)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 8192:
                continue
            table = pa.Table.from_batches(held)
            node, block = table.column(0).to_numpy(), table.column(1).to_numpy()
            first = int(np.flatnonzero((node == node[-1]) & (block == block[-1]))[0])  # the last group may go on
            if first:
                yield compared(table.slice(0, first))
            held = table.slice(first).to_batches()
        if held and sum(x.num_rows for x in held):
            yield compared(pa.Table.from_batches(held))

    rows = groups.select("node", "block", "dense", "id", "n_shingles", "sig").repartition("node", "block").sortWithinPartitions("node", "block")
    return rows.mapInArrow(tidy(run), "a long, b long, agree int")


def grow_trees(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b, agree of likely pairs (a < b); with agree -1 a dense group a and its member b."""
    first = reps.select("id", F.posexplode("roots").alias("tree", "token"))
    rest = cut(sized(first.select(F.xxhash64("tree", "token").alias("node"), "id")).withColumn("parent", F.lit(None).cast("long")))
    found = []
    for depth in range(LEVELS + 1):
        found.append(rest.filter(F.col("size") <= LIMIT).select("node", F.lit(0).cast("long").alias("block"), F.lit(False).alias("dense"), "id"))
        rest = rest.filter(F.col("size") > LIMIT)
        if rest.isEmpty():
            break
        leaf = F.coalesce(F.col("size") > DENSE * F.col("parent"), F.lit(False)) | F.lit(depth == LEVELS)
        found.append(blocks(rest.filter(leaf)))
        chosen = F.expr(f"transform(sequence(0, {BRANCHES - 1}), k -> cast(pmod(xxhash64(node, k), {TOKENS}) as int))")
        below = rest.filter(~leaf).join(reps.select("id", "sig"), "id").select("node", "id", "size", "sig", F.explode(chosen).alias("i"))
        child = F.xxhash64("node", "i", F.expr("substring(sig, i + 1, 1)"))
        rest = cut(sized(below.select(child.alias("node"), "id", F.col("size").alias("parent"))))
    groups = found[0]
    for x in found[1:]:
        groups = groups.unionByName(x)
    return compare_groups(groups.join(reps.select("id", "n_shingles", "sig"), "id"), threshold)


def blocks(dense: DataFrame) -> DataFrame:
    """The members of dense groups in blocks of about LIMIT / 2; two pivots of the group are in each of its blocks."""
    counts = F.ceil(F.col("size") / (LIMIT // 2))
    members = dense.select("node", F.pmod(F.xxhash64("id", "node"), counts).alias("block"), "id")
    pivots = dense.groupBy("node").agg(F.min("id").alias("p"), F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("q"))).alias("r"), F.max(counts).alias("n"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    pivots = pivots.select("node", "n", F.explode(F.array_distinct(F.array("p", "r.q"))).alias("id")).select("node", each.alias("block"), "id")
    return members.unionByName(pivots).select("node", "block", F.lit(True).alias("dense"), "id")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full shingle sets."""
    partners = pairs.groupBy("a").agg(F.count("*").alias("n"))
    runs = F.ceil(F.col("n") / RUN)
    rows = pairs.select("a", "b").join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), runs).alias("run"))
    members = rows.select("a", "run", F.lit(1).alias("part"), F.col("b").alias("id"))
    pivots = rows.select("a", "run").distinct().select("a", "run", F.lit(0).alias("part"), F.col("a").alias("id"))
    given = members.unionByName(pivots).join(texts, "id").select("a", "run", "part", "id", "text")
    given = given.repartition("a", "run").sortWithinPartitions("a", "run", "part")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, own = WordHashes(), None, None
        for batch in batches:
            out = []
            a, run, part, ids = (batch.column(k).to_pylist() for k in range(4))
            for k in range(batch.num_rows):
                items = shingles((batch.column(4)[k].as_py() or "").encode(), size, hashes)
                if not part[k]:
                    key, own = (a[k], run[k]), items
                elif key == (a[k], run[k]):
                    common = len(np.intersect1d(own, items, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(items) - common):
                        out.append((a[k], ids[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return given.mapInArrow(tidy(check), "a long, b long")


def roots_of(links: DataFrame) -> DataFrame:
    """(id, component) where each id has one link to a lesser one: by jumping to the link's own link until none moves."""
    found = cut(links.select(F.col("b").alias("id"), F.col("a").alias("component")))
    while True:
        above = found.select(F.col("id").alias("component"), F.col("component").alias("up"))
        found = cut(found.join(above, "component", "left").select("id", F.coalesce("up", "component").alias("component"), F.col("up").isNotNull().alias("moved")))
        if found.filter("moved").isEmpty():
            return found.select("id", "component")
        found = found.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for the ids in links (a, b).  Large and small stars in turn
    (Kiveris et al., "Connected Components in MapReduce and Beyond"); each round is cut."""
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct())
    before = None
    while True:
        # large stars: every larger neighbour of x goes to the least neighbour of x
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small stars: every smaller neighbour of x, and x, go to the least of them
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = cut(small.unionByName(lowest.select("v", F.col("m").alias("u"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
        before = now


def crossing(pairs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """Pairs whose ends are in different components so far; `keep` names the components' columns to keep (c_a, c_b)."""
    for side in ("a", "b"):
        own = labels.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    return pairs.filter("c_a <> c_b").drop(*{"c_a", "c_b"}.difference(keep))


def outsider_links(large: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """In each large node, links of the members outside the node's main component with any member.

    Outsiders and members meet block by block on their full sets; only links leave a task."""
    rows = large.join(labels, "id", "left").select("node", "id", F.coalesce("component", "id").alias("c"))
    counts = rows.groupBy("node", "c").agg(F.count("*").alias("n"))
    main = counts.groupBy("node").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all"))
    main = main.select("node", F.col("m").getField("c").alias("main"), F.ceil((F.col("all") - F.col("m").getField("n")) / BLOCK).alias("outs"), F.ceil(F.col("all") / BLOCK).alias("ins")).filter("outs > 0")
    mine = rows.join(main, "node")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = mine.filter("c <> main").select("node", place("outs").alias("i"), spread("ins").alias("j"), F.lit(0).alias("part"), "id", "c")
    inside = mine.select("node", spread("outs").alias("i"), place("ins").alias("j"), F.lit(1).alias("part"), "id", "c")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        sets = [shingles((x or "").encode(), size, hashes) for x in group.text]
        n = np.array([len(x) for x in sets])
        owner, item = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
        _, where, met = np.unique(item, return_inverse=True, return_counts=True)
        shared = met > 1
        column = (np.cumsum(shared) - 1)[where]
        owner, column = owner[shared[where]], column[shared[where]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        part, ids, c = group.part.to_numpy(), group.id.to_numpy(), group.c.to_numpy()
        a, b = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        common = np.zeros((len(a), len(b)), np.float32)
        for first in range(0, int(shared.sum()), 4096):
            to = slice(*np.searchsorted(column, [first, first + 4096]))
            has = np.zeros((len(sets), 4096), np.float32)
            has[owner[to], column[to] - first] = 1
            common += has[a] @ has[b].T
        linked = 100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)
        x, y = np.nonzero(linked & (c[a][:, None] != c[b][None, :]))
        return pd.DataFrame({"a": ids[a[x]], "b": ids[b[y]]})

    given = outside.unionByName(inside).join(texts, "id")
    return given.groupBy("node", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least `percent`
    hundredths.  component_id is the least id that links lead to, itself included; kept marks
    that id.  Null, empty and blank texts have an empty set and are linked with nothing.  Rows
    with one id count as one document; a null id is linked with nothing, its component is null
    and it is kept.  Ids of any type that has an order; what are no whole numbers are numbered in
    their order first.  Other columns are not read.
    """
    if not whole_numbers(docs, id_col):
        return named_duplicates(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), size, percent).withColumnRenamed("key", id_col)
    threshold = percent / 100
    docs = docs.select(id_col, text_col)
    sets = cut(sketch(docs, id_col, text_col, size))
    full = sets.filter("n_shingles > 0 and id is not null")
    classes = full.groupBy("fp1", "fp2").agg(F.min("id").alias("id"))
    reps = cut(full.join(classes, ["fp1", "fp2", "id"]).select("id", "n_shingles", "roots", "sig").dropDuplicates(["id"]))
    same_id = full.select("id", "fp1", "fp2").join(classes.withColumnRenamed("id", "rep"), ["fp1", "fp2"])
    grown = cut(grow_trees(reps, threshold).groupBy("a", "b").agg(F.max("agree").alias("agree")))
    candidates, large = grown.filter("agree >= 0"), grown.filter("agree < 0").select(F.col("a").alias("node"), F.col("b").alias("id"))

    ids = grown.select(F.explode(F.expr("if(agree < 0, array(b), array(a, b))")).alias("id"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = cut(source.join(ids.distinct(), "id", "left_semi").dropDuplicates(["id"]))

    best = candidates.groupBy("b").agg(F.max(F.struct("agree", -F.col("a"))).alias("m")).select((-F.col("m").getField("col2")).alias("a"), "b")
    labels = roots_of(confirm(best, texts, size, percent))
    rest = crossing(candidates.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    more = confirm(rest, texts, size, percent).unionByName(outsider_links(large, labels, texts, size, percent))
    more = cut(crossing(more, labels, "c_a", "c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
    if not more.isEmpty():
        # what still crosses joins whole components
        of = components(more).select(F.col("id").alias("component"), F.col("component").alias("least"))
        own = labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct()).unionByName(of.select(F.col("component").alias("id"), "component"))
        labels = own.join(of, "component", "left").select("id", F.coalesce("least", "component").alias("component")).distinct()

    of_class = same_id.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    of_id = of_class.groupBy("id").agg(F.min("component").alias("component"))
    out = sets.select("id", "n_shingles").join(of_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def named_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """near_duplicates of (key, text), where the keys are no whole numbers."""
    numbers = cut(numbered(docs.select("key")))
    found = near_duplicates(docs.join(numbers, "key", "left").select("number", "text"), "number", "text", size, percent)
    least = numbers.select(F.col("number").alias("component_id"), F.col("key").alias("component"))
    out = found.join(numbers, "number", "left").join(least, "component_id", "left")
    return out.select("key", "n_shingles", F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without the others of each near-duplicate group, with all their columns.

    Rows without words and rows with a null id stay; so do all rows with the id that stays.
    """
    gone = near_duplicates(docs, id_col, text_col, size, percent).filter("not kept").select(F.col(id_col).alias("gone")).distinct()
    names = [f"own_{k}" for k in range(len(docs.columns))]
    own, key = docs.toDF(*names), names[docs.columns.index(id_col)]
    return own.join(gone, own[key] == gone["gone"], "left_anti").toDF(*docs.columns)
