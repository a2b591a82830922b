"""Removal of repeated passages by recompression.

A text's words are symbols.  A round names each run of equal symbols and then each pair of a left
and a right symbol (a bit of a symbol's hash says which it is); a name is a hash of what it stands
for, so every task gives equal passages equal names without asking another.  Whether a symbol is
formed depends on few words around it, which are kept with it: a symbol whose words and context
lie inside a passage is formed wherever the passage stands.

Spark's first round counts the symbols of the last level over all texts and finds the common ones
(at most COMMON, those of 1 in COMMON words or more).  The second sends each window of `size` words
to the bucket of its least symbol that is not common (its own hash where there is none), together
with a fingerprint of its words.  Within a bucket a window is repeated where symbol and fingerprint
are met in a document of a smaller id.  The fingerprint gets longer with the number of words, so that
a false match anywhere stays unlikely (1 in 1000).  Tasks compare their own windows first and send
only those of the least id, so a passage that a third of all documents share is sent once by a task.

Words are what blanks of ASCII divide.  Null and empty texts have none.  Rows with one id count as
one document: none removes from another.  Rows with a null id lose nothing and nothing is compared
with them.  Ids may be of any type that has an order.  Texts of under `size` words lose nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, raw_texts, squeeze, tidy, unsqueeze

SIZE = 50
#: Rounds of naming; a symbol then has about four words.
ROUNDS = 5
#: Symbols of one in so many words are common; so there are so many at most.
COMMON = 1 << 16
#: Bytes of texts that are read together, windows that a task gathers before it sends them, words of a bucket.
SLICE_BYTES, FLUSH, BUCKET_WORDS = 1 << 20, 1 << 21, 1 << 21

_CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x5851F42D4C957F2D, 0x9FB21C651E98DF25)
_NONE = np.uint64((1 << 64) - 1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k for k < n; what is longer than usual is not kept."""
    up, down = _POWERS.get(base, (np.zeros(0, np.uint64),) * 2)
    if len(up) < n:
        long = np.full((2, 1 << max(n - 1, 1).bit_length()), base, np.uint64)
        long[1] = pow(base, -1, 1 << 64)
        long[:, 0] = 1
        up, down = np.multiply.accumulate(long, axis=1)
        if n <= 4 * SLICE_BYTES:
            _POWERS[base] = up, down
    return up, down


def sums_of(codes: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of codes times powers of the base; a span's hash is their difference, times the power of its start."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes))[0][: len(codes)], out=sums[1:])
    return sums


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of some texts, and the number of words of each text."""
    b = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    blank = ((b - np.uint8(9)) < 5) | (b == 32)
    turns = np.zeros(len(b), bool)
    turns[:1] = ~blank[:1]
    np.not_equal(blank[1:], blank[:-1], out=turns[1:])
    edge = np.flatnonzero(turns)
    start, end = edge[0::2], edge[1::2]
    sums = sums_of(_CODES[b], _BASES[0])
    code = mixed((sums[end] - sums[start]) * powers(_BASES[0], len(b) + 1)[1][start]) + (end - start).astype(np.uint64)
    bounds = np.searchsorted(start, np.cumsum(size))
    return mixed(code), np.diff(bounds, prepend=0)


class Symbols:
    """Symbols of the last round: names, and the words [lo, hi) on which each depends.

    At a text's ends a symbol depends on what would stand beyond, so these words reach one over the text."""

    def __init__(self, words: np.ndarray, per_text: np.ndarray, rounds: int = ROUNDS):
        ends = np.cumsum(per_text)
        starts = ends - per_text
        name, doc = words, np.repeat(np.arange(len(per_text)), per_text)
        lo = np.arange(len(words))
        hi = lo + 1
        for k in range(rounds):
            if not len(name):
                break
            # runs: a symbol depends on both neighbours, which must be others
            new = np.append(True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(name)))
            lo, hi = self.reach(doc[at], lo[np.maximum(at - 1, 0)], hi[np.minimum(at + size, len(name) - 1)], starts, ends)
            many = size > 1
            name, doc = name[at], doc[at]
            name[many] = mixed(name[many] + size[many].astype(np.uint64), 3 * k + 1)
            # pairs: a left symbol and the right one after it; others depend on the neighbour that they could have met
            right = mixed(name, 3 * k + 2) & np.uint64(1) == 1
            pair = np.append((~right[:-1]) & right[1:] & (doc[1:] == doc[:-1]), False)
            second = np.append(False, pair[:-1])
            before, after = self.reach(doc, np.append(lo[:1], lo[:-1]), np.append(hi[1:], hi[-1:]), starts, ends)
            lo, hi = np.where(right & ~second, before, lo), np.where(right, hi, after)
            name = np.where(pair, mixed(mixed(name, 3 * k + 3) + np.append(name[1:], name[-1:]), 3 * k + 3), name)
            keep = ~second
            name, doc, lo, hi = name[keep], doc[keep], lo[keep], hi[keep]
        self.name, self.lo, self.hi = name, lo, hi

    @staticmethod
    def reach(doc: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Reach of the neighbours; beyond the text for the first and the last symbol of one."""
        turn = doc[1:] != doc[:-1]
        first, last = np.append(True, turn), np.append(turn, True)
        return np.where(first, starts[doc] - 1, before), np.where(last, ends[doc] + 1, after)

    def anchors(self, at: np.ndarray, size: int, common: np.ndarray) -> np.ndarray:
        """The least name among the symbols that depend on a window alone and are not common; _NONE without any."""
        n = len(self.name)
        if not n or not len(at):
            return np.full(len(at), _NONE)
        name = self.name
        if len(common):
            met = np.searchsorted(common, name)
            name = np.where(common[np.minimum(met, len(common) - 1)] == name, _NONE, name)
        top = int(at[-1]) + size + 2
        first = np.cumsum(np.bincount(np.minimum(self.lo + 1, top), minlength=top + 1))[at]
        last = np.cumsum(np.bincount(np.minimum(self.hi, top), minlength=top + 1))[at + size]
        many = last - first
        out, width, least = np.full(len(at), _NONE), 1, name
        while (on := np.flatnonzero((many >= width) & (many < 2 * width))).size or (many >= 2 * width).any():
            out[on] = np.minimum(least[first[on]], least[last[on] - width])
            least = np.minimum(least[: max(len(least) - width, 0)], least[width:])
            width *= 2
        return out


def slices(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    """Rows of a batch with their texts, about SLICE_BYTES at a time, a longer text alone."""
    texts = raw_texts(batch.column(batch.schema.get_field_index("text")))
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield slice(at, k), texts[at:k]
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts)), texts[at:]


def common_symbols(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of words of all texts, and the sorted names of common symbols, at most 2 * COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, words = [], 0, 0

        def counted() -> pa.RecordBatch:
            # what is rarer in all parts than half of what makes a symbol common cannot be common
            name, n = np.unique(np.concatenate(names), return_counts=True) if names else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            on = n >= max(4, words / (2 * COMMON))
            name, n = np.append(name[on].view(np.int64), 0), np.append(n[on], words)
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(n), pa.array(np.arange(len(n)) == len(n) - 1)], ["name", "n", "words"])

        for batch in batches:
            for _, some in slices(batch):
                codes, per_text = words_of(some)
                own = Symbols(codes, per_text).name
                names.append(own)
                words, held = words + len(codes), held + len(own)
                if held >= FLUSH:
                    yield counted()
                    names, held, words = [], 0, 0
        yield counted()

    parts = texts.select("text").mapInArrow(tidy(run), "name long, n long, words boolean")
    found = cut(parts.groupBy("name", "words").agg(F.sum("n").alias("n")))
    total = found.filter("words").agg(F.sum("n")).first()[0] or 0
    names = found.filter(~F.col("words") & (F.col("n") >= max(8, total / (2 * COMMON)))).select("name").collect()
    return total, np.sort(np.array([r.name for r in names], np.int64).view(np.uint64))


def fingerprint_bytes(words: int) -> int:
    """Bytes of a fingerprint: of pairs of windows with one symbol there are words^2 / COMMON at most."""
    return min(16, max(5, math.ceil((2 * math.log2(max(words, 2)) - math.log2(COMMON) + 10) / 8)))


class Windows:
    """Windows of some documents: symbol, fingerprint, document and place."""

    def __init__(self, width: int, buckets: int, size: int, common: np.ndarray):
        self.width, self.buckets, self.size, self.common = width, buckets, size, common
        self.clear()

    def clear(self) -> None:
        self.ids, self.tags, self.parts, self.n = [], [], [], 0

    def add(self, ids: pa.Array, tags: np.ndarray, texts: list[bytes]) -> None:
        codes, per_text = words_of(texts)
        ends = np.cumsum(per_text)
        room = np.maximum(per_text - self.size + 1, 0)
        docs = np.flatnonzero(room)
        if not len(docs):
            return
        doc = np.repeat(docs, room[docs])
        place = np.arange(len(doc)) - np.repeat(np.cumsum(room[docs]) - room[docs], room[docs])
        at = (ends - per_text)[doc] + place
        marks = []
        for base in _BASES[: 1 + (self.width > 8)]:
            sums, down = sums_of(codes, base), powers(base, len(codes) + 1)[1]
            marks.append(mixed((sums[at + self.size] - sums[at]) * down[at], 7))
        anchor = Symbols(codes, per_text).anchors(at, self.size, self.common)
        # without a symbol of its own a window goes by its fingerprint
        anchor = np.where(anchor == _NONE, mixed(marks[0], 11), anchor)
        local = np.zeros(len(texts), np.int64)
        local[docs] = len(self.tags) + np.arange(len(docs))
        self.ids += ids.take(pa.array(docs)).to_pylist()
        self.tags += tags[docs].tolist()
        self.parts.append((anchor, marks, local[doc], place))
        self.n += len(doc)

    def send(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The windows of least ids, by bucket; those of other ids are known to be repeated and go along as such."""
        if not self.n:
            return
        anchor, doc, place = (np.concatenate([p[k] for p in self.parts]) for k in (0, 2, 3))
        marks = [np.concatenate([p[1][k] for p in self.parts]) for k in range(len(self.parts[0][1]))]
        rank = ranks(pa.array(self.ids, kind))
        repeated = larger(anchor, marks, rank[doc])
        bucket = (mixed(anchor, 13) >> np.uint64(32)).astype(np.int64) * self.buckets >> 32
        open_ = np.flatnonzero(~repeated)
        # a stretch: windows in sequence that have one symbol
        follows = (np.diff(open_) == 1) & (doc[open_[1:]] == doc[open_[:-1]]) & (anchor[open_[1:]] == anchor[open_[:-1]])
        first = np.flatnonzero(np.append(True, ~follows)) if len(open_) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(open_)))
        head = open_[first]
        order = np.lexsort((anchor[head], bucket[head]))
        head, count = head[order], count[order]
        turns = np.flatnonzero(np.append(True, np.diff(bucket[head]) != 0)) if len(head) else np.zeros(0, np.int64)
        for a, b in zip(turns, np.append(turns[1:], len(head)), strict=False):
            own, n = head[a:b], count[a:b]
            windows = np.repeat(own - (np.cumsum(n) - n), n) + np.arange(n.sum())
            raw = np.stack([m[windows] for m in marks], axis=1).view(np.uint8)[:, : self.width]
            yield self.packed(kind, int(bucket[own[0]]), doc[own], place[own], n, anchor[own], raw.tobytes())
        known = np.flatnonzero(repeated)
        if len(known):
            follows = (np.diff(known) == 1) & (doc[known[1:]] == doc[known[:-1]])
            first = np.flatnonzero(np.append(True, ~follows))
            yield self.packed(kind, int(bucket[known[0]]), doc[known[first]], place[known[first]], np.diff(np.append(first, len(known))), None, None)
        self.clear()

    def packed(self, kind, bucket, doc, place, count, anchor, marks) -> pa.RecordBatch:
        docs, local = np.unique(doc, return_inverse=True)
        values = [
            pa.array([bucket]),
            pa.array([[self.ids[d] for d in docs]], pa.list_(kind)),
            pa.array([[self.tags[d] for d in docs]], pa.list_(pa.int64())),
            *(pa.array([squeeze(x)]) for x in (local, place, count)),
            pa.array([None if anchor is None else squeeze(np.diff(anchor, prepend=np.uint64(0)))], pa.binary()),
            pa.array([marks], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(values, ["bucket", "ids", "tags", "doc", "place", "count", "anchor", "marks"])


def ranks(ids: pa.Array) -> np.ndarray:
    """Each id's number in the order of the ids."""
    values = np.array(ids.to_pylist(), object)
    return np.unique(values, return_inverse=True)[1].reshape(-1) if len(values) else np.zeros(0, np.int64)


def larger(anchor: np.ndarray, marks: list[np.ndarray], rank: np.ndarray) -> np.ndarray:
    """Whether a window is also in a document of a smaller id."""
    key = mixed(anchor, 17) + marks[0]
    order = np.argsort(key, kind="stable")
    same = np.ones(len(key), bool)
    for x in (anchor, *marks):
        same[1:] &= x[order[1:]] == x[order[:-1]]
    same[:1] = False
    if not same.any():
        return np.zeros(len(key), bool)
    of = np.cumsum(~same) - 1
    least = np.minimum.reduceat(rank[order], np.flatnonzero(~same))
    out = np.zeros(len(key), bool)
    out[order] = rank[order] > least[of]
    return out


def repeated_windows(docs: DataFrame, size: int = SIZE, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(id, tag, place, count): windows of the document that begin at words place to place + count - 1 and are repeated.

    docs: id, tag (a hash that tells rows of one id apart), text."""
    words, common = common_symbols(docs)
    width, buckets = fingerprint_bytes(words), max(1, -(-words // bucket_words))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"bucket long, ids array<{kind}>, tags array<long>, doc binary, place binary, count binary, anchor binary, marks binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, type_ = Windows(width, buckets, size, common), None
        for batch in batches:
            type_ = batch.schema.field("id").type
            for rows, texts in slices(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                held.add(part.column(0), part.column(1).to_numpy(zero_copy_only=False), texts)
                if held.n >= FLUSH:
                    yield from held.send(type_)
        if type_ is not None:
            yield from held.send(type_)

    def compare(table: pa.Table) -> pa.Table:
        rows, type_ = table.to_pylist(), table.schema.field("ids").type.value_type
        ids = [x for r in rows for x in r["ids"]]
        tags = np.array([x for r in rows for x in r["tags"]], np.int64)
        base = np.cumsum([0, *(len(r["ids"]) for r in rows)])
        parts = [[unsqueeze(r[k]).astype(np.int64) for k in ("doc", "place", "count")] for r in rows]
        doc = [p[0] + b for p, b in zip(parts, base, strict=False)]
        known = [k for k, r in enumerate(rows) if r["anchor"] is None]
        sent = [k for k, r in enumerate(rows) if r["anchor"] is not None]
        out = [(doc[k], parts[k][1], parts[k][2]) for k in known]
        if sent:
            d, p, n = (np.concatenate(x) for x in ([doc[k] for k in sent], [parts[k][1] for k in sent], [parts[k][2] for k in sent]))
            anchor = np.concatenate([np.cumsum(unsqueeze(rows[k]["anchor"])) for k in sent])
            raw = np.frombuffer(b"".join(rows[k]["marks"] for k in sent), np.uint8).reshape(-1, width)
            rank = ranks(pa.array(ids, type_))
            # a symbol of one document alone reveals no repeat
            order = np.argsort(anchor, kind="stable")
            heads = np.append(True, np.diff(anchor[order]) != 0)
            at, group = np.flatnonzero(heads), np.cumsum(heads) - 1
            least, most = np.minimum.reduceat(rank[d[order]], at), np.maximum.reduceat(rank[d[order]], at)
            shared = np.zeros(len(anchor), bool)
            shared[order] = (least < most)[group]
            first = np.cumsum(n) - n
            on = np.flatnonzero(shared)
            windows = np.repeat(first[on] - (np.cumsum(n[on]) - n[on]), n[on]) + np.arange(n[on].sum())
            lanes = np.zeros((len(windows), 16), np.uint8)
            lanes[:, :width] = raw[windows]
            marks = list(lanes.view(np.uint64).T[: 1 + (width > 8)])
            stretch = np.repeat(on, n[on])
            hit = np.flatnonzero(larger(anchor[stretch], marks, rank[d[stretch]]))
            where, place = stretch[hit], p[stretch[hit]] + windows[hit] - first[stretch[hit]]
            follows = (np.diff(where) == 0) & (np.diff(place) == 1)
            head = np.flatnonzero(np.append(True, ~follows)) if len(hit) else hit
            out.append((d[where[head]], place[head], np.diff(np.append(head, len(hit)))))
        doc, place, count = (np.concatenate([x[k] for x in out]).astype(np.int64) for k in range(3))
        found = pa.array(ids, type_).take(pa.array(doc))
        return pa.table([found, pa.array(tags[doc]), pa.array(place), pa.array(count)], ["id", "tag", "place", "count"])

    packs = docs.filter("id is not null and text is not null").select("id", "tag", "text").mapInArrow(tidy(gather), schema)
    return packs.groupBy("bucket").applyInArrow(compare, f"id {kind}, tag long, place long, count long")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, bucket_words: int = BUCKET_WORDS
) -> DataFrame:
    """id, n_words, n_removed and text: each row's words that no repeated window covers, joined by one space."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    spans = repeated_windows(rows, size, bucket_words).groupBy("id", "tag").agg(F.collect_list(F.struct("place", "count")).alias("spans"))
    spans = spans.select("id", "tag", F.col("spans.place").alias("places"), F.col("spans.count").alias("counts"))
    met = rows.join(spans, ["id", "tag"], "left").select("id", "text", "places", "counts")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                kept, n_words, n_removed = [], [], []
                for text, places, counts in zip(texts, part.column(2), part.column(3), strict=True):
                    words = text.split()
                    n_words.append(len(words))
                    if places.is_valid:
                        at, n = (np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in (places, counts))
                        edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n + size - 1, minlength=len(words) + 1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(edges)[:-1] == 0)]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_removed", "text"])

    return met.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_words long, n_removed long, text string")

