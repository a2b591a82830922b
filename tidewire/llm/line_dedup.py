"""Line dedup by content-defined chunks of lines.

Logical lines are a text's lines, and long ones folded after words chosen by their hash, so
that a passage folds alike wherever it stands; where none is chosen for long, the least
hash of a pair of words in each window folds.  A rolling hash over the last two lines'
hashes sets the chunk boundaries: after two lines they depend on the passage alone, not on
what was put before it.  A chunk in more than one document is repeated; where repeated
chunks that follow each other make up `min_lines` lines and `min_words` words or more, they
are removed everywhere but in the document with the least id.  Hashes only propose:
removal follows a comparison of the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bloom import bloom_of
from tidewire.llm.common import cut, numbered, raw_texts, squeeze, tidy, unsqueeze, whole_numbers

#: One word in so many ends a logical line; three in four lines end a chunk.
FOLD = 3
#: From so many words without an end on, each window of so many words ends a line at its least pair of words.
CALM, WINDOW = 6, 4
MIN_WORDS = 14
MIN_LINES = 2
#: Bytes of the filter of repeated hashes that goes to the workers.
FILTER_BYTES = 16 << 20
#: Letters of text for which one more bucket of hashes is made.
BUCKET_CHARS = 16_000_000
#: Bits of a chunk's hash that the filter of repeated chunks holds.
KEY_BITS = 44
#: Texts that are chunked together, and proposed chunks whose texts are gathered in one task before they go on.
CHUNK_ROWS, PROPOSALS = 64, 200_000

_RNG = np.random.default_rng(7)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x5851F42D4C957F2D
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, 1 << 16), _powers(_P_INV, 1 << 16)


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << n.bit_length()
        if size > 1 << 22:
            return _powers(_P, n), _powers(_P_INV, n)
        _UP, _DOWN = _powers(_P, size), _powers(_P_INV, size)
    return _UP, _DOWN


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Chunks:
    """The chunks of some texts: document, bytes [start, end) without outer blanks, hash, words, lines."""

    def __init__(self, texts: list[bytes], fold: int = FOLD):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = b"\n".join([*texts, b""])
        self.starts = np.cumsum(size + 1) - size - 1
        b = np.frombuffer(self.raw, np.uint8)
        up, down = _scale(len(b) + 1)
        blank = ((b - np.uint8(9)) < 5) | (b == 32)
        # a text ends with a blank of its own, so words never run over into the next
        turns = np.zeros(len(b), bool)
        turns[:1] = ~blank[:1]
        np.not_equal(blank[1:], blank[:-1], out=turns[1:])
        edge = np.flatnonzero(turns)
        words = edge[: len(edge) // 2 * 2].reshape(-1, 2)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * up[: len(b)], out=sums[1:])
        code = lambda s, e: _mix((sums[e] - sums[s]) * down[s]) + (e - s).astype(np.uint64)
        if not len(words):
            self.doc = self.start = self.end = self.words = self.lines = self.index = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.int64)
            return
        start, end = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
        doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, self.starts), append=len(start)))
        # a word opens a line after a line feed (there is one before each new text) and after a chosen word
        h = code(start, end)
        opens = np.ones(len(words) + 1, bool)
        opens[1:-1] = _mix(h[:-1]) % np.uint64(fold) == 0
        opens[np.searchsorted(start, np.flatnonzero(b == 10))] = True
        opens = opens[:-1]
        # where no word is chosen for long; equal pairs all fold, so that words that repeat are met at any place
        place = np.arange(len(words))
        long_ = np.flatnonzero(place - np.maximum.accumulate(np.where(opens, place, 0)) >= CALM + WINDOW - 1)
        if len(long_):
            near = long_[:, None] - np.arange(WINDOW)
            pair = _mix(h[near] * np.uint64(5) + h[near - 1] * np.uint64(0x9E3779B97F4A7C15))
            opens[long_ - pair.argmin(axis=1)] = True
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(words)) - 1
        line_doc, line_hash = doc[first], code(start[first], end[last])
        before = np.zeros_like(line_hash)
        before[1:] = np.where(line_doc[1:] == line_doc[:-1], line_hash[:-1], 0)
        ends = _mix(line_hash * np.uint64(3) + before * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(4) != 0
        ends[:-1] |= line_doc[1:] != line_doc[:-1]
        ends[-1] = True
        calm = ~(ends[3:] | ends[2:-1] | ends[1:-2] | ends[:-3]) & (line_doc[3:] == line_doc[:-3])
        ends[3:] |= calm
        to = np.flatnonzero(ends)
        of = np.append(0, to[:-1] + 1)
        self.doc, self.start, self.end = line_doc[of], start[first[of]], end[last[to]]
        self.hash = code(self.start, self.end).view(np.int64)
        self.words, self.lines = last[to] - first[of] + 1, to - of + 1
        new = np.append(True, self.doc[1:] != self.doc[:-1])
        self.index = np.arange(len(to)) - np.maximum.accumulate(np.where(new, np.arange(len(to)), 0))

    def runs(self, marked: np.ndarray, min_words: int, min_lines: int) -> np.ndarray:
        """Marks only where marked chunks in sequence have enough words and lines."""
        if not len(marked):
            return marked
        fresh = np.append(True, (self.doc[1:] != self.doc[:-1]) | (marked[1:] != marked[:-1]))
        run = np.cumsum(fresh) - 1
        enough = (np.bincount(run, self.words) >= min_words) & (np.bincount(run, self.lines) >= min_lines)
        return marked & enough[run]


def filter_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of the filter of repeated chunks; it proposes alone, so fewer bits than a chunk's own key has will do."""
    return hashes.view(np.uint64) >> np.uint64(64 - KEY_BITS)


def extremes(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the least and the greatest id of each."""
    if not len(keys):
        return keys, ids, ids
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)


def cleaned(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Without the spans; a span that begins a line takes the blanks after it along."""
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
        if a == 0 or raw[a - 1 : a] == b"\n":
            while at < len(raw) and _BLANK[raw[at]]:
                at += 1
    return b"".join([*out, raw[at:]])


ADDED = ("n_words", "n_removed_words", "n_removed_chunks")
_LAST = (1 << 63) - 1


def range_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted unsigned keys pass from one bucket to the next; a bucket is a range of keys."""
    return np.append(np.searchsorted(keys, np.array([-(-(k << 64) // buckets) for k in range(buckets)], np.uint64)), len(keys))


def pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    return squeeze(np.fromiter(map(len, texts), np.int64, len(texts))), zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def unpack_texts(sizes: bytes, body: bytes) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(body), np.cumsum(unsqueeze(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Proposals:
    """Places of proposed chunks in some documents, and the bytes of each distinct chunk once."""

    SCHEMA = "batch long, bucket long, keys binary, sizes binary, body binary, least binary, most binary, bad binary, places array<binary>"

    def __init__(self, buckets: int):
        self.buckets, self.texts, self.bad = buckets, {}, set()
        self.docs, self.places, self.n = [], [], 0

    def add(self, c: Chunks, on: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own, per_doc = np.unique(c.doc[on], return_counts=True)
        keys, seen = c.hash[on].view(np.uint64), self.texts
        self.docs.append((ids[own], rows[own], per_doc))
        self.places.append((keys, np.repeat(ids[own], per_doc), c.index[on]))
        self.n += len(on)
        for key, a, b in zip(keys.tolist(), c.start[on].tolist(), c.end[on].tolist(), strict=True):
            text = c.raw[a:b]
            if seen.setdefault(key, text) != text:
                self.bad.add(key)

    def rows(self) -> pa.RecordBatch:
        """For each bucket its keys (steps between them), chunks and ids; then one row with the places alone."""
        keys, ids, index = (np.concatenate(x) for x in zip(*self.places, strict=True))
        key, least, most = extremes(keys, ids)
        doc, row, per_doc = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        edges = range_edges(key, self.buckets)
        places = [squeeze(x) for x in (edges, np.searchsorted(key, keys), index, doc, row, per_doc)]
        batch = xxhash.xxh3_64_intdigest(b"".join([key.tobytes(), *places])) >> 1
        bad = np.fromiter((k in self.bad for k in key.tolist()), bool, len(key))
        out = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            x = slice(edges[k], edges[k + 1])
            sizes, body = pack_texts([self.texts[j] for j in key[x].tolist()])
            out.append((batch, k, squeeze(np.diff(key[x], prepend=np.uint64(0))), sizes, body, squeeze(least[x]), squeeze(most[x]), squeeze(bad[x]), None))
        out.append((batch, -1, None, None, None, None, None, None, places))
        types = [pa.int64()] * 2 + [pa.binary()] * 6 + [pa.list_(pa.binary())]
        names = [x.split()[0] for x in self.SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def compare(group: pd.DataFrame) -> pd.DataFrame:
    """For each batch's keys of one bucket: whether the key stands for the same bytes everywhere and for several documents, and its least id."""
    known: dict[int, bytes] = {}
    lists, bad = [np.cumsum(unsqueeze(x), dtype=np.uint64) for x in group["keys"]], set()
    for keys, sizes, body, given in zip(lists, group["sizes"], group["body"], group["bad"], strict=True):
        bad.update(keys[unsqueeze(given) > 0].tolist())
        for key, text in zip(keys.tolist(), unpack_texts(sizes, body), strict=True):
            if known.setdefault(key, text) != text:
                bad.add(key)
    ids = np.concatenate([unsqueeze(x).view(np.int64) for c in ("least", "most") for x in group[c]])
    key, least, most = extremes(np.concatenate(lists * 2), ids)
    good = (least < most) & ~np.fromiter((k in bad for k in key.tolist()), bool, len(key))
    at = [np.searchsorted(key, x) for x in lists]
    return pd.DataFrame({"batch": group["batch"], "bucket": group["bucket"], "good": [squeeze(good[x]) for x in at], "least": [squeeze(least[x]) for x in at]})


def resolve(places: pa.Table, verdicts: pa.Table) -> pa.Table:
    """The documents of a batch that lose chunks, with the chunks' places in them."""
    answers = verdicts.to_pylist()
    out = [pa.table({"id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "gone": pa.array([], pa.list_(pa.int32()))})]
    for packed in places.column("places").to_pylist():
        edges, at, index, doc, row, per_doc = (unsqueeze(x).view(np.int64) for x in packed)
        good, least = np.zeros(edges[-1], bool), np.zeros(edges[-1], np.int64)
        for x in answers:
            span = slice(edges[x["bucket"]], edges[x["bucket"] + 1])
            good[span], least[span] = unsqueeze(x["good"]) > 0, unsqueeze(x["least"]).view(np.int64)
        gone = good[at] & (np.repeat(doc, per_doc) > least[at])
        owner = np.repeat(np.arange(len(doc)), per_doc)[gone]
        some, first = np.unique(owner, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)), pa.int32()), pa.array(index[gone], pa.int32()))
        out.append(pa.table({"id": doc[some], "row": row[some], "gone": lists}))
    return pa.concat_tables(out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_lines: int = MIN_LINES, fold: int = FOLD) -> DataFrame:
    """The input rows with the repeated chunks taken out of the text, and n_words, n_removed_words, n_removed_chunks (long).

    Rows with one id count as one document, and what repeats inside one document alone stays;
    a null id counts as the greatest.  Texts without words, null ones too, stay as they are.  Of
    equal rows each is treated alike.  A text can be left empty.  Added columns replace columns
    of the same name; any other column keeps its name and values.  An empty table stays empty.
    Ids of any type that has an order; what are no whole numbers are numbered in their order first.
    """
    names = [f"column_{k}" for k in range(len(docs.columns))]
    if not whole_numbers(docs, id_col):
        key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
        rows = docs.toDF(*names)
        numbers = cut(numbered(rows.select(F.col(key).alias("key"))))
        rows = rows.join(numbers, rows[key] == numbers["key"], "left").select(*names, "number")
        kept = [k for k, name in enumerate(docs.columns) if name not in ADDED]
        out = dedup_lines(rows, "number", text, min_words, min_lines, fold)
        return out.select(*(names[k] for k in kept), *ADDED).toDF(*(docs.columns[k] for k in kept), *ADDED)
    own, key_of, at = docs.toDF(*names), names[docs.columns.index(id_col)], docs.columns.index(text_col)
    id_, text_ = F.coalesce(F.col(key_of).cast("long"), F.lit(_LAST)), F.col(names[at]).cast("string")
    rows = own.select(id_.alias("id"), text_.alias("text")).filter("text is not null")

    def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Chunks]]:
        for whole in batches:
            for k in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(k, CHUNK_ROWS)
                yield batch, Chunks(raw_texts(batch.column(column)), fold)

    buckets = max(8, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, n = [], [], 0

        def sent() -> pa.RecordBatch:
            key, id_ = np.concatenate(keys), np.concatenate(ids)
            met, least, most = extremes(key, id_)
            wide = least < most
            edges = range_edges(met << np.uint64(64 - KEY_BITS), buckets)
            some = np.flatnonzero(np.diff(edges)).tolist()
            parts = [slice(edges[k], edges[k + 1]) for k in some]
            columns = [[squeeze(np.diff(met[x], prepend=np.uint64(0))) for x in parts], [squeeze(least[x]) for x in parts], [squeeze(wide[x]) for x in parts]]
            return pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x, pa.binary()) for x in columns)], names=["bucket", "keys", "ids", "wide"])

        for batch, c in sliced(batches, 1):
            keys.append(filter_keys(c.hash))
            ids.append(batch.column(0).to_numpy()[c.doc])
            n += len(c.hash)
            if n > 500_000:
                yield sent()
                keys, ids, n = [], [], 0
        if n:
            yield sent()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(unsqueeze(x), dtype=np.uint64) for x in group["keys"]]
        key, least, most = extremes(np.concatenate(own), np.concatenate([unsqueeze(x) for x in group["ids"]]).view(np.int64))
        several = least < most
        several |= np.isin(key, np.concatenate([x[unsqueeze(w) > 0] for x, w in zip(own, group["wide"], strict=True)]))
        key = key[several].view(np.int64)
        return pd.DataFrame({"n": [len(key)], "keys": [key.tobytes()]})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], names=["key"])

    # keys go as packed steps, with the least id of each in some documents and whether these have it in several
    repeated = cut(rows.mapInArrow(tidy(hashes), "bucket long, keys binary, ids binary, wide binary").groupBy("bucket").applyInPandas(join, "n long, keys binary"))
    n = repeated.agg(F.sum("n")).first()[0] or 0
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom_of(repeated.select("keys").mapInArrow(unpack, "key long"), n, max_bytes=FILTER_BYTES))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Proposals(buckets)
        for batch, c in sliced(batches, 2):
            on = np.flatnonzero(c.runs(filter_.value.has(filter_keys(c.hash)), min_words, min_lines))
            if len(on):
                found.add(c, on, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if found.n > PROPOSALS:
                yield found.rows()
                found = Proposals(buckets)
        if found.n:
            yield found.rows()

    keyed = rows.select("id", F.xxhash64("text").alias("row"), "text")
    proposed = cut(keyed.mapInArrow(tidy(propose), Proposals.SCHEMA))
    # each batch's distinct chunks meet those of the others in their bucket, and the verdicts go back to the batch
    texts = proposed.filter("places is null").drop("places")
    verdicts = texts.groupBy("bucket").applyInPandas(compare, "batch long, bucket long, good binary, least binary")
    found = proposed.filter("places is not null").select("batch", "places")
    lists = found.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(resolve, "id long, row long, gone array<int>")
    lists = lists.groupBy("id", "row").agg(F.max("gone").alias("gone"))  # of equal rows all have the same

    keep = [k for k, c in enumerate(docs.columns) if c not in ADDED or k in (at, docs.columns.index(id_col))]
    both = own.withColumns({"id": id_, "row": F.xxhash64(text_)}).join(lists, ["id", "row"], "left").select(*(names[k] for k in keep), "gone")
    place = keep.index(at)
    out_names = [f"kept_{k}" for k in range(len(keep))]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first_row in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(first_row, CHUNK_ROWS)
                text = raw_texts(batch.column(place))
                words = np.fromiter((len(x.split()) for x in text), np.int64, len(text))
                less, chunks = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
                lists = batch.column(len(keep)).to_pylist()
                some = [d for d, ks in enumerate(lists) if ks]
                new = batch.column(place).to_pylist()
                c = Chunks([text[d] for d in some], fold)
                marked = np.zeros(len(c.doc), bool)
                begin = np.searchsorted(c.doc, np.arange(len(some) + 1))
                for j, d in enumerate(some):
                    marked[begin[j] + np.array(lists[d], np.int64)] = True
                marked = c.runs(marked, min_words, min_lines)
                less[some] = np.bincount(c.doc[marked], c.words[marked], minlength=len(some))
                chunks[some] = np.bincount(c.doc[marked], minlength=len(some))
                for j in np.unique(c.doc[marked]).tolist():
                    on = np.flatnonzero(marked[begin[j] : begin[j + 1]]) + begin[j]
                    gaps = np.flatnonzero(np.diff(on) > 1)
                    heads, tails = on[np.append(0, gaps + 1)], on[np.append(gaps, len(on) - 1)]
                    spans = zip((c.start[heads] - c.starts[j]).tolist(), (c.end[tails] - c.starts[j]).tolist(), strict=True)
                    new[some[j]] = cleaned(text[some[j]], list(spans)).decode()
                columns = [pa.array(new, pa.string()) if k == place else x for k, x in enumerate(batch.columns[: len(keep)])]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (words, less, chunks))], names=[*out_names, *ADDED])

    fields = [f"{name} {'string' if k == at else docs.schema[k].dataType.simpleString()}" for name, k in zip(out_names, keep, strict=True)]
    out = both.mapInArrow(tidy(rewrite), ", ".join([*fields, *(f"{c} long" for c in ADDED)]))
    return out.toDF(*(docs.columns[k] for k in keep), *ADDED)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their columns, cleaned; those of which no word is left are dropped, as others hold all they had.

    Null, empty and blank texts stay, as nothing is taken from them; so do repeated rows that keep a
    word.  Columns of any name keep their values; an empty table stays empty.
    """
    names = [f"own_{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    out = dedup_lines(docs.toDF(*names), own[id_col], own[text_col], **options)
    return out.filter("n_removed_words = 0 or n_removed_words < n_words").select(*names).toDF(*docs.columns)
