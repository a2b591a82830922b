"""Language-model scoring with a log-frequency Bloom filter.

The filter holds each word and word pair of the training texts once for every level that its
quantised count reaches (Talbot and Osborne, "Randomised Language Modelling"), on the scale
2 ** (level / 2), so that one occurrence is level 1.  A count is read back by probing level
after level until one is absent.  The filter is in segments by hash, rows of their own, each
sized by the items it holds, so it grows with the corpus and never fills; the counts it was
made from are not read again.  While all segments fit FILTER_BYTES they are broadcast and the tasks
that score probe them; a larger filter stays on the executors: beside its segment lies what the
blocks ask of it, each item once, and later tasks probe the segments and send the levels to the
blocks.  Both give the same scores.

With low(x) and high(x) the least and greatest count of x's level, M the sum of low over the
training words, and V their number,

  P(w) = (low(w) + 0.1) / (M + 0.1 (V + 1))
  P(w | v) = PAIR * low(v w) / high(v) + (1 - PAIR) * P(w)   where the filter knows v, else P(w)

P(.) sums to 1 with one unknown word; P(. | v) to 1 at most, since the low counts of v's pairs
add up to no more than v's own count; what a probe wrongly finds present is the only excess.

The exact counts of the base score fit no broadcast, so they meet the texts by blocks: texts
are packed into blocks with their own lists of words, each list goes to the bucket of its
words, comes back with their counts over all blocks, and meets its block again.  `base_score`
does that much and no more.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bloom import mixed
from tidewire.llm.common import SLICE_ROWS, cut, raw_texts, squeeze, tidy, unsqueeze

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 8_000_000
#: Tokens for which one more bucket of words and of pairs is made.
BUCKET_TOKENS = 2_000_000
#: Bits of a pair's hash over those that count the letters of all texts: of the pairs that training
#: never met, one in 2 ** PAIR_BITS at most reads as another one.
PAIR_BITS = 8
#: A filter of at most so many bytes is broadcast; a larger one is probed where its segments are.
FILTER_BYTES = 32 << 20
BITS_PER_KEY = 16
PROBES = 4
PAIR = 0.25
STEPS = 2  # levels to an octave
DAMP = 0.1


def end_or_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Segment:
    """Part of the filter: `bits` (8 to a byte) of `size` places, and the highest level set in it."""

    def __init__(self, size: int, top: int, bits: bytes):
        self.size, self.top, self.bits = np.uint64(size), top, np.frombuffer(bits, np.uint8)

    @staticmethod
    def key(hashes: np.ndarray, level: int) -> np.ndarray:
        return hashes ^ np.uint64((level * 0x9E3779B97F4A7C15) & (1 << 64) - 1)

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a, b = mixed(keys, 1), mixed(keys, 2) | np.uint64(1)
        return (((a + np.uint64(k) * b) % self.size).astype(np.int64) for k in range(PROBES))

    def at(self, places: np.ndarray) -> np.ndarray:
        return (self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for places in self.places(keys):
            found &= self.at(places)
        return found

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each item, by probes of level 1, 2, ... until one is absent; none is over the highest set."""
        level, open_ = np.zeros(len(hashes), np.uint8), np.arange(len(hashes))
        for step in range(1, self.top + 1):
            open_ = open_[self.has(self.key(hashes[open_], step))]
            level[open_] = step
        return level


class Levels(Segment):
    """A segment being made: quantised counts of some items, each item once for every level."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.top = int(levels.max(initial=0))
        keys = np.concatenate([self.key(hashes[levels >= k], k) for k in range(1, self.top + 1)] or [np.zeros(0, np.uint64)])
        self.size = np.uint64(max(64, BITS_PER_KEY * len(keys)))
        self.bits = np.zeros(int(self.size), bool)
        for places in self.places(keys):
            self.bits[places] = True

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.bits[places]

    def row(self, kind: str, bucket: int) -> dict:
        return {"kind": kind, "bucket": bucket, "size": int(self.size), "top": self.top, "bits": np.packbits(self.bits, bitorder="little").tobytes()}


def levels_for(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(STEPS * np.log2(np.maximum(1, counts)) + 1e-9).astype(np.int64)


def low(level: np.ndarray) -> np.ndarray:
    """The least count of the level; none for level 0."""
    return np.where(level > 0, np.ceil(2.0 ** ((level.astype(np.int64) - 1) / STEPS)), 0.0)


def high(level: np.ndarray) -> np.ndarray:
    """The greatest count of the level; none for level 0."""
    return np.where(level > 0, np.maximum(low(level), np.ceil(2.0 ** (level.astype(np.int64) / STEPS)) - 1), 0.0)


class Pairs:
    """The distinct pairs of tokens in texts laid end to end, by their hashes of so many bits, in order."""

    def __init__(self, words: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, bits: int, buckets: int):
        inner = np.ones(len(words), bool)
        inner[np.cumsum(sizes) - sizes] = False
        #: Place of each pair's second token, and the pair's number.
        self.at = np.flatnonzero(inner)
        met = pair_hash(hashes[words[self.at - 1]], hashes[words[self.at]]) >> np.uint64(64 - bits)
        self.hashes, self.where = np.unique(met, return_inverse=True)
        # a bucket is a range of hashes
        self.edges = np.searchsorted(self.hashes, np.array([-(-(k << bits) // buckets) for k in range(buckets + 1)], np.uint64))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second, 3)


class Packer:
    """Packs texts into blocks: documents as word numbers, and the list of words."""

    def __init__(self):
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {b"": 0}
        self.keys, self.held, self.sizes, self.ids, self.bytes = [], [], [], [], 0

    def add(self, key, held: bool, raw: bytes) -> None:
        words, numbers = raw.lower().split(), self.numbers  # of bytes: A-Z alone
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        ids.append(0)
        self.keys.append(key)
        self.held.append(held)
        self.sizes.append(len(ids))
        self.ids.append(np.array(ids, np.uint32))
        self.bytes += len(raw)

    def row(self, block: int) -> tuple:
        row = (block, squeeze(np.concatenate(self.ids)), self.zstd.compress(b"\n".join(self.numbers)), squeeze(np.array(self.sizes)), self.keys, self.held)
        self.clear()
        return row


def pack(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of (id, held, text), named by what they hold."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["block", "body", "words", "sizes", "ids", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen, key_type = Packer(), b"", None

        def flush() -> pa.RecordBatch:
            # a task's earlier blocks tell apart blocks of equal rows
            nonlocal seen
            part = xxhash.xxh3_64_intdigest(seen + repr(packer.keys).encode() + b"".join(x.tobytes() for x in packer.ids)) >> 1
            seen = struct.pack("<Q", part)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(key_type), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(packer.row(part), kinds, strict=True)], names=names)

        for whole in batches:
            key_type = whole.column(0).type
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                for key, h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                    packer.add(key, h, raw)
                    if packer.bytes >= block_bytes:
                        yield flush()
        if packer.keys:
            yield flush()

    schema = f"block long, body binary, words binary, sizes binary, ids array<{kind}>, held array<boolean>"
    return cut(rows.mapInArrow(tidy(run), schema))


def hashes_of(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(end_or_word, words), np.uint64, n)


def unzipped(body: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(body).split(b"\n")


def rising(numbers: np.ndarray) -> bytes:
    """Whole numbers that do not fall, as the steps between them."""
    return squeeze(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def risen(packed: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(packed), dtype=np.uint64)


def training(sizes: np.ndarray, held: list[bool]) -> np.ndarray:
    """Of a block's tokens, which are in training."""
    return np.repeat(~np.array(held, bool), sizes)


def sent(packed: DataFrame, columns: list[str], parts: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that blocks send to buckets: (block, bucket, *what `parts` yields of the block's columns)."""
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (schema.count(",") - 1)]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                block, *own = (x[k].as_py() for x in whole.columns)
                rows = [(block, *x) for x in parts(*own)]
                if rows:  # texts of one token have no pairs
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return packed.select("block", *columns).mapInArrow(tidy(run), schema)


def word_lists(packed: DataFrame, buckets: int) -> DataFrame:
    """Each block's words by bucket, with their counts in training and their numbers in the block."""

    def parts(body: bytes, words: bytes, sizes: bytes, held: list[bool]) -> Iterator[tuple]:
        words, zstd = unzipped(words), zstandard.ZstdCompressor(level=1)
        counts = np.bincount(unsqueeze(body)[training(unsqueeze(sizes).astype(np.int64), held)].astype(np.int64), minlength=len(words))
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[k] : edges[k + 1]]
            yield k, zstd.compress(b"\n".join([words[j] for j in own.tolist()])), squeeze(counts[own]), rising(own)

    return sent(packed, ["body", "words", "sizes", "held"], parts, "block long, bucket long, body binary, counts binary, places binary")


def pair_lists(packed: DataFrame, bits: int, buckets: int) -> DataFrame:
    """Each block's distinct pairs by bucket, as the steps between their hashes, with their counts in training."""

    def parts(body: bytes, words: bytes, sizes: bytes, held: list[bool]) -> Iterator[tuple]:
        words, sizes = unzipped(words), unsqueeze(sizes).astype(np.int64)
        pairs = Pairs(unsqueeze(body), hashes_of(words, len(words)), sizes, bits, buckets)
        counts = np.bincount(pairs.where[training(sizes, held)[pairs.at]], minlength=len(pairs.hashes))
        for k in np.flatnonzero(np.diff(pairs.edges)).tolist():
            part = slice(pairs.edges[k], pairs.edges[k + 1])
            yield k, rising(pairs.hashes[part]), squeeze(counts[part])

    return sent(packed, ["body", "words", "sizes", "held"], parts, "block long, bucket long, steps binary, counts binary")


#: The filter's segment of a bucket; what is asked of it, each item once, and for each block which of these it asks.
SEGMENT = "kind string, bucket long, size long, top long, bits binary, asked binary, blocks array<long>, own array<binary>"


def word_totals(packed: DataFrame, buckets: int, filtered: bool) -> DataFrame:
    """A row for each bucket: its words, their counts over all blocks, each block's part of them, the bucket's tokens n, words v
    and sum of low counts in training; and the filter's segment of the words, if `filtered`."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        number, lists = {}, []
        for body in group.body:
            lists.append(np.array([number.setdefault(w, len(number)) for w in unzipped(body)], np.int64))
        sums = np.zeros(len(number), np.int64)
        for own, counts in zip(lists, group.counts, strict=True):
            sums[own] += unsqueeze(counts).astype(np.int64)  # a block has each word once
        learnt = sums > 0
        hashes = hashes_of(number, len(number))[learnt] if filtered else np.zeros(0, np.uint64)
        segment = Levels(hashes, levels_for(sums[learnt]) if filtered else np.zeros(0, np.int64))
        sizes = {"n": int(sums.sum()), "v": int(learnt.sum()), "mass": int(low(segment.read(hashes)).sum())}
        asked = zstandard.ZstdCompressor(level=1).compress(b"\n".join(number))
        own = {"asked": asked, "blocks": group.block.tolist(), "own": [squeeze(x) for x in lists], "places": group.places.tolist(), "counts": squeeze(sums)}
        return pd.DataFrame([segment.row("word", int(group.bucket.iloc[0])) | sizes | own])

    return cut(word_lists(packed, buckets).groupBy("bucket").applyInPandas(add, SEGMENT + ", places array<binary>, counts binary, n long, v long, mass long"))


def pair_segments(packed: DataFrame, bits: int, buckets: int) -> DataFrame:
    """The filter's segments of the pairs in all training texts."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        lists = [risen(x) for x in group.steps]
        hashes, where = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(where, np.concatenate([unsqueeze(x) for x in group.counts])).astype(np.int64)
        # hashes of few bits are spread before they choose places in the filter
        segment = Levels(mixed(hashes[sums > 0]), levels_for(sums[sums > 0]))
        own = [rising(x) for x in np.split(where, np.cumsum([len(x) for x in lists])[:-1])]
        return pd.DataFrame([segment.row("pair", int(group.bucket.iloc[0])) | {"asked": rising(hashes), "blocks": group.block.tolist(), "own": own}])

    return cut(pair_lists(packed, bits, buckets).groupBy("bucket").applyInPandas(build, SEGMENT))


def answers(rows: DataFrame, columns: list[str], of: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """What each bucket's row has for its blocks: `of` gives, from the row's columns, the answers in the order of its blocks."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                bucket, blocks, *own = (x[k].as_py() for x in whole.columns)
                found = [(kind, block, bucket, *x) for block, (kind, *x) in zip(blocks, of(*own), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return rows.select("bucket", "blocks", *columns).mapInArrow(tidy(run), schema)


def totals(words: DataFrame) -> DataFrame:
    """Each block's words by bucket with their counts over all blocks."""

    def of(counts: bytes, places: list[bytes], own: list[bytes]) -> Iterator[tuple]:
        sums = unsqueeze(counts)
        return (("totals", at, squeeze(sums[unsqueeze(x).astype(np.int64)])) for at, x in zip(places, own, strict=True))

    return answers(words, ["counts", "places", "own"], of, "kind string, block long, bucket long, places binary, totals binary")


def probed(segments: DataFrame) -> DataFrame:
    """The levels of each block's words and pairs, read from the segments."""

    def of(kind: str, size: int, top: int, bits: bytes, asked: bytes, own: list[bytes]) -> Iterator[tuple]:
        if kind == "pair":
            hashes, numbers = mixed(risen(asked)), risen
        else:
            words = unzipped(asked)
            hashes, numbers = hashes_of(words, len(words)), unsqueeze
        levels, zstd = Segment(size, top, bits).read(hashes), zstandard.ZstdCompressor(level=1)
        return ((kind, zstd.compress(levels[numbers(x).astype(np.int64)].tobytes())) for x in own)

    return answers(segments, ["kind", "size", "top", "bits", "asked", "own"], of, "kind string, block long, bucket long, levels binary")


def packed_texts(docs: DataFrame, held, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The texts in blocks, and their letters."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return pack(rows, block_bytes), chars


def buckets_for(chars: int) -> int:
    return max(8, chars // 6 // BUCKET_TOKENS)


def sizes_of(words: DataFrame) -> tuple[int, int, int]:
    """Tokens, words and sum of low counts in training."""
    return words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "mass"))).first()


def rated(packed: DataFrame, met: DataFrame, n: int, v: int, docs: DataFrame, id_col: str, model: Callable | None = None) -> DataFrame:
    """Each block's texts with the counts that came for it; `model` gives one more number for each token of a row of texts."""
    space, names = float(np.log10(n + DAMP * (v + 1))), [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    names += ["score"] if model else []

    def rate(own: pa.Table, met: pa.Table) -> pa.Table:
        rows, out = met.to_pylist(), []
        lists = [(x["bucket"], risen(x["places"]).astype(np.int64), unsqueeze(x["totals"])) for x in rows if x["kind"] == "totals"]
        exact = np.zeros(1 + max((int(at.max(initial=0)) for _, at, _ in lists), default=0), np.int64)
        for _, at, counts in lists:
            exact[at] = counts
        base = np.log10(exact + DAMP) - space
        for k in range(own.num_rows):
            w, lengths = (unsqueeze(own.column(c)[k].as_py()).astype(np.int64) for c in ("body", "sizes"))
            starts = np.cumsum(lengths) - lengths
            numbers = [lengths, np.add.reduceat((exact[w] > 0).astype(np.int64), starts), np.full(len(lengths), n), np.add.reduceat(base[w], starts)]
            if model:
                numbers.append(np.add.reduceat(model(w, lengths, unzipped(own.column("words")[k].as_py()), lists, rows), starts))
            out.append(pa.Table.from_arrays([own.column("ids")[k].values, own.column("held")[k].values, *map(pa.array, numbers)], names=names))
        return pa.concat_tables(out)

    blocks = packed.select("block", "body", *(["words"] if model else []), "sizes", "ids", "held")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double" + (", score double" if model else "")
    return blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(rate, schema)


def base_score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of `score` but the last, from exact counts: neither pairs nor a filter are made."""
    packed, chars = packed_texts(docs, held, id_col, text_col, block_bytes)
    words = word_totals(packed, buckets_for(chars), filtered=False)
    n, v, _ = sizes_of(words)
    return rated(packed, totals(words), n, v, docs, id_col)


def score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held` is a boolean column over the input; rows where it is true (null counts as false)
    teach nothing.  Tokens are words, with A-Z lower-cased, and one end per text; a null or empty
    text is its end alone.  Without training rows every count is 0 and each token has probability 1.
    A filter of more than `filter_bytes` is not broadcast; the scores are the same.
    Repeated rows are scored one by one, null ids stay null; other columns are not read, whatever
    their names.
    """
    packed, chars = packed_texts(docs, held, id_col, text_col, block_bytes)
    buckets, bits = buckets_for(chars), min(60, chars.bit_length() + PAIR_BITS)
    words = word_totals(packed, buckets, filtered=True)
    n, v, mass = sizes_of(words)
    pairs = pair_segments(packed, bits, buckets)
    segments, met, shared = words.select(*pairs.columns).unionByName(pairs), totals(words), None
    if (segments.agg(F.sum("size")).first()[0] or 0) <= 8 * filter_bytes:
        rows = segments.select("kind", "bucket", "size", "top", "bits").collect()
        shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.bucket): (r.size, r.top, bytes(r.bits)) for r in rows})
        met = met.withColumn("levels", F.lit(None).cast("binary"))
    else:
        met = met.unionByName(probed(segments), allowMissingColumns=True)
    room = mass + DAMP * (v + 1)

    def model(w: np.ndarray, lengths: np.ndarray, words: list[bytes], lists: list[tuple], rows: list[dict]) -> np.ndarray:
        unzip = zstandard.ZstdDecompressor().decompress
        sent = {(x["kind"], x["bucket"]): x["levels"] for x in rows if x["levels"] is not None}

        def level_of(kind: str, bucket: int, hashes: np.ndarray) -> np.ndarray:
            if shared is not None:
                return Segment(*shared.value[kind, bucket]).read(hashes)
            return np.frombuffer(unzip(sent[kind, bucket]), np.uint8)

        hashes = hashes_of(words, len(words))
        level = np.zeros(len(words), np.uint8)
        for bucket, at, _ in lists:
            level[at] = level_of("word", bucket, hashes[at])
        plain, most = np.minimum(1.0, (low(level) + DAMP) / room), high(level)
        pairs = Pairs(w, hashes, lengths, bits, buckets)
        pair_level = np.zeros(len(pairs.hashes), np.int64)
        for bucket in np.flatnonzero(np.diff(pairs.edges)).tolist():
            part = slice(pairs.edges[bucket], pairs.edges[bucket + 1])
            pair_level[part] = level_of("pair", bucket, mixed(pairs.hashes[part]))
        p = plain[w]  # all that a text's first token has, as it has no history
        at, history = pairs.at, most[w[pairs.at - 1]]
        both = (1 - PAIR) * p[at] + PAIR * np.minimum(1.0, low(pair_level)[pairs.where] / np.maximum(1.0, history))
        p[at] = np.where(history > 0, both, p[at])
        return np.log10(np.maximum(p, 1e-300))

    return rated(packed, met, n, v, docs, id_col, model)
