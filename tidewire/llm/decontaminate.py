"""Benchmark decontamination: windows of test words, found again in training texts.

The windows of the benchmark are a broadcast hash set.  The benchmark is read in parts of a
bounded number of words, so the set is bounded however long the benchmark is; each part is
one more pass over the documents, whose hits are written to the shared checkpoint folder
before the next part is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.common import SLICE_ROWS, cut, raw_texts, tidy

WINDOW = 13
#: Words of the benchmark that one broadcast set may hold.
PART_WORDS = 2_000_000
_KEEP = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: A-Z to a-z; all ASCII but digits and letters to a blank.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` ids, by doubling."""
    power, have, done, out = ids * _MIX, 1, 0, None
    while True:
        if size & have:
            piece = power[done:]
            out = piece if out is None else _join(out, piece, have)
            done += have
        if have * 2 > size:
            return out
        power, have = _join(power[: len(power) - have], power[have:], have), have * 2


def _join(a: np.ndarray, b: np.ndarray, have: int) -> np.ndarray:
    n = min(len(a), len(b))
    x = (a[:n] ^ (a[:n] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93 + 2 * have) + b[:n]
    return x * _MIX + np.uint64(have)


class Windows:
    """The windows of some benchmark items: by length, hash -> (window's word ids, its items)."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        exact: dict[tuple, set] = {}
        for item, raw in items:
            words = words_of(raw)
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                exact.setdefault(ids[k : k + size], set()).add(item)
        self.by_size: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        for size in sorted({len(x) for x in exact}):
            found: dict[int, list] = {}
            for ids, names in exact.items():
                if len(ids) == size:
                    found.setdefault(int(rolled(np.array(ids, np.uint64), size)[0]), []).append((ids, names))
            self.by_size[size] = (np.array(sorted(found), np.uint64), found)

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set]]:
        """Per text: its number of words, the words hit (positions), the items met."""
        split = [words_of(x) for x in texts]
        size = [len(w) for w in split]
        get = self.vocabulary.get
        starts = np.concatenate([[0], np.cumsum([n + 1 for n in size])]).astype(np.int64)
        ids = np.zeros(starts[-1], np.uint64)  # an unknown word and the gap after a text are 0
        for at, words in zip(starts, split, strict=False):
            if words:
                ids[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        marks, items = np.zeros(len(ids) + 1, np.int32), [set() for _ in texts]
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for n, (hashes, exact) in self.by_size.items():
            if len(ids) < n:
                continue
            whole = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(whole):
                continue
            code = rolled(ids, n)[whole]
            near = np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)
            for at, h in zip(whole[hashes[near] == code].tolist(), code[hashes[near] == code].tolist(), strict=True):
                seen = tuple(ids[at : at + n].tolist())
                for own, names in exact[h]:
                    if own == seen:  # the words are equal, not the hashes alone
                        marks[at] += 1
                        marks[at + n] -= 1
                        items[int(np.searchsorted(starts, at, "right")) - 1] |= names
        hit = np.cumsum(marks)[:-1] > 0
        for k, n in enumerate(size):
            yield n, np.flatnonzero(hit[starts[k] : starts[k] + n]), items[k]


def spans(at: np.ndarray) -> list[tuple[int, int]]:
    """Positions as [from, to) runs."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), (at[np.concatenate([cuts, [len(at) - 1]])] + 1).tolist(), strict=True))


def without_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs; a word's bytes and what stands between removed words go."""
    raw = text.encode()
    plain, at, ends, i = raw.translate(TABLE), [], [], 0
    for w in plain.split():
        i = plain.index(w, i)
        at.append(i)
        i += len(w)
        ends.append(i)
    out, last = [], 0
    for a, b in runs:
        out.append(raw[last : at[a]])
        last = ends[b - 1]
    return b"".join([*out, raw[last:]]).decode()


def parts(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple]]:
    """The benchmark's (item, text bytes) in lists of about `part_words` words, streamed in order."""
    held, n = [], 0
    for item, text in benchmark.toLocalIterator():
        raw = (text or "").encode()
        held.append((item, raw))
        n += len(raw) // 2
        if n > 2 * part_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row for each input row: id, `carry` columns, n_words, n_hit, runs (word spans hit), items.

    An item with fewer words than `window`, but not none, is one window.  Null or empty texts
    have no words and no hits; so has any text if the benchmark is empty.  Equal items are all
    named, null items as null.  Columns that are not asked for are not read, so none clashes.
    """
    sc = docs.sparkSession.sparkContext
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    keep = list(dict.fromkeys([id_col, *carry]))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    found = ["n_words long", "runs array<struct<first:long,past:long>>", f"items array<{item_kind}>"]
    types = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])), pa.list_(item_type)]

    def one_pass(df: DataFrame, shared, first: bool, last: bool) -> DataFrame:
        """Adds the hits of some items; the text goes on to the next pass, if there is one."""
        width = len(keep) + (not last)
        names_out = [*df.columns[:width], "n_words", "runs", "items"]
        n_keep = len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value, window)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    batch = whole.slice(at, SLICE_ROWS)
                    rows = []
                    for size, hit, names in windows.scan(raw_texts(batch.column(len(keep)))):
                        rows.append([size, hit, names])
                    if not first:
                        for row, runs, names in zip(rows, batch.column(len(keep) + 2).to_pylist(), batch.column(len(keep) + 3).to_pylist(), strict=True):
                            row[1] = np.unique(np.concatenate([row[1], *(np.arange(x["first"], x["past"]) for x in runs)]))
                            row[2] |= set(names)
                    lists = [[n for n, _, _ in rows], [[{"first": a, "past": b} for a, b in spans(hit)] for _, hit, _ in rows], [sorted(x, key=lambda i: (i is not None, i)) for _, _, x in rows]]
                    arrays = [pa.array(x, t) for x, t in zip(lists, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=names_out)

        return df.mapInArrow(tidy(run), ", ".join([*kinds, *["text_ string"] * (not last), *found]))

    out = docs.select(*keep, F.col(text_col).cast("string").alias("text_"))
    todo = parts(benchmark.select(F.col(item_col), F.col(item_text).cast("string")), part_words)
    items, first = next(todo, []), True
    while items is not None:
        shared, rest = sc.broadcast(items), next(todo, None)  # at most about part_words words
        out = one_pass(out, shared, first, rest is None)
        if rest is not None:  # a part's hits are written before the next part is read, so one part is held at a time
            out = cut(out)
            shared.unpersist()
        items, first = rest, False
    return out.withColumn("n_hit", F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r.past - r.first))


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20):
    """One word in `share`, or more, lies in windows of the benchmark."""
    return (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))


def _carried(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """What is found, with all columns of the documents under names of their own."""
    names = [f"column_{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    return find_contamination(docs.toDF(*names), benchmark, own[id_col], own[text_col], carry=tuple(names)), names


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns, of any names.

    Null and empty texts stay, and so do all documents if the benchmark is empty; repeated rows are
    judged one by one; an empty table stays empty."""
    found, names = _carried(docs, benchmark, id_col, text_col)
    return found.filter(~is_contaminated()).select(*names).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, without the words that lie in windows of the benchmark.

    Null texts stay null; a text of such words alone is left with what stood around them.  Rows,
    columns and empty tables as in `remove_documents`."""

    @F.pandas_udf("string")
    def clean(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(r) else without_words(t, [(x["first"], x["past"]) for x in r]) for t, r in zip(text, runs, strict=True)])

    found, names = _carried(docs, benchmark, id_col, text_col)
    at = docs.columns.index(text_col)
    return found.select(*(clean(names[k], "runs") if k == at else names[k] for k in range(len(names)))).toDF(*docs.columns)
