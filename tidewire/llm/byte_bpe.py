"""Byte-level BPE by recursive DuckDB queries inside each task.

A pre-token is a word of token-position rows.  Each round joins neighbouring rows with the
merge table and contracts each word's leftmost pair of minimum rank, until no pair of any
word is in the table.  Long words (runs of thousands of letters or blanks) contract, in a
round, all pairs of their minimum rank from the left without overlap; a merge's own pairs
rank after it in a trained vocabulary, so the fixpoint is the same in far fewer rounds.
Decoding joins the ids of a text with the vocabulary and aggregates their bytes in order.
"""

from __future__ import annotations

import base64
import pickle
import shutil
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import give_back

#: Pre-tokens that one task remembers; beyond it forgets them and goes on.
REMEMBERED = 200_000
#: Bytes of text that one query encodes or decodes, unless a single text is longer.
STEP_BYTES = 500_000

#: Words of more bytes contract all pairs of the minimum rank in one round.
LONG_BYTES = 48

#: Positions rise through all words, so one order serves all words of a query.
CONTRACT = """
WITH RECURSIVE state(w, step, pos, tok) AS (
  SELECT w, 0, pos, tok FROM start
  UNION ALL
  (WITH seen AS (SELECT w, step, pos, tok, lead(tok) OVER near AS tok2, lead(w) OVER near AS w2, lag(pos) OVER near AS before
                 FROM state WINDOW near AS (ORDER BY pos)),
        ranked AS (SELECT seen.*, merges.merged FROM seen LEFT JOIN merges ON merges.a = seen.tok AND merges.b = seen.tok2 AND seen.w = seen.w2),
        best AS (SELECT w, min(merged::BIGINT * 4294967296 + pos) % 4294967296 AS p FROM ranked WHERE merged IS NOT NULL GROUP BY w)
   SELECT r.w, r.step + 1, r.pos, CASE WHEN r.pos = best.p THEN r.merged ELSE r.tok END
   FROM ranked r JOIN best ON best.w = r.w WHERE r.before IS DISTINCT FROM best.p)
),
last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT state.w, list(state.tok ORDER BY state.pos) AS ids FROM state JOIN last USING (w, step) GROUP BY state.w
"""

#: At most 32 rounds in one query, so that its rows stay bounded; it runs until no word is left.
CONTRACT_LONG = """
CREATE OR REPLACE TABLE reached AS
WITH RECURSIVE state(w, step, pos, tok) AS (
  SELECT w, 0, pos, tok FROM start
  UNION ALL
  (WITH seen AS (SELECT w, step, pos, tok, lead(tok) OVER near AS tok2, row_number() OVER near AS i
                 FROM state WINDOW near AS (PARTITION BY w ORDER BY pos)),
        ranked AS (SELECT seen.w, seen.step, seen.pos, seen.tok, seen.i, merges.merged, min(merges.merged) OVER (PARTITION BY seen.w) AS best
                   FROM seen LEFT JOIN merges ON merges.a = seen.tok AND merges.b = seen.tok2),
        least AS (SELECT w, i, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM ranked WHERE merged = best),
        chosen AS (SELECT w, i, (i - min(i) OVER (PARTITION BY w, run)) % 2 AS odd FROM least)
   SELECT r.w, r.step + 1, r.pos, CASE WHEN c.i IS NOT NULL THEN r.best ELSE r.tok END
   FROM ranked r LEFT JOIN chosen c ON c.w = r.w AND c.i = r.i AND c.odd = 0
                 LEFT JOIN chosen p ON p.w = r.w AND p.i = r.i - 1 AND p.odd = 0
   WHERE r.best IS NOT NULL AND p.i IS NULL AND r.step < 32)
),
last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT state.w, state.pos, state.tok, step FROM state JOIN last USING (w, step)
"""

#: A byte is one letter of Latin-1 here.
DECODE = """
SELECT ids.w, string_agg(vocabulary.letters, '' ORDER BY ids.pos) AS raw
FROM ids JOIN vocabulary USING (tok) GROUP BY ids.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def tables_of(pickled: bytes) -> tuple[np.ndarray, pa.Table, pa.Table]:
    """Of pickled ranks: each byte's token, the merge table, the vocabulary; all that a worker keeps between tasks."""
    ranks = pickle.loads(pickled)
    pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    a, b, merged = zip(*pairs, strict=True) if pairs else ((), (), ())
    merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "merged": pa.array(merged, pa.int32())})
    vocabulary = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "letters": [t.decode("latin-1") for t in ranks]})
    return np.array([ranks[bytes([x])] for x in range(256)], np.int32), merges, vocabulary


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, pickled: bytes, pattern: str):
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {"": b""}
        self.single, merges, vocabulary = tables_of(pickled)
        self.folder = tempfile.mkdtemp()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": self.folder})
        self._table("merges", merges)
        self._table("vocabulary", vocabulary)

    def _table(self, name: str, data) -> None:
        given = data if isinstance(data, pa.Table) else pa.table({k: pa.array(v).cast(pa.int32()) for k, v in data.items()})
        self.db.register("given", given)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: list[str], query: str) -> None:
        """Remembers the ids of words, as little-endian bytes."""
        raw = [x.encode() for x in words]
        size = np.fromiter(map(len, raw), np.int32, len(raw))
        letters = np.frombuffer(b"".join(raw), np.uint8)
        self._table("start", {"w": np.repeat(np.arange(len(raw)), size), "pos": np.arange(len(letters)), "tok": self.single[letters]})
        if query is CONTRACT_LONG:
            while self.db.execute(query).execute("SELECT max(step) FROM reached").fetchall()[0][0] == 32:
                self.db.execute("CREATE OR REPLACE TABLE start AS SELECT w, pos, tok FROM reached")
            query = "SELECT w, list(tok ORDER BY pos) FROM reached GROUP BY w"
        for k, ids in self.db.execute(query).fetchall():
            self.known[words[k]] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        known = self.known
        new = set().union(*split).difference(known)
        long = [w for w in new if len(w) > LONG_BYTES // 4 and len(w.encode()) > LONG_BYTES]
        for part, query in ((list(new.difference(long)), CONTRACT), (long, CONTRACT_LONG)):
            if part:
                self.learn(part, query)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        whole = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
        n = [len(x) // 4 for x in ids]
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        rows = pa.table({"w": owner, "pos": np.arange(len(whole), dtype=np.int32), "tok": whole})
        self.db.register("ids", rows)
        found = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("ids")
        return [found.get(k, "").encode("latin-1") for k in range(len(ids))]


def steps(texts: list[str], step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """[from, to) of runs of texts of about step_bytes."""
    first = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > step_bytes:
            yield first, k
            first, size = k, 0
        size += len(x)
    if first < len(texts):
        yield first, len(texts)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """One row for each input row: the kept columns, n_tokens, ids (array, if asked for), ids_raw, decoded.

    `vocabulary` is the rank file's path on the driver; its fixed table goes to the workers.
    A null or empty text has no tokens and decodes to nothing.  `decoded` is binary.  Repeated rows
    are encoded one by one; an empty table gives no rows.  Columns that are not asked for are not
    read; kept ones may have the names of added ones, which then come second.
    """
    table = docs.sparkSession.sparkContext.broadcast(pickle.dumps(read_ranks(vocabulary)))  # one public vocabulary
    fields = [f"out_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)]
    added = ["n_tokens", *["ids"] * ids, "ids_raw", "decoded"]
    schema = ", ".join([*fields, "n_tokens long", *["ids array<int>"] * ids, "ids_raw binary", "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(table.value, pattern)
        try:
            for whole in batches:
                yield from coded(codec, whole)
        finally:  # a worker that is used again holds no tables
            codec.db.close()
            shutil.rmtree(codec.folder, ignore_errors=True)
            del codec
            give_back()

    def coded(codec: Codec, whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [x or "" for x in whole.column(len(keep)).to_pylist()]
        for a, b in steps(texts):
            raw = codec.encode(texts[a:b])
            back = codec.decode(raw)
            out = [pa.array([len(x) // 4 for x in raw], pa.int64())]
            if ids:
                out.append(pa.array([memoryview(x).cast("i") for x in raw], pa.list_(pa.int32())))
            out += [pa.array(raw, pa.binary()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays([*whole.slice(a, b - a).columns[: len(keep)], *out], names=[f"out_{k}" for k in range(len(keep))] + added)

    return docs.select(*keep, F.col(text_col).cast("string").alias("text_")).mapInArrow(run, schema).toDF(*keep, *added)
