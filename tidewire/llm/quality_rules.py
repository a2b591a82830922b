"""Quality rules from compression: zstandard ratios of whole documents and of fixed chunks.

Text that repeats itself compresses far better than prose, text without structure (keys,
encoded bytes) hardly at all.  How well prose compresses depends on its length, so each
length has its own band of accepted ratios.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_slices, raw_texts

#: (bytes from which it holds, least ratio, greatest ratio) of a whole document.  The limits lie
#: around the ratios of labelled prose in four languages (sf0.1): the upper ones 0.05 to 0.14 over
#: the highest, as words with a mark or a separator after each of them begin there, the lower ones at
#: 0.8 of the lowest, over encoded bytes.
BANDS = (
    (0, 0.0, 4.0), (64, 0.7, 2.4), (256, 1.05, 1.95), (384, 1.1, 1.95), (512, 1.15, 1.97), (768, 1.25, 2.03), (1024, 1.36, 2.1), (1536, 1.45, 2.19), (2048, 1.5, 2.21),
    (3072, 1.55, 2.27), (4096, 1.6, 2.4), (8192, 1.6, 2.48), (16384, 1.6, 2.58), (32768, 1.6, 2.7), (131072, 1.6, 2.9),
)
CHUNK_BYTES = 4096
#: A chunk of full length outside this band is a bad one; base64 is at 1.3 to 1.4, prose at 2.05 to 2.26.
CHUNK_BAND = (1.7, 2.5)
MAX_BAD_SHARE = 0.25
LEVEL = 3

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` words that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    marked = bytearray(len(words))
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            marked[i : i + size] = marked[j : j + size] = b"\1" * size
    return sum(marked)


def ratios(raw: bytes, zstd: zstandard.ZstdCompressor, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, list[float]]:
    """Raw bytes by compressed bytes: of the whole, and of each chunk of full length; the last one ends the text and may overlap."""
    whole = len(raw) / len(zstd.compress(raw)) if raw else 0.0
    if len(raw) < chunk_bytes:
        return whole, []
    starts = [*range(0, len(raw) - chunk_bytes, chunk_bytes), len(raw) - chunk_bytes]
    parts = (raw[k : k + chunk_bytes] for k in starts)
    return whole, [chunk_bytes / len(zstd.compress(x)) for x in parts]


def in_band(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    low, high = next(((lo, hi) for at, lo, hi in reversed(bands) if n_bytes >= at), (0.0, float("inf")))
    return low <= ratio <= high


def compression_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band=CHUNK_BAND, max_bad_share: float = MAX_BAD_SHARE
) -> DataFrame:
    """One row for each input row: counts over the whole text, ratios and verdicts.

    `ratio_failed`: the whole text's ratio is outside its length's band.  `chunks_failed`:
    more than `max_bad_share` of the full chunks are outside `chunk_band` (texts shorter than
    a chunk have none).  `base_failed`: fewer than 50 words, or more than half of the words
    lie in repeated 3-word windows.  A null or empty text has no words, ratio 0 and is failed
    by the base rule.  Repeated rows are judged one by one; other columns are not read.
    """
    schema = "id_ long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, ratio_failed boolean"
    kind = docs.schema[id_col].dataType.simpleString()
    schema = schema.replace("id_ long", f"id_ {kind}")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for raw in raw_texts(batch.column(1)):
            words, text, lines = raw.split(), raw.decode(), raw.split(b"\n")
            extra = 0
            if len(set(lines)) < len(lines):
                full = [x for x in lines if x.strip()]
                extra = len(full) - len(set(full))
            whole, parts = ratios(raw, zstd, chunk_bytes)
            rows.append((
                len(words), len(text) - sum(map(text.count, BLANKS)), sum(raw.count(x) for x in SYMBOLS), extra, repeated_words(words),
                whole, len(parts), sum(not chunk_band[0] <= x <= chunk_band[1] for x in parts), bool(raw) and not in_band(len(raw), whole, bands),
            ))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], names=names)

    out = map_slices(docs.select(F.col(id_col), F.col(text_col).cast("string")), judge, schema)
    out = out.withColumnRenamed("id_", id_col)
    out = out.withColumn("chunks_failed", F.col("n_bad_chunks") > F.lit(max_bad_share) * F.col("n_chunks"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~(F.col("base_failed") | F.col("ratio_failed") | F.col("chunks_failed")))
