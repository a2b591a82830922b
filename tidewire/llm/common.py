"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

#: Rows of one Arrow batch that Python handles together; bounds what is decoded at once.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(mod))


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names in spark.checkpoint.dir; only a session of one machine gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, so that a lost executor loses nothing."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """fn over slices of at most `rows` rows; keeps no more than one slice's working data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane (as many as the largest needs), compressed."""
    x = np.ascontiguousarray(numbers).astype("<u8", copy=False)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : packed[0]] = planes.T
    return out.view("<u8").ravel()


def give_back() -> None:
    """Returns freed memory to the system, so that a Python worker that waits holds little; without glibc it stays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(fn: Callable) -> Callable:
    """A function of batches that gives freed memory back when its task has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def whole_numbers(docs: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers, which the operators compare as they are."""
    return isinstance(docs.schema[docs.columns.index(id_col)].dataType, IntegralType)


def numbered(ids: DataFrame) -> DataFrame:
    """The distinct values of column `key` with `number` (long), which rises with them from 0; nulls have none.

    Ranges of keys lie in the checkpoint folder, so a task that runs again meets the same ones; the
    driver holds one count for each range."""
    ranges = cut(ids.filter("key is not null").distinct().repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    sizes = sorted(ranges.groupBy("range").count().collect())
    starts, at = [], 0
    for r in sizes:
        starts.append((r["range"], at))
        at += r["count"]
    before = ids.sparkSession.createDataFrame(starts, "range int, before long")
    place = F.row_number().over(W.partitionBy("range").orderBy("key"))
    return ranges.withColumn("place", place).join(F.broadcast(before), "range").select("key", (F.col("before") + F.col("place") - 1).alias("number"))
