"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and works on
all that its predecessor kept.  `run` writes each stage's rows as Parquet in the shared
checkpoint folder and hands what it reads back to the next; a stage's folder goes when the next one
is written, the last one stays, as the returned rows are read from it.

Null and empty texts pass every stage and encode to no tokens; a null id is never a
near-duplicate.  Rows with one id count as one document in line dedup and near-dedup, and equal
rows are kept or dropped together.  Further columns are left behind.  Empty tables give an empty
result of the same schema.  Each stage bounds the session's Arrow batches by bytes, where the
session has no bound of its own; that setting stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from tidewire.llm.common import id_remainder, read_table, with_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of one Arrow batch, about; 10000 rows of long texts, Spark's own bound, can be any size.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """The stage, with texts that go to Python workers by BATCH_BYTES at a time."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the network learns from the labelled ones given."""
    net = toxicity.train(docs, read_table(spark, sf_dir, "labels"), id_remainder("id", 3) != 1)
    return toxicity.score_toxicity(docs, net, keep=COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


@in_small_batches
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows the text."""
    found = line_dedup.without_repeats(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows cover less than a twentieth of the words."""
    return decontaminate.remove_documents(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "text"))
    same = found["decoded"] == F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeats),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL cannot express the network of the first stage; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that Spark wrote, wherever it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
