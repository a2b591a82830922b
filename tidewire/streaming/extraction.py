"""Restartable extraction (STR-04): each article's result is stored once, is marked only then, and failures are asked again.

A store is a folder of Parquet: `answers/batch=B` holds what the extractor gave for the articles of a batch, `marks/batch=B`
what is done or failed.  Both are overwritten by batch, so a batch that runs again after a crash leaves one result, and
answers count only once their batch has marks: a run that dies between the two steps leaves nothing that readers see.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.extraction import extracted

Extractor = Callable[[list[tuple[str, str]]], list]
RESULT = (
    "struct<entities:array<struct<name:string,entity_type:string>>,relationships:array<struct<subject:string,subject_type:string,predicate:string,"
    "object:string,object_type:string,confidence:double,context:string>>,event_date:date,amounts:map<string,string>>"
)
ANSWERS = f"id long, url string, title string, content string, result {RESULT}, error string, attempts int"
MARKS = "id long, done boolean, attempts int"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("answers", ANSWERS), ("marks", MARKS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/batch=none")

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema + ", batch string").parquet(f"{self.path}/{name}")

    def marks(self) -> DataFrame:
        """(id, done, attempts, batch), one row for each time that an article was asked about."""
        return self.read("marks", MARKS)

    def answers(self) -> DataFrame:
        """Answers of batches that have marks."""
        return self.read("answers", ANSWERS).join(self.marks().select("batch").distinct(), "batch", "left_semi")

    def results(self) -> DataFrame:
        """(id, url, result) of the articles that are done."""
        return self.answers().filter("error is null").select("id", "url", "result")

    def failed(self, most: int, but: str = "") -> DataFrame:
        """Articles that failed whenever they were asked about, less than `most` times, as they were last; a batch can be left out."""
        others = F.col("batch") != but
        tries = self.marks().filter(others).groupBy("id").agg(F.bool_or("done").alias("done"), F.max("attempts").alias("attempts"))
        open_ = tries.filter(~F.col("done") & (F.col("attempts") < most)).select("id", "attempts")
        return self.answers().filter(others).join(open_, ["id", "attempts"], "left_semi").select("id", "url", "title", "content", "attempts")

    def overwrite(self, rows: DataFrame, name: str, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")


def run_batch(store: Store, articles: DataFrame, batch: str, extract: Extractor, most: int = 5, between: Callable[[], None] | None = None) -> None:
    """Asks about new articles (id, url, title, content) and those that failed in other batches, stores the answers, then marks them.

    Articles that are done are left out; of several rows with one id one counts.  `between` runs before the marks (for tests)."""
    others = store.marks().filter(F.col("batch") != batch)
    new = articles.select("id", "url", "title", "content").dropDuplicates(["id"]).join(others.select("id"), "id", "left_anti").withColumn("attempts", F.lit(0))
    asked = new.unionByName(store.failed(most, but=batch))
    found = extracted(asked, extract).join(asked, "id")
    store.overwrite(found.select("id", "url", "title", "content", "result", "error", (F.col("attempts") + 1).alias("attempts")), "answers", batch)
    if between:
        between()
    kept = store.read("answers", ANSWERS).filter(F.col("batch") == batch)
    store.overwrite(kept.select("id", F.col("error").isNull().alias("done"), "attempts"), "marks", batch)


def run_stream(
    articles: DataFrame, store: Store, checkpoint: str, extract: Extractor, most: int = 5, between: Callable[[], None] | None = None
) -> StreamingQuery:
    """Extraction of a stream of articles: all that is there now, in batches; run it again for what comes later."""
    each = lambda rows, n: run_batch(store, rows, f"s{n}", extract, most, between)
    return articles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry(store: Store, run: str, extract: Extractor, most: int = 5) -> None:
    """Asks again about what failed, without new articles; a run of the same name replaces the earlier one's answers."""
    nothing = store.spark.createDataFrame([], "id long, url string, title string, content string")
    run_batch(store, nothing, f"r{run}", extract, most)
