"""Streaming forms of the incremental jobs (STR-01, STR-02, STR-03, STR-06)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.texts import classify


def unseen_articles(articles: DataFrame, time: str = "published", delay: str = "40 days") -> DataFrame:
    """STR-01: the first article of each url within the watermark."""
    return articles.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def classified(articles: DataFrame) -> DataFrame:
    """STR-02."""
    return articles.withColumn("c", classify(F.col("title"), F.col("content"))).select("*", "c.*").drop("c")


def daily_counts(events: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """STR-06: events by day and type."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, "1 day").alias("w"), "event_type").count().select(F.col("w.start").alias("day"), "event_type", F.col("count").alias("n"))


def feed_state(log: DataFrame) -> DataFrame:
    """STR-03: the state of `tables.feed_stats` kept across batches; within a batch rows go in order of (ts, seq)."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, ms, fails, articles, n = state.get if state.exists else (1.0, 0, 0, 0, 0)
        for x in pd.concat(list(parts)).sort_values(["ts", "seq"]).itertuples():
            rate, ms = 0.9 * rate + (0.1 if x.ok else 0.0), int(0.9 * ms + 0.1 * x.ms)
            fails, articles, n = (0 if x.ok else fails + 1), articles + int(x.articles), n + 1
        state.update((rate, ms, fails, articles, n))
        yield pd.DataFrame({"feed_id": [key[0]], "success_rate": [rate], "avg_ms": [ms], "failures": [fails], "total_articles": [articles], "fetches": [n]})

    fields = "success_rate double, avg_ms long, failures long, total_articles long, fetches long"
    return log.groupBy("feed_id").applyInPandasWithState(fold, "feed_id long, " + fields, fields, "update", GroupStateTimeout.NoTimeout)
