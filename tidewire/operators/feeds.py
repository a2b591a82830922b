"""Feeds with their running state, and bounded searches over landed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.operators.tables import first_wins

PRIORITIES = {0: "high", 1: "medium", 2: "low"}


def with_stats(feeds: DataFrame, stats: DataFrame) -> DataFrame:
    """J-11: feeds with total_articles, failures, success_rate and last_ts; a feed without state has 0, 0, 1.0 and null."""
    rows = feeds.join(stats.select("feed_id", "total_articles", "failures", "success_rate", "last_ts"), "feed_id", "left")
    return rows.withColumns({"total_articles": F.coalesce("total_articles", F.lit(0)), "failures": F.coalesce("failures", F.lit(0)), "success_rate": F.coalesce("success_rate", F.lit(1.0))})


def with_status(feeds: DataFrame) -> DataFrame:
    """FN-33: status, band of the success rate and label of the priority of `with_stats` rows."""
    status = F.when(~F.col("enabled"), "disabled").when(F.col("failures") > 0, "warning").otherwise("ok")
    band = F.when(F.col("success_rate") >= 0.9, "high").when(F.col("success_rate") >= 0.7, "medium").otherwise("low")
    label = reduce(lambda c, x: c.when(F.col("priority") == x[0], x[1]), PRIORITIES.items(), F.when(F.lit(False), "")).otherwise("medium")
    return feeds.withColumns({"status": status, "rate_band": band, "priority_label": label})


def not_configured(suggested: DataFrame, feeds: DataFrame) -> DataFrame:
    """J-15: suggested feeds whose url is not configured yet."""
    return suggested.join(feeds.select("url").distinct(), "url", "left_anti")


def merged_searches(hits: DataFrame, n_queries: int, max_results: int) -> DataFrame:
    """SRC-08: hits (query_ord, place, url) of several searches: the first max_results // n_queries of each, then the first of each url."""
    rank = F.row_number().over(W.partitionBy("query_ord").orderBy("place"))
    kept = hits.withColumn("rank_", rank).filter(F.col("rank_") <= max_results // n_queries).drop("rank_")
    return first_wins(kept, "url", "query_ord", "place")


def historical(hits: DataFrame, start: str, end: str, max_results: int) -> DataFrame:
    """SRC-09: of the first max_results hits by place, those dated from start to end."""
    return hits.orderBy("place").limit(max_results).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def feed_counts(feeds: DataFrame) -> DataFrame:
    """AGG-16: all, active and disabled feeds; one that does not say so is active."""
    on = F.coalesce("enabled", F.lit(True))
    return feeds.agg(F.count("*").alias("total"), F.count_if(on).alias("active"), F.count_if(~on).alias("disabled"))
