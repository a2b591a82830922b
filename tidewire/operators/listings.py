"""Ad-hoc listings over the graph (JOB-10): statistics, acquisitions, entities, search, hires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.operators import graph
from tidewire.operators.tables import article_stats


def overview(relationships: DataFrame, entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(what, kind, n): the graph's totals by type and predicate, and the articles' counts."""
    counts = article_stats(articles).unpivot([], ["total", "processed", "high_signal"], "kind", "n")
    return graph.stats(relationships, entities).unionByName(counts.select(F.lit("articles").alias("what"), "kind", "n"))


def acquisitions(relationships: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """The newest acquisitions, confidence in whole per cent."""
    rows = graph.query(relationships, entities, predicate="ACQUIRED", limit=limit)
    return rows.select("id", "subject", "object", F.bround(F.col("confidence") * 100).cast("int").alias("per_cent"), "event_date", F.substr("source_url", F.lit(1), F.lit(50)).alias("source"))


def entity_listing(entities: DataFrame, part: str = "", kind: str | None = None, limit: int = 50) -> DataFrame:
    """Entities by mentions; the type is asked for among the 1000 that a search gives."""
    rows = graph.search(entities, part)
    rows = rows if kind is None else rows.filter(F.col("entity_type") == kind)
    return rows.orderBy(F.desc("mention_count"), "id").limit(limit).select("id", "entity_type", "name", "mention_count")


def hires(relationships: DataFrame, entities: DataFrame, company: str, limit: int = 20) -> DataFrame:
    """The newest people hired by companies whose name holds the words."""
    return graph.query(relationships, entities, predicate="HIRED_BY", obj=company, limit=limit).select("id", "subject", "event_date")


def search_listing(relationships: DataFrame, entities: DataFrame, part: str, hits: int = 10, most: int = 5) -> DataFrame:
    """The most mentioned entities whose name holds the part, each with the newest relationships whose subject's name holds
    the entity's name; one row of nulls for an entity without any.

    The hits (at most `hits` rows) go to the entities as one array, so names meet without a join on parts of them."""
    found = graph.search(entities, part, limit=hits).select(F.col("id").alias("hit_id"), F.col("name").alias("hit"), F.lower("name").alias("key"))
    asked = found.agg(F.collect_list(F.struct("hit_id", "key")).alias("asked"))
    met = entities.join(F.broadcast(asked), F.lit(True)).select(F.col("id").alias("subject_id"), F.explode(F.filter("asked", lambda h: F.contains(F.lower("name"), h["key"]))).alias("h"))
    rows = relationships.join(met.select("subject_id", "h.hit_id"), "subject_id")
    place = F.row_number().over(W.partitionBy("hit_id").orderBy(*graph.newest_first()))
    newest = rows.withColumn("place", place).filter(F.col("place") <= most)
    named = newest.join(entities.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id")
    return found.drop("key").join(named.select("hit_id", "id", "predicate", "object", "place"), "hit_id", "left")
