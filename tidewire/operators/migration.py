"""Copy of the store to a schema with its own ids (SNK-13): each table once, ids by joins, skipped rows counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.tables import first_wins, remap


def new_id(c: Column, namespace: str) -> Column:
    """A UUID-shaped id that follows from the old one, so that a task that runs again gives the same."""
    digest = F.md5(F.concat_ws(":", F.lit(namespace), c.cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def articles_to_copy(articles: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Flags become status words; of a url the first article counts, none if the target has it."""
    rows = first_wins(articles, "url", "seq")
    if target is not None:
        rows = rows.join(target.select("url"), "url", "left_anti")
    status = lambda flag, word: F.when(F.col(flag), word).otherwise("pending")
    signal = F.coalesce("is_high_signal", F.lit(False))
    return rows.withColumns({"classification_status": status("processed", "classified"), "extraction_status": status("extracted", "extracted"), "is_high_signal": signal}).drop("processed", "extracted")


def entities_to_copy(entities: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(entities under new ids, map of old to new); mentions of null or 0 become 1."""
    ids = entities.select(F.col("id").alias("old"), new_id(F.col("id"), namespace).alias("new"))
    mentions = F.coalesce(F.nullif("mention_count", F.lit(0)), F.lit(1))
    return entities.withColumns({"id": new_id(F.col("id"), namespace), "mention_count": mentions}), ids


def with_enrichment(entities: DataFrame, enrichment: DataFrame, ids: DataFrame) -> DataFrame:
    """Copied entities with enrichment_data and its status: the document (data, enriched_at, source) enriched last, `{}` if null."""
    last = enrichment.groupBy(F.col("entity_id").alias("old")).agg(F.max(F.struct("enriched_at", "source", "data")).alias("e"))
    rows = last.join(ids, "old").select(F.col("new").alias("id"), F.coalesce("e.data", F.lit("{}")).alias("enrichment_data"), F.col("e.enriched_at").alias("enriched_at"))
    out = entities.join(rows, "id", "left")
    return out.withColumn("enrichment_status", F.when(F.col("enrichment_data").isNotNull(), "enriched").otherwise("pending"))


def feeds_to_copy(stats: DataFrame, base: str) -> DataFrame:
    """Feeds by name with a placeholder url; their totals replace the target's (upsert by name)."""
    return stats.withColumns({"url": F.concat(F.lit(base), "feed_name"), "feed_type": F.lit("rss")}).withColumnRenamed("feed_name", "name")


def migrate(tables: dict[str, DataFrame], namespace: str) -> dict[str, DataFrame]:
    """articles, entities, relationships and enrichment for the new schema, and `skipped`: relationships that lack an end."""
    entities, ids = entities_to_copy(tables["entities"], namespace)
    relationships, skipped = remap(tables["relationships"], ids)
    return {
        "articles": articles_to_copy(tables["articles"]), "entities": with_enrichment(entities, tables["enrichment"], ids),
        "relationships": relationships, "skipped": skipped,
    }


def migration_record(copied: dict[str, DataFrame]) -> DataFrame:
    """(what, n): rows of each table, of skipped relationships, and of enriched entities."""
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, rows in copied.items()]
    enriched = copied["entities"].filter("enrichment_status = 'enriched'").agg(F.count("*").alias("n")).select(F.lit("enrichment").alias("what"), "n")
    out = enriched
    for rows in counts:
        out = out.unionByName(rows)
    return out
