"""Source quality: tiers by domain, and the confidence of entities and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.constants import DEFAULT_SOURCE, SOURCE_TIERS
from tidewire.operators.graph import ends


def tier_table(spark: SparkSession, tiers=SOURCE_TIERS) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(tiers)], "ord int, source string, domain string, tier int, base double")


def with_source(rows: DataFrame, tiers: DataFrame, url: str = "source_url") -> DataFrame:
    """J-07: the exact domain's source, else the first whose domain the host ends with, else the default.

    Every distinct host is matched once; the tiers are a fixed small table."""
    host = F.regexp_replace(F.lower(F.split_part(F.col(url), F.lit("/"), F.lit(3))), r"^www\.", "")
    hosts = rows.select(host.alias("host_")).distinct()
    fits = F.col("host_").endswith(F.col("domain")) & (F.col("host_") != "")
    exact = F.when(F.col("host_") == F.col("domain"), -1).otherwise(F.col("ord"))
    met = hosts.join(F.broadcast(tiers), fits, "left").groupBy("host_").agg(F.min_by(F.struct("source", "tier", "base"), exact).alias("s"))
    out = rows.withColumn("host_", host).join(met, "host_", "left")
    name, _, tier, base = DEFAULT_SOURCE
    return out.select(*rows.columns, F.coalesce("s.source", F.lit(name)).alias("source"), F.coalesce("s.tier", F.lit(tier)).alias("tier"), F.coalesce("s.base", F.lit(base)).alias("base"))


def tier_report(relationships: DataFrame, tiers: DataFrame) -> DataFrame:
    """AGG-05, AGG-07: relationships by source, and the quality score of all."""
    by_source = with_source(relationships, tiers).groupBy("source", "tier").agg(F.count("*").alias("n"))
    points = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.7).otherwise(0.4)
    score = by_source.agg(F.round(100 * F.sum(points * F.col("n")) / F.sum("n"), 1).alias("quality"))
    return by_source.crossJoin(F.broadcast(score))  # one row


def entity_confidence(relationships: DataFrame, entities: DataFrame, tiers: DataFrame) -> DataFrame:
    """AGG-09: over an entity's distinct URLs; without a source 0.5."""
    urls = with_source(ends(relationships).select("entity_id", "source_url").distinct(), tiers)
    t = lambda k: F.count_if(F.col("tier") == k)
    found = urls.groupBy("entity_id").agg(F.count("*").alias("n_sources"), F.max("base").alias("base"), t(1).alias("tier1"), t(2).alias("tier2"), t(3).alias("tier3"))
    out = entities.select(F.col("id").alias("entity_id")).join(found, "entity_id", "left")
    whole = F.least(F.lit(1.0), F.col("base") + F.least(F.lit(0.15), 0.03 * F.col("n_sources")) + F.least(F.lit(0.10), 0.05 * F.col("tier1")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "tier1", "tier2", "tier3")]
    return out.select("entity_id", F.coalesce(whole, F.lit(0.5)).alias("confidence"), *counts)


def relationship_confidence(relationships: DataFrame, tiers: DataFrame) -> DataFrame:
    """AGG-10."""
    given = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.8))
    return with_source(relationships, tiers).select("id", F.round(given * F.col("base"), 2).alias("confidence"))


def validation_report(relationships: DataFrame, entities: DataFrame, enrichment: DataFrame, tiers: DataFrame) -> DataFrame:
    """AGG-08: one row: entities and how many are enriched, entities of several sources, relationships by source and tier,
    and the quality score, 0 without relationships.  Relationships without a source URL (null) do not count."""
    sourced = relationships.filter(F.col("source_url").isNotNull())
    by_source = with_source(sourced, tiers).groupBy("source", "tier").agg(F.count("*").alias("n"))
    several = ends(sourced).groupBy("entity_id").agg(F.countDistinct("source_url").alias("n")).filter("n > 1")
    several = several.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    kinds = {
        "entity": entities.agg(F.count("*").alias("n")),
        "enriched": enrichment.agg(F.countDistinct("entity_id").alias("n")),
        "several": several.agg(F.count("*").alias("n")),
    }
    rows = by_source.select(F.lit("source").alias("what"), "source", "tier", "n")
    for what, one in kinds.items():
        rows = rows.unionByName(one.select(F.lit(what).alias("what"), "n"), allowMissingColumns=True)
    n = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    of = lambda what: n(F.col("what") == what)
    out = rows.groupBy("what", "source").agg(F.sum("n").alias("n"), *(n(F.col("tier") == k).alias(f"t{k}") for k in (1, 2, 3)))
    pairs = F.collect_list(F.when(F.col("what") == "source", F.struct("source", "n")))
    out = out.agg(of("entity").alias("total_entities"), of("enriched").alias("enriched_entities"), of("several").alias("multi_source_entities"), F.map_from_entries(F.sort_array(pairs)).alias("source_distribution"), *(F.sum(f"t{k}").alias(f"t{k}") for k in (1, 2, 3)))
    total = F.col("t1") + F.col("t2") + F.col("t3")
    score = F.when(total > 0, F.round((F.col("t1") * 1.0 + F.col("t2") * 0.7 + F.col("t3") * 0.4) / total * 100, 1)).otherwise(0.0)
    share = F.when(F.col("total_entities") > 0, F.round(F.col("enriched_entities") / F.col("total_entities") * 100, 1)).otherwise(0.0)
    return out.select(
        "total_entities", "enriched_entities", share.alias("enrichment_coverage"), "multi_source_entities", "source_distribution",
        F.col("t1").alias("tier1_primary"), F.col("t2").alias("tier2_reputable"), F.col("t3").alias("tier3_secondary"), score.alias("data_quality_score"),
    )
