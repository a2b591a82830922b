"""Entity resolution over whole tables (JOB-02): what merges (keep, merge) do to entities, tags, enrichment and aliases."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions.constants import REMOVED_ENTITIES
from tidewire.functions.names import plain_key
from tidewire.operators import graph, matching


def removed(entities: DataFrame, deny: list[str] = REMOVED_ENTITIES) -> DataFrame:
    """Entities whose whole name is on the list."""
    return entities.filter(F.lower("name").isin(deny))


def without_removed(relationships: DataFrame, gone: DataFrame) -> DataFrame:
    """Relationships that have no end among the removed entities."""
    for end in ("subject_id", "object_id"):
        relationships = relationships.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return relationships


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Kept entities: mentions of those merged into them are added, and an unknown type becomes that of the
    most mentioned merged one (then the lower id) that has a type."""
    parts = merges.join(entities.select(F.col("id").alias("merge"), "entity_type", "mention_count"), "merge")
    known = F.when(F.col("entity_type") != "unknown", F.struct((-F.col("mention_count")).alias("n"), F.col("merge").alias("id")))
    sums = parts.groupBy(F.col("keep").alias("id")).agg(F.sum("mention_count").alias("more"), F.min_by("entity_type", known).alias("met_type"))
    rows = entities.join(merges.select(F.col("merge").alias("id")), "id", "left_anti").join(sums, "id", "left")
    kind = F.when(F.col("entity_type") == "unknown", F.coalesce("met_type", "entity_type")).otherwise(F.col("entity_type"))
    return rows.withColumns({"mention_count": F.col("mention_count") + F.coalesce("more", F.lit(0)), "entity_type": kind}).select(*entities.columns)


def in_turn(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """Merges with `turn`, which orders them as they are made: the more mentioned keeper first, then the more mentioned
    merged one, of equal mentions the lower id.  An entity that is missing has no mentions."""
    n = lambda end: entities.select(F.col("id").alias(end), (-F.col("mention_count")).alias(f"{end}_n"))
    rows = merges.select("keep", "merge").join(n("keep"), "keep", "left").join(n("merge"), "merge", "left")
    rank = lambda end: (F.coalesce(f"{end}_n", F.lit(0)).cast("long").alias(f"{end}_n"), F.col(end).alias(f"{end}_id"))
    return rows.select("keep", "merge", F.struct(*rank("keep"), *rank("merge")).alias("turn"))


def moved(rows: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Tags (key tag) or enrichment (key source) of merged entities under the kept one.

    turns: merges in turn.  Where keys clash the kept one's own row stays, else that of the entity merged first;
    none has two."""
    both = rows.join(turns.select(F.col("merge").alias("entity_id"), "keep", "turn"), "entity_id", "left")
    near = W.partitionBy(F.coalesce("keep", "entity_id"), *keys).orderBy(F.col("keep").isNotNull(), "turn")
    both = both.withColumn("n_", F.row_number().over(near)).filter("n_ = 1")
    return both.withColumn("entity_id", F.coalesce("keep", "entity_id")).select(*rows.columns)


def merge_aliases(entities: DataFrame, turns: DataFrame) -> DataFrame:
    """The names of merged entities as aliases of the kept ones, once for each normalized alias, as the first merged one spells it."""
    rows = turns.join(entities.select(F.col("id").alias("merge"), "name"), "merge").withColumn("normalized_alias", plain_key(F.col("name")))
    return rows.groupBy(F.col("keep").alias("entity_id"), "normalized_alias").agg(F.min_by("name", "turn").alias("alias"))


def repointed(relationships: DataFrame, turns: DataFrame) -> DataFrame:
    """Relationships with both ends of merged entities re-pointed, as merging in turn would leave them.

    Of dated ones that become equal the one that got there first stays: its last end to move moved in an earlier turn,
    else its other end did, else its id is lower.  Undated ones and those between an entity and itself all stay."""
    for end in ("subject_id", "object_id"):
        to = turns.select(F.col("merge").alias(end), F.col("keep").alias("to_"), F.col("turn").alias(f"{end}_turn"))
        relationships = relationships.join(to, end, "left").withColumn(end, F.coalesce("to_", end)).drop("to_")
    s, o = F.col("subject_id_turn"), F.col("object_id_turn")
    late = F.greatest(s, o)
    early = F.when(s.isNotNull() & o.isNotNull(), F.least(s, o))
    key = W.partitionBy("subject_id", "predicate", "object_id", "event_date").orderBy(late.asc_nulls_first(), early.asc_nulls_first(), "id")
    rows = relationships.withColumn("n_", F.when(F.col("event_date").isNull(), 1).otherwise(F.row_number().over(key)))
    return rows.filter("n_ = 1").drop("n_", "subject_id_turn", "object_id_turn")


class Tables(NamedTuple):
    """entities (id, name, entity_type, mention_count), relationships (id, subject_id, predicate, object_id, event_date and more),
    tags (entity_id, tag), enrichment (entity_id, source and more), aliases (entity_id, normalized_alias, alias)."""

    entities: DataFrame
    relationships: DataFrame
    tags: DataFrame
    enrichment: DataFrame
    aliases: DataFrame


def resolve(tables: Tables, deny: list[str] = REMOVED_ENTITIES, threshold: float = 0.85) -> tuple[Tables, DataFrame]:
    """JOB-02: all tables after removals, type fixes and merges, and one row of counts (AGG-18).

    Entities on the list go with their relationships; unknown types are inferred from what is left; similar names of
    fitting types merge greedily, and each table is re-pointed once, in the order of the merges.  Tags and enrichment
    of removed entities stay, as do aliases that merged entities had themselves.  Empty tables stay empty."""
    gone = removed(tables.entities, deny)
    entities = tables.entities.join(gone.select("id"), "id", "left_anti").select(*tables.entities.columns)
    relationships = without_removed(tables.relationships, gone).select(*tables.relationships.columns)
    inferred = graph.infer_types(relationships, entities).filter("entity_type <> 'unknown'").select(F.col("entity_id").alias("id"), F.col("entity_type").alias("new_type"))
    entities = entities.join(inferred, "id", "left").withColumn("entity_type", F.coalesce("new_type", "entity_type")).select(*tables.entities.columns)
    entities = matching.kept(entities)
    turns = matching.kept(in_turn(matching.merges(entities, threshold), entities))
    have = tables.aliases.select("entity_id", "normalized_alias")
    aliases = merge_aliases(entities, turns).join(have, ["entity_id", "normalized_alias"], "left_anti")
    after = Tables(
        merged_entities(entities, turns),
        repointed(relationships, turns),
        moved(tables.tags, turns, ["tag"]),
        moved(tables.enrichment, turns, ["source"]),
        tables.aliases.unionByName(aliases.select(*tables.aliases.columns)),
    )
    return after, summary(gone, inferred.withColumnRenamed("new_type", "entity_type"), matching.count_duplicates(entities, threshold), turns)


def summary(gone: DataFrame, inferred: DataFrame, found: DataFrame, merges: DataFrame) -> DataFrame:
    """AGG-18: one row of counts of the steps' outputs; `inferred` is the result of `graph.infer_types`, `found` a row with `duplicates_found`."""
    steps = {"invalid_removed": gone, "types_fixed": inferred.filter("entity_type <> 'unknown'"), "duplicates_merged": merges}
    counted = None
    for name, rows in steps.items():
        one = rows.select(F.lit(name).alias("step"))
        counted = one if counted is None else counted.unionByName(one)
    counts = counted.agg(*(F.count_if(F.col("step") == name).alias(name) for name in steps)).crossJoin(found)
    return counts.select("invalid_removed", "types_fixed", "duplicates_found", "duplicates_merged")
