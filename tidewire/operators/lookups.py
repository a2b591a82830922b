"""Lookups in bulk form: the wanted keys come as rows, and one join answers all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions.constants import KNOWN_ALIASES, MISLABELLED_PATTERN
from tidewire.functions.names import clean_filing_name, is_organisation, plain_key, relationship_reason
from tidewire.operators.tables import first_wins


def high_signal(articles: DataFrame, since: str | None = None, limit: int = 100) -> DataFrame:
    """FLT-03: the newest high-signal articles; with `since`, undated ones go."""
    rows = articles.filter("is_high_signal")
    if since is not None:
        rows = rows.filter(F.col("published") >= F.lit(since).cast("date"))
    return rows.orderBy(F.col("published").desc_nulls_last(), "id").limit(limit)


def articles_at(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """FLT-04: the first article of each wanted url."""
    return first_wins(articles.join(urls.select("url").distinct(), "url", "left_semi"), "url", "id")


def known_hashes(hashes: DataFrame, articles: DataFrame) -> DataFrame:
    """FLT-04: each wanted content hash and whether an article has it."""
    have = articles.select("content_hash").distinct().withColumn("met", F.lit(True))
    return hashes.select("content_hash").distinct().join(have, "content_hash", "left").select("content_hash", F.coalesce("met", F.lit(False)).alias("known"))


def entities_named(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT-05: for each wanted (name, entity_type; a null type fits all) the entity of the lowest id, if any."""
    asked = wanted.select("name", "entity_type").distinct().select(F.struct("name", "entity_type").alias("asked"), plain_key(F.col("name")).alias("key"))
    rows = asked.join(entities.withColumn("key", plain_key(F.col("name"))), "key")
    rows = rows.filter(F.col("asked.entity_type").isNull() | (F.col("asked.entity_type") == F.col("entity_type")))
    return rows.groupBy("asked").agg(F.min_by(F.struct("id", "name", "entity_type"), "id").alias("e")).select(F.col("asked.name").alias("asked_name"), F.col("asked.entity_type").alias("asked_type"), "e.*")


def valid_relationships(rows: DataFrame) -> DataFrame:
    """FLT-11: relationships whose names pass the rules."""
    return rows.filter(relationship_reason(F.col("subject"), F.col("predicate"), F.col("object")) == "OK")


def person_fixes(entities: DataFrame) -> DataFrame:
    """FLT-18, FN-34: people whose names look like firms or placeholders, where a cleaned name or the type changes."""
    rows = entities.filter((F.col("entity_type") == "person") & F.col("name").rlike(MISLABELLED_PATTERN)).withColumn("new_name", clean_filing_name(F.col("name")))
    rows = rows.withColumn("new_type", F.when(is_organisation(F.col("new_name")), "company").otherwise("person"))
    return rows.filter("new_name <> name OR new_type <> 'person'").select("id", "name", "new_name", "new_type")


def fix_counts(fixes: DataFrame) -> DataFrame:
    """FN-34, dry run: how many names and types would change."""
    return fixes.agg(F.count_if(F.col("new_name") != F.col("name")).alias("fixed_names"), F.count_if(F.col("new_type") != "person").alias("fixed_types"))


def tagged(entities: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT-19: entities of each wanted tag; `place` orders those of a tag by mentions, then id."""
    asked = wanted.select(plain_key(F.col("tag")).alias("tag")).distinct()
    rows = tags.join(asked, "tag").join(entities.withColumnRenamed("id", "entity_id"), "entity_id")
    place = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("mention_count"), "entity_id"))
    return rows.select("tag", "entity_id", "name", "mention_count", place.alias("place"))


def gathered(rows: DataFrame, value: str, out: str) -> DataFrame:
    """FLT-20, FLT-22: the distinct values (tags, aliases) of each entity, in order, joined by `; `."""
    return rows.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(value)), "; ").alias(out))


def enrichment_of(enrichment: DataFrame, wanted: DataFrame, source: str | None = None) -> DataFrame:
    """FLT-21: enrichment rows of the wanted entities, of one source or of all."""
    rows = enrichment if source is None else enrichment.filter(F.col("source") == source)
    return rows.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")


def add_aliases(entities: DataFrame, aliases: DataFrame, news: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-11: (entities to create, aliases to add) for news (canonical, alias, entity_type).

    A new entity has no id yet: its alias carries its normalized name and type, as the entity itself does.
    Aliases (normalized_name, entity_type, alias, normalized_alias) that an entity has already are left out."""
    keys = ["normalized_name", "entity_type"]
    asked = news.withColumns({"normalized_name": plain_key(F.col("canonical")), "normalized_alias": plain_key(F.col("alias"))})
    have = entities.select(plain_key(F.col("name")).alias("normalized_name"), "entity_type").distinct()
    made = asked.join(have, keys, "left_anti").groupBy(*keys).agg(F.min("canonical").alias("name"))
    added = asked.groupBy(*keys, "normalized_alias").agg(F.min("alias").alias("alias"))
    return made, added.join(aliases.select(*keys, "normalized_alias"), [*keys, "normalized_alias"], "left_anti")


def resolve_aliases(names: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """J-09: names (name, entity_type) with `resolved`: the built-in canonical name, else the entity of an alias of that type, else the name."""
    fixed = [x for canonical, others in KNOWN_ALIASES.items() for other in (canonical, *others) for x in (F.lit(other), F.lit(canonical))]
    own = aliases.join(entities.select(F.col("id").alias("entity_id"), F.col("name").alias("owner"), "entity_type"), "entity_id")
    own = own.groupBy(F.col("normalized_alias").alias("key"), "entity_type").agg(F.min_by("owner", "entity_id").alias("owner"))
    rows = names.withColumn("key", plain_key(F.col("name"))).join(own, ["key", "entity_type"], "left")
    return rows.withColumn("resolved", F.coalesce(F.try_element_at(F.create_map(*fixed), F.col("key")), "owner", "name")).drop("key", "owner")
