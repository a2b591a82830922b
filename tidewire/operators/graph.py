"""Reading the graph: star join, filters, OR joins, counts and windows over entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def newest_first(*ties: str) -> list[Column]:
    return [F.col("event_date").desc_nulls_last(), *(F.col(t).desc() for t in ties or ("id",))]


def star(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """J-01: relationships with the names and types of both ends."""
    ends = entities.select("id", "name", "entity_type")
    s = ends.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"), F.col("entity_type").alias("subject_type"))
    o = ends.select(F.col("id").alias("object_id"), F.col("name").alias("object"), F.col("entity_type").alias("object_type"))
    return relationships.join(s, "subject_id").join(o, "object_id")


def query(relationships: DataFrame, entities: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, since=None, limit: int | None = 100) -> DataFrame:
    """FLT-07: each condition is optional; undated rows pass `since`; newest first, undated last."""
    if predicate:
        relationships = relationships.filter(F.col("predicate") == predicate)
    if since:
        relationships = relationships.filter(F.col("event_date").isNull() | (F.col("event_date") >= F.lit(since).cast("date")))
    rows = star(relationships, entities)
    for column, part in (("subject", subject), ("object", obj)):
        if part:
            rows = rows.filter(F.lower(column).contains(part.lower()))
    rows = rows.orderBy(*newest_first())
    return rows.limit(limit) if limit else rows


def search(entities: DataFrame, part: str, kind: str | None = None, limit: int = 1000) -> DataFrame:
    """FLT-06: entities whose name holds the part, most mentioned first."""
    rows = entities.filter(F.lower("name").contains(part.lower().strip()))
    rows = rows.filter(F.col("entity_type") == kind) if kind else rows
    return rows.orderBy(F.desc("mention_count"), "id").limit(limit)


def search_both_ends(relationships: DataFrame, entities: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """SET-01: relationships found by subject, then those found by object only."""
    s = query(relationships, entities, subject=part, limit=limit).withColumn("side", F.lit(0))
    o = query(relationships, entities, obj=part, limit=limit).withColumn("side", F.lit(1))
    first = W.partitionBy("id").orderBy("side")
    return s.unionByName(o).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def ends(relationships: DataFrame) -> DataFrame:
    """Each relationship once per distinct end, as entity_id; the equi-join form of an OR join."""
    return relationships.withColumn("entity_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))))


def company_signals(relationships: DataFrame, entities: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """J-03, AGG-04: for each company, distinct events of the last days by kind and role, and the last date."""
    recent = ends(relationships.filter(F.col("event_date") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    rows = entities.filter("entity_type = 'company'").select(F.col("id").alias("entity_id"), "name").join(recent, "entity_id", "left")
    of = lambda p, end: F.countDistinct(F.when((F.col("predicate") == p) & (F.col(end) == F.col("entity_id")), F.col("id")))
    return rows.groupBy("entity_id", "name").agg(
        of("FUNDED_BY", "subject_id").alias("fundings"), of("ACQUIRED", "subject_id").alias("acquisitions"), of("ACQUIRED", "object_id").alias("acquired"),
        of("HIRED_BY", "object_id").alias("hires"), of("DEPARTED_FROM", "object_id").alias("departures"), of("LAID_OFF", "subject_id").alias("layoffs"), F.max("event_date").alias("last_date"),
    )


def multi_source(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """J-04: entities met in more than one source URL."""
    rows = ends(relationships).groupBy("entity_id").agg(F.countDistinct("source_url").alias("n_sources")).filter("n_sources > 1")
    return entities.select(F.col("id").alias("entity_id"), "name").join(rows, "entity_id")


def recent_events(events: DataFrame, entities: DataFrame, least: float = 0.7) -> DataFrame:
    """J-02: confident events that are their own canonical event, with the names of their ends, where known; newest first."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    o = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    rows = events.filter((F.col("confidence") >= least) & F.col("canonical_event_id").isNull())
    return rows.join(s, "subject_id", "left").join(o, "object_id", "left").orderBy(*newest_first())


def stats(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """AGG-02: (what, kind, n) of totals, entity types and predicates."""
    e = entities.rollup("entity_type").agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), F.coalesce("entity_type", F.lit("all")).alias("kind"), "n")
    r = relationships.rollup("predicate").agg(F.count("*").alias("n")).select(F.lit("relationships").alias("what"), F.coalesce("predicate", F.lit("all")).alias("kind"), "n")
    return e.unionByName(r)


def latest_per_predicate(relationships: DataFrame, n: int = 5) -> DataFrame:
    """W-12."""
    place = F.row_number().over(W.partitionBy("predicate").orderBy(*newest_first()))
    return relationships.withColumn("place", place).filter(F.col("place") <= n)


def career(relationships: DataFrame, entities: DataFrame, limit: int = 100) -> DataFrame:
    """W-11: each person's hires and departures, newest first, at most `limit` of either."""
    place = F.row_number().over(W.partitionBy("subject_id", "predicate").orderBy(*newest_first()))
    rows = relationships.filter(F.col("predicate").isin("HIRED_BY", "DEPARTED_FROM")).withColumn("k", place).filter(F.col("k") <= limit).drop("k")
    return star(rows, entities).withColumn("place", F.row_number().over(W.partitionBy("subject_id").orderBy(*newest_first())))


def timeline(relationships: DataFrame, as_of: str, since: str, limit: int = 200) -> DataFrame:
    """W-13: the latest events by day, an undated one on the day of asking."""
    day = F.coalesce("event_date", F.lit(as_of).cast("date"))
    rows = relationships.filter(F.col("event_date").isNull() | (F.col("event_date") >= F.lit(since).cast("date"))).orderBy(*newest_first()).limit(limit)
    kind = F.when(F.col("predicate").isin("FUNDED_BY", "RAISED_FUNDING"), "funding").when(F.col("predicate") == "ACQUIRED", "acquisition")
    kind = kind.when(F.col("predicate").isin("HIRED_BY", "DEPARTED_FROM"), "move").when(F.col("predicate") == "LAID_OFF", "layoff").otherwise("other")
    rows = rows.select(day.alias("day"), kind.alias("kind"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("funding", "acquisition", "move", "layoff", "other")))


def infer_types(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """AGG-11: a type for unknown entities from five counts; a person's roles win over a company's."""
    unknown = entities.filter("entity_type = 'unknown'").select(F.col("id").alias("entity_id"), "name")
    side = lambda end, mark: relationships.select(F.col(end).alias("entity_id"), F.concat(F.lit(mark), "predicate").alias("role"))
    roles = side("subject_id", "s:").unionByName(side("object_id", "o:"))
    counts = unknown.join(roles, "entity_id", "left").groupBy("entity_id", "name").agg(
        F.count_if(F.col("role").isin("s:CEO_OF", "s:CTO_OF", "s:CFO_OF", "s:FOUNDED")).alias("exec_role"),
        F.count_if(F.col("role") == "s:HIRED_BY").alias("hired"),
        F.count_if(F.col("role") == "s:FUNDED_BY").alias("funded"),
        F.count_if(F.col("role") == "o:HIRED_BY").alias("hiring"),
        F.count_if(F.col("role") == "s:ACQUIRED").alias("acquiring"),
    )
    person, company = F.col("exec_role") + F.col("hired") > 0, F.col("funded") + F.col("hiring") + F.col("acquiring") > 0
    return counts.withColumn("entity_type", F.when(person, "person").when(company, "company").otherwise("unknown"))
