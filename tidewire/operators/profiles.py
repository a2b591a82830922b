"""What the graph says about one entity at a time, computed for all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions import names as N
from tidewire.operators.graph import newest_first, search, star

#: Executive roles in order of precedence, with the title each stands for.
TITLES = {"CEO_OF": "CEO", "CTO_OF": "CTO", "CFO_OF": "CFO", "FOUNDED": "Founder"}


def newest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The newest n rows of each key, with their `place`."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*newest_first()))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def company_facts(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """AGG-13: funding rounds and their distinct investors (of the newest 20), whether it acquires, openings (at most 20).

    Companies without any such relationship have no row; investors are sorted by name."""
    rows = relationships.filter(F.col("predicate").isin("FUNDED_BY", "ACQUIRED"))
    own = rows.select(F.col("subject_id").alias("entity_id"), "predicate", F.col("object_id").alias("other_id"), "event_date", "id")
    hires = relationships.filter("predicate = 'HIRED_BY'").select(F.col("object_id").alias("entity_id"), "predicate", F.lit(None).cast("long").alias("other_id"), "event_date", "id")
    place = F.row_number().over(W.partitionBy("entity_id", "predicate").orderBy(*newest_first()))
    kept = own.unionByName(hires).withColumn("place", place).filter("place <= 20")
    named = kept.join(entities.select(F.col("id").alias("other_id"), F.col("name").alias("other")), "other_id", "left")
    count = lambda p: F.count_if(F.col("predicate") == p)
    return named.groupBy("entity_id").agg(
        count("FUNDED_BY").alias("funding_rounds"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("predicate") == "FUNDED_BY", F.col("other")))), "; ").alias("investors"),
        F.when(count("ACQUIRED") > 0, "acquirer").alias("company_type"),
        (count("HIRED_BY") > 0).alias("is_hiring"),
        count("HIRED_BY").alias("job_openings"),
    )


def person_facts(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """AGG-14: employer by the latest hire, earlier employers (20 hires, 10 departures), and the title of the first
    executive role by precedence.  People without such relationships have no row."""
    wanted = {"HIRED_BY": 20, "DEPARTED_FROM": 10, **dict.fromkeys(TITLES, 1)}
    limits = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    place = F.row_number().over(W.partitionBy("subject_id", "predicate").orderBy(*newest_first()))
    rows = relationships.filter(F.col("predicate").isin(*wanted)).join(entities.select(F.col("id").alias("object_id"), F.col("name").alias("company")), "object_id")
    named = rows.withColumn("place", place).filter(F.col("place") <= limits[F.col("predicate")])
    before = (F.col("predicate") == "DEPARTED_FROM") | ((F.col("predicate") == "HIRED_BY") & (F.col("place") > 1))
    rank = F.array_position(F.array(*map(F.lit, TITLES)), F.col("predicate"))
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return named.groupBy(F.col("subject_id").alias("entity_id")).agg(
        F.max(F.when((F.col("predicate") == "HIRED_BY") & (F.col("place") == 1), F.col("company"))).alias("current_company"),
        F.array_join(F.sort_array(F.collect_set(F.when(before, F.col("company")))), "; ").alias("previous_companies"),
        F.min_by(titles[F.col("predicate")], F.when(rank > 0, rank)).alias("title"),
    )


def leaders(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """J-16: people with an executive role at a company that is no fund: the newest such company, and whether news tell of it."""
    roles = star(relationships.filter(F.col("predicate").isin(*TITLES, "EXECUTIVE_OF", "OFFICER_OF", "DIRECTOR_OF")), entities)
    rows = roles.filter((F.col("subject_type") == "person") & N.is_person_name(F.col("subject")) & ~N.is_fund(F.col("object")))
    news = F.coalesce((F.col("context") != "") & ~F.contains("context", F.lit("Form D")), F.lit(False))
    return newest(rows.withColumn("in_news", news), "subject_id", 1).select("subject_id", "subject", "predicate", F.col("object").alias("company"), "in_news")


def profile_events(relationships: DataFrame, most: int = 15) -> DataFrame:
    """W-15: the newest events of each entity at either end; a loop counts once, as subject."""
    own = relationships.select("id", F.col("subject_id").alias("entity_id"), F.col("object_id").alias("other_id"), F.lit("subject").alias("side"), "predicate", "event_date")
    other = relationships.filter("subject_id <> object_id").select("id", F.col("object_id").alias("entity_id"), F.col("subject_id").alias("other_id"), F.lit("object").alias("side"), "predicate", "event_date")
    return newest(own.unionByName(other), "entity_id", most)


def profile_sources(relationships: DataFrame, most: int = 10) -> DataFrame:
    """W-15: the first distinct sources of each entity, by the newest relationship that names them."""
    given = relationships.filter("source_url <> ''")
    ends = given.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"), "source_url", "event_date", "id")
    met = ends.groupBy("entity_id", "source_url").agg(F.max(F.struct(F.coalesce("event_date", F.lit("0001-01-01").cast("date")).alias("day"), "id")).alias("m"))
    place = F.row_number().over(W.partitionBy("entity_id").orderBy(F.col("m").desc()))
    return met.withColumn("place", place).filter(F.col("place") <= most).select("entity_id", "source_url", "place")


def overlay(documents: DataFrame) -> DataFrame:
    """SET-06: (entity_id, seq, data map) to one map for each entity; for a key the last document wins, with its null too."""
    pairs = documents.select("entity_id", "seq", F.explode("data").alias("key", "value"))
    last = pairs.groupBy("entity_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("data"))


def page(entities: DataFrame, number: int, size: int = 50, kind: str | None = None) -> DataFrame:
    """FLT-23: the page (from 1) of entities by mentions."""
    rows = entities if kind is None else entities.filter(F.col("entity_type") == kind)
    return rows.orderBy(F.desc("mention_count"), "id").offset((number - 1) * size).limit(size)


def page_counts(entities: DataFrame, size: int = 50) -> DataFrame:
    """FLT-23: pages of each type."""
    return entities.groupBy("entity_type").agg(F.ceil(F.count("*") / size).alias("pages"))


def hits_with_events(relationships: DataFrame, entities: DataFrame, part: str, hits: int = 10, most: int = 5) -> DataFrame:
    """JOB-10: the most mentioned entities whose name holds the part, each with its newest events as subject; without any, one row."""
    found = search(entities, part, limit=hits).select(F.col("id").alias("entity_id"), "name")
    rows = relationships.join(found.select(F.col("entity_id").alias("subject_id")), "subject_id", "left_semi")
    events = newest(rows, "subject_id", most).select(F.col("subject_id").alias("entity_id"), "id", "predicate", "event_date", "place")
    return found.join(events, "entity_id", "left")


def event_class(predicate: Column) -> Column:
    """FN-32: kind of event by a part of the predicate."""
    has = lambda x: F.contains(predicate, F.lit(x))
    return F.when(has("ACQUIRED"), "acquisition").when(has("FUNDED"), "funding").when(has("DEPARTED") | has("LAID"), "departure").otherwise("hire")


def event_amount(metadata: Column) -> Column:
    """FN-32: amount, else valuation, else count; empty ones do not count."""
    return F.coalesce(*[F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in ("amount", "valuation", "count")])


def source_label(url: Column) -> Column:
    """FN-29: first part of the host without `www.`, capitalised; null where there is no host."""
    host = F.regexp_replace(F.try_parse_url(F.nullif(url, F.lit("")), F.lit("HOST")), r"www\.", "")
    return F.initcap(F.split_part(host, F.lit("."), F.lit(1)))


def listing(relationships: DataFrame, entities: DataFrame, predicate: str, limit: int = 200) -> DataFrame:
    """JOB-09: the newest relationships of a predicate, with class and source label."""
    rows = star(relationships.filter(F.col("predicate") == predicate), entities).orderBy(*newest_first()).limit(limit)
    return rows.select("id", "subject", "predicate", "object", "event_date", event_class(F.col("predicate")).alias("event_class"), source_label(F.col("source_url")).alias("source_label"))
