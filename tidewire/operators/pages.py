"""Pages as nested data (JOB-07, JOB-08, W-13): what a page shows, in its order, without its looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.operators.graph import newest_first, query, search, star
from tidewire.operators.profiles import event_amount, event_class, source_label

PANELS = ("ACQUIRED", "FUNDED_BY", "HIRED_BY", "DEPARTED_FROM")


def event(rows: DataFrame) -> Column:
    """One event as a page shows it; the amount is null where the rows have no metadata."""
    amount = event_amount(F.col("metadata")) if "metadata" in rows.columns else F.lit(None).cast("string")
    kind, label = event_class(F.col("predicate")), source_label(F.col("source_url"))
    return F.struct("id", "subject", "predicate", "object", "event_date", kind.alias("event_class"), label.alias("source_label"), amount.alias("amount"))


def in_order(value: Column, place: str = "place") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place, value.alias("value")))), lambda x: x["value"])


def placed(rows: DataFrame) -> DataFrame:
    """Rows of one page (a few hundred at most) with their place, newest first."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(*newest_first())))


def timeline_page(relationships: DataFrame, entities: DataFrame, as_of: str, days: int = 30, predicate: str | None = None, limit: int = 200) -> DataFrame:
    """W-13, JOB-08: (day, n, events) of the newest events of the last days; undated ones are in, on the day of asking."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    rows = relationships if predicate is None else relationships.filter(F.col("predicate") == predicate)
    rows = rows.filter(F.col("event_date").isNull() | (F.col("event_date") >= since))
    rows = placed(star(rows, entities).orderBy(*newest_first()).limit(limit))
    day = F.coalesce("event_date", F.lit(as_of).cast("date"))
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"), in_order(event(rows)).alias("events"))


def search_page(
    relationships: DataFrame, entities: DataFrame, as_of: str, part: str = "", kind: str | None = None, predicate: str | None = None, days: int = 90
) -> DataFrame:
    """JOB-08: one row: how many entities fit (1000 at most), the first 50, and the events found by subject, then by object alone.

    Without a part and a type no entity is asked for; without a part all events of the last days are."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    recent = relationships.filter(F.col("event_date").isNull() | (F.col("event_date") >= since))
    asked = search(entities, part, kind) if part or kind else entities.limit(0)
    ranked = asked.withColumn("place", F.row_number().over(W.orderBy(F.desc("mention_count"), "id")))
    first = F.when(F.col("place") <= 50, F.struct("place", F.struct("id", "name", "entity_type", "mention_count").alias("value")))
    found = ranked.agg(F.count("*").alias("n_entities"), F.transform(F.array_sort(F.collect_list(first)), lambda x: x["value"]).alias("entities"))
    rows = placed(query(recent, entities, subject=part or None, predicate=predicate)).withColumn("side", F.lit(0))
    if part:
        rows = rows.unionByName(placed(query(recent, entities, obj=part, predicate=predicate)).withColumn("side", F.lit(1)))
    once = rows.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("side"))).filter("k = 1")
    events = once.withColumn("at", F.struct("side", "place"))
    shown = events.agg(F.count("*").alias("n_events"), in_order(event(rows), "at").alias("events"))
    # one row each
    return found.withColumn("one", F.lit(1)).join(shown.withColumn("one", F.lit(1)), "one").drop("one")


def dashboard(articles: DataFrame, relationships: DataFrame, entities: DataFrame, enrichment: DataFrame, most: int = 5) -> DataFrame:
    """JOB-07: (panel, n, events): counts of each table and type, and the newest events of four kinds with their numbers."""
    tables = {
        "articles": articles,
        "high-signal articles": articles.filter("is_high_signal"),
        "entities": entities,
        "relationships": relationships,
        "enriched entities": enrichment.select("entity_id").distinct(),
    }
    totals = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("panel"), "n")
        totals = one if totals is None else totals.unionByName(one)
    totals = totals.unionByName(entities.groupBy(F.concat(F.lit("type "), "entity_type").alias("panel")).agg(F.count("*").alias("n")))
    own = relationships.filter(F.col("predicate").isin(*PANELS))
    n = own.groupBy(F.col("predicate").alias("panel")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("predicate").orderBy(*newest_first()))
    newest = star(own, entities).withColumn("place", place).filter(F.col("place") <= most)
    shown = newest.groupBy(F.col("predicate").alias("panel")).agg(in_order(event(newest)).alias("events"))
    return totals.unionByName(n.join(shown, "panel", "left"), allowMissingColumns=True)
