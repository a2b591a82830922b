"""Sections of the periodic digest (W-06..W-10, AGG-20, SNK-16).  Limits are part of each section."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions.constants import DIGEST_SECTIONS
from tidewire.functions.names import digest_key, is_digest_company, plain_key, sanitize_name
from tidewire.functions.texts import amount_text, layoff_count
from tidewire.operators.graph import newest_first, query, star


def latest(relationships: DataFrame, entities: DataFrame, predicates: list[str], n: int) -> DataFrame:
    """The newest n of each predicate; `place` numbers them in the order of the predicates, then newest first."""
    top = None
    for k, p in enumerate(predicates):
        rows = relationships.filter(F.col("predicate") == p).orderBy(*newest_first()).limit(n).withColumn("branch", F.lit(k))
        top = rows if top is None else top.unionByName(rows)
    return star(top, entities).withColumn("place", F.row_number().over(W.orderBy("branch", *newest_first())))  # at most n of each


def first_of(rows: DataFrame, keys: list, n: int) -> DataFrame:
    """The first row of each key by place, and of these the first n."""
    once = rows.withColumn("k_", F.row_number().over(W.partitionBy(*keys).orderBy("place"))).filter("k_ = 1").drop("k_")
    return once.orderBy("place").limit(n)


def fundings(relationships: DataFrame, entities: DataFrame, start: str, end: str, n: int = 20) -> DataFrame:
    """W-06: the first funding of each company, newest news before newest filings, then by date, undated ones last."""
    rows = latest(relationships, entities, ["FUNDED_BY", "RAISED_FUNDING"], 2 * n).withColumn("company", sanitize_name(F.col("subject")))
    dated = F.col("event_date").isNull() | F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = rows.filter(is_digest_company(F.col("company")) & dated)
    source = F.when(F.col("context").contains("Form D"), "SEC").otherwise("News")
    top = first_of(rows, ["company"], n).orderBy(F.col("event_date").desc_nulls_last(), "place")
    return top.select("company", F.col("object").alias("investor"), amount_text(F.col("context")).alias("amount"), F.col("event_date").alias("date"), source.alias("source"))


def acquisitions(relationships: DataFrame, entities: DataFrame, n: int = 15) -> DataFrame:
    """W-07: the newest acquisition of each pair of companies."""
    rows = latest(relationships, entities, ["ACQUIRED"], 3 * n)
    keys = [digest_key(F.col("subject")), digest_key(F.col("object"))]
    return first_of(rows, keys, n).select("subject", "object", F.col("event_date").alias("date"))


def layoffs(relationships: DataFrame, entities: DataFrame, n: int = 15) -> DataFrame:
    """W-08: the newest layoff of each company, by its plain name."""
    rows = latest(relationships, entities, ["LAID_OFF"], 3 * n)
    first = first_of(rows, [plain_key(F.col("subject"))], n)
    return first.select(F.col("subject").alias("company"), layoff_count(F.col("context")).alias("count"), F.col("event_date").alias("date"))


def moves(relationships: DataFrame, entities: DataFrame, n: int = 20) -> DataFrame:
    """W-09: departures, then hires, the newest of each person, action and company by plain names."""
    rows = latest(relationships, entities, ["DEPARTED_FROM", "HIRED_BY"], 2 * n)
    rows = rows.withColumn("action", F.when(F.col("predicate") == "DEPARTED_FROM", "left").otherwise("joined"))
    first = first_of(rows, [plain_key(F.col("subject")), "action", plain_key(F.col("object"))], n)
    return first.select(F.col("subject").alias("person"), "action", F.col("object").alias("company"), F.col("event_date").alias("date"))


def hot_candidates(relationships: DataFrame, entities: DataFrame, n: int = 15) -> DataFrame:
    """W-10: people who left lately, by plain name; those with an executive role come first.

    The role is the first one among the newest ten relationships of all subjects whose name holds the person's name."""
    rows = first_of(latest(relationships, entities, ["DEPARTED_FROM"], 50), [plain_key(F.col("subject"))], 50)
    asked = rows.select("place", F.lower("subject").alias("part"))  # 50 rows at most
    named = entities.select(F.col("id").alias("subject_id"), plain_key(F.col("name")).alias("key"))
    same = named.join(F.broadcast(asked), F.contains("key", F.col("part"))).select("place", "subject_id")
    known = relationships.join(entities.select(F.col("id").alias("object_id")), "object_id", "left_semi")
    ten = known.join(same, "subject_id").withColumn("k", F.row_number().over(W.partitionBy("place").orderBy(*newest_first()))).filter("k <= 10")
    role = ten.filter(F.col("predicate").isin("CEO_OF", "CTO_OF", "CFO_OF", "FOUNDED")).groupBy("place").agg(F.min_by("predicate", "k").alias("role"))
    title = F.initcap(F.replace(F.replace("role", F.lit("_OF"), F.lit("")), F.lit("_"), F.lit(" ")))
    rows = rows.join(role, "place", "left").withColumn("score", F.when(F.col("role").isNotNull(), 90).otherwise(70))
    best = rows.orderBy(F.desc("score"), "place").limit(n)
    return best.select(F.col("subject").alias("person"), F.col("object").alias("left_company"), F.coalesce(title, F.lit("Executive")).alias("title"), "score")


def who_hired(relationships: DataFrame, entities: DataFrame, company: str, since: str | None = None, limit: int = 100) -> DataFrame:
    """FLT-08: hires of companies whose name holds the given one, newest first."""
    return query(relationships, entities, predicate="HIRED_BY", obj=company, since=since, limit=limit)


def where_went(relationships: DataFrame, entities: DataFrame, person: str, limit: int = 100) -> DataFrame:
    """FLT-08: hires of people whose name holds the given one, newest first."""
    return query(relationships, entities, predicate="HIRED_BY", subject=person, limit=limit)


def lines_of(kind: str, relationships: DataFrame, entities: DataFrame, start: str, end: str) -> DataFrame:
    """(place, line): the items of a section in order, each as a Markdown line."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    bold = lambda c: F.concat(F.lit("- **"), c, F.lit("**"))
    opt = lambda on, *parts: F.when(on, F.concat(*parts)).otherwise("")
    if kind == "funding":
        rows = fundings(relationships, entities, start, end)
        investor = some("investor") & (F.col("investor") != "Undisclosed Investors")
        line = F.concat(bold(F.col("company")), opt(some("amount"), F.lit(" raised "), "amount"), opt(investor, F.lit(" from "), "investor"), F.lit(" ["), "source", F.lit("]"))
        order = [F.col("date").desc_nulls_last()]
    elif kind == "acquisition":
        rows, order = acquisitions(relationships, entities), []
        line = F.concat(bold(F.col("subject")), F.lit(" acquired **"), "object", F.lit("**"))
    elif kind == "layoff":
        rows, order = layoffs(relationships, entities), []
        line = F.concat(bold(F.col("company")), opt(F.coalesce("count", F.lit(0)) > 0, F.lit(" laid off "), F.col("count").cast("string"), F.lit(" employees")), F.lit(" [Layoff]"))
    elif kind == "move":
        rows, order = moves(relationships, entities), []
        line = F.concat(bold(F.col("person")), F.lit(" "), "action", F.lit(" "), "company")
    else:
        rows, order = hot_candidates(relationships, entities), [F.desc("score")]
        line = F.concat(bold(F.col("person")), F.lit(" ("), "title", F.lit(") - left "), "left_company", F.lit(" [Available]"))
    # a section's rows come in order, of at most 20 items; the number keeps that order among equals
    numbered = rows.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    return numbered.withColumn("line", line).select(F.row_number().over(W.orderBy(*order, "at")).alias("place"), "line")


def sections(relationships: DataFrame, entities: DataFrame, end: str, period: str = "weekly") -> DataFrame:
    """JOB-06: (section, title, place, line) of all items of a digest, capped as the period says; empty sections have no row."""
    start = (date.fromisoformat(end) - timedelta(days=7)).isoformat()
    out = None
    for k, (kind, title, cap) in enumerate(DIGEST_SECTIONS[period]):
        rows = lines_of(kind, relationships, entities, start, end).filter(F.col("place") <= cap)
        rows = rows.select(F.lit(k).alias("section"), F.lit(title).alias("title"), "place", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def document(relationships: DataFrame, entities: DataFrame, end: str, period: str = "weekly", name: str = "Event digest", most: int = 10) -> DataFrame:
    """JOB-06, SNK-16: (line, text) of a digest in Markdown, at most ten items a section; `df.orderBy("line").select("text")` writes it.

    The counts at its end are those of all entities and relationships."""
    items = sections(relationships, entities, end, period)
    heads = items.groupBy("section", "title").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("section", F.concat_ws(" ", F.col("n").cast("string"), F.lower(F.regexp_replace("title", "^[^ ]* ", ""))).alias("part"))))
    told = heads.agg(F.array_join(F.transform(parts, lambda x: x["part"]), ", ").alias("told"))
    told = told.select(F.when(F.col("told") != "", F.concat(F.lit("**This week: "), "told", F.lit(".**"))).otherwise("**No significant events this period.**").alias("text"))
    fixed = lambda section, *texts: [(section, k, t) for k, t in enumerate(texts)]
    day = date.fromisoformat(end).strftime("%B %d, %Y")
    frame = [*fixed(-3, f"# {name} {period.title()} - {day}", ""), *fixed(-1, "", "---", ""), *fixed(99, "---", "")]
    out = relationships.sparkSession.createDataFrame(frame, "section int, place int, text string")
    at = lambda rows, section, place, text: rows.select(F.lit(section).cast("int").alias("section") if isinstance(section, int) else section, F.lit(place).cast("int").alias("place") if isinstance(place, int) else place, text.alias("text"))
    own = F.col("section")
    out = out.unionByName(at(told, -2, 0, F.col("text")))
    out = out.unionByName(at(heads, own, -2, F.concat(F.lit("## "), "title"))).unionByName(at(heads, own, -1, F.lit(""))).unionByName(at(heads, own, 1000, F.lit("")))
    out = out.unionByName(at(items.filter(F.col("place") <= most), own, F.col("place"), F.col("line")))
    n = entities.agg(F.count("*").alias("e"), F.lit(0).cast("long").alias("r")).unionByName(relationships.agg(F.lit(0).cast("long").alias("e"), F.count("*").alias("r")))
    total = n.agg(F.sum("e").alias("e"), F.sum("r").alias("r"))
    out = out.unionByName(at(total, 99, 2, F.concat(F.lit("*Entities: "), F.col("e").cast("string"), F.lit(" | Relationships: "), F.col("r").cast("string"), F.lit("*"))))
    return out.select(F.row_number().over(W.orderBy("section", "place")).alias("line"), "text")  # as many lines as a digest has


def record(relationships: DataFrame, start: str, end: str) -> DataFrame:
    """SNK-17: one row of a digest's counts of each kind between two days, both included; undated rows belong to no period."""
    rows = relationships.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    kinds = {"funding": ["FUNDED_BY", "RAISED_FUNDING"], "acquisition": ["ACQUIRED"], "hire": ["HIRED_BY"], "departure": ["DEPARTED_FROM"], "layoff": ["LAID_OFF"]}
    counts = rows.agg(*(F.count_if(F.col("predicate").isin(p)).alias(f"{k}_count") for k, p in kinds.items()))
    return counts.select(F.lit(start).cast("date").alias("period_start"), F.lit(end).cast("date").alias("period_end"), "*")


def summary(sections: DataFrame) -> DataFrame:
    """AGG-20: one sentence from sections (place, title, n); empty sections are left out."""
    parts = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("place", F.concat(F.col("n").cast("string"), F.lit(" "), F.lower("title")).alias("part")))))
    text = F.array_join(F.transform(parts, lambda x: x["part"]), ", ")
    return sections.agg(text.alias("text")).select(F.when(F.col("text") != "", F.concat(F.lit("This week: "), F.col("text"), F.lit("."))).otherwise("No significant events this period.").alias("summary"))
