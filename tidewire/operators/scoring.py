"""Rankings of companies and people (W-04, W-05, J-16, FLT-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions.names import is_fund, is_person_name
from tidewire.operators.graph import newest_first, star


def has_news(context="context"):
    """FLT-17: a context that is not empty and does not come from a filing."""
    c = F.coalesce(F.col(context), F.lit(""))
    return (c != "") & ~c.contains("Form D")


def company_scores(relationships: DataFrame, entities: DataFrame, top: int = 50) -> DataFrame:
    """W-05, JOB-04, by exact ends: one aggregation in place of queries for each company."""
    s = relationships.select(F.col("subject_id").alias("id"), F.lit("s").alias("end"), "predicate", has_news().alias("news"))
    o = relationships.select(F.col("object_id").alias("id"), F.lit("o").alias("end"), "predicate", has_news().alias("news"))
    n = lambda end, p: F.count_if((F.col("end") == end) & (F.col("predicate") == p))
    facts = s.unionByName(o).groupBy("id").agg(
        F.max("news").alias("news"), n("s", "FUNDED_BY").alias("funded"), n("s", "RAISED_FUNDING").alias("raised"), n("s", "ACQUIRED").alias("buys"),
        n("o", "ACQUIRED").alias("sold"), n("o", "HIRED_BY").alias("hires"), n("o", "DEPARTED_FROM").alias("leaves"), n("s", "LAID_OFF").alias("layoffs"),
    )
    rows = entities.filter((F.col("entity_type") == "company") & ~is_fund(F.col("name"))).select("id", "name").join(facts, "id")
    yes = lambda c, points: F.when(F.col(c) > 0, points).otherwise(0)
    hires, leaves = F.least("hires", F.lit(20)), F.least("leaves", F.lit(10))
    score = F.when(F.col("news"), 20).otherwise(0) + F.when(F.col("funded") > 0, 35).when(F.col("raised") > 0, 25).otherwise(0) + yes("buys", 30) + yes("sold", 20) + 3 * hires + 4 * leaves + yes("layoffs", 15)
    signals = F.array_compact(F.array(
        F.when(F.col("news"), "In News"), F.when(F.col("funded") > 0, "Funded (News)").when(F.col("raised") > 0, "Funded (SEC)"),
        F.when(F.col("buys") > 0, F.format_string("Acquiring (%dx)", F.least("buys", F.lit(10)))), F.when(F.col("sold") > 0, "Was acquired"),
        F.when(F.col("hires") > 0, F.format_string("Hiring (%d recent)", hires)), F.when(F.col("leaves") > 0, F.format_string("Departures (%d)", leaves)), F.when(F.col("layoffs") > 0, "Layoffs"),
    ))
    rows = rows.select("id", "name", score.cast("long").alias("score"), F.array_join(signals, "; ").alias("signals"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "id").limit(top)


def candidate_scores(relationships: DataFrame, entities: DataFrame, top: int = 100, latest: int = 30) -> DataFrame:
    """W-04, JOB-05: a fold over the latest relationships of each person, newest first."""
    people = entities.filter((F.col("entity_type") == "person") & is_person_name(F.col("name"))).select("id")
    place = F.row_number().over(W.partitionBy("subject_id").orderBy(*newest_first()))
    mine = relationships.join(people.withColumnRenamed("id", "subject_id"), "subject_id").withColumn("k", place).filter(F.col("k") <= latest)
    rows = star(mine, entities).filter(~is_fund(F.col("object")))
    folded = rows.groupBy("subject_id", "subject").agg(F.array_sort(F.collect_list(F.struct("k", "predicate", "object", F.coalesce("context", F.lit("")).alias("context")))).alias("xs"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("score"), none.alias("company"), none.alias("role"), F.lit(False).alias("news"))

    def step(s, x):
        p = x.predicate
        strong = F.when(p == "FOUNDED", 50).when(p == "CEO_OF", 45).when(p.isin("CTO_OF", "CFO_OF"), 40)
        floor = F.when(p == "OFFICER_OF", 25).when(p == "EXECUTIVE_OF", 35).when(p == "DIRECTOR_OF", 20)
        weak = floor.isNotNull() & (s.score < floor)
        gain = F.coalesce(strong, F.when(weak, floor), F.when(p == "DEPARTED_FROM", 30).when(p == "HIRED_BY", 10), F.lit(0))
        takes = strong.isNotNull() | weak
        role = F.when(p == "FOUNDED", "Founder").when(p == "OFFICER_OF", "Officer").when(p == "EXECUTIVE_OF", "Executive").when(p == "DIRECTOR_OF", "Director").otherwise(F.replace(p, F.lit("_OF"), F.lit("")))
        return F.struct(
            (s.score + gain).alias("score"), F.when(takes | ((p == "HIRED_BY") & s.company.isNull()), x.object).otherwise(s.company).alias("company"),
            F.when(takes, role).otherwise(s.role).alias("role"), (s.news | (strong.isNotNull() & ~x.context.contains("Form D"))).alias("news"),
        )

    s = F.aggregate("xs", start, step)
    rows = folded.select(F.col("subject_id").alias("id"), F.col("subject").alias("name"), (s.score + F.when(s.news, 15).otherwise(0)).alias("score"), s.company.alias("company"), s.role.alias("role"), s.news.alias("news"))
    return rows.filter("score > 0 and company is not null").orderBy(F.desc("score"), "id").limit(top)
