"""Readers for landed files and the normalisation of what they hold (SRC-01..04, 06..10, 12, 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.texts import parse_amount
from tidewire.operators.tables import first_wins

FEEDS = "feeds array<struct<name:string,url:string,priority:int,enabled:boolean,fetch_interval_minutes:int,event_types:array<string>>>"


def feed_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """SRC-01: column `feeds` (an array of FEEDS' structs) as rows in their order, with the defaults of what is missing."""
    out = rows.select(*keep, F.posexplode("feeds").alias("ord", "f")).select(*keep, "ord", "f.*")
    return out.withColumns({"priority": F.coalesce("priority", F.lit(1)), "enabled": F.coalesce("enabled", F.lit(True)), "fetch_interval_minutes": F.coalesce("fetch_interval_minutes", F.lit(60))})


def load_feeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: the feed list of a JSON file."""
    return feed_rows(spark.read.schema(FEEDS).json(path, multiLine=True))


def content_hash(url: Column, title: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", url, title), 256), F.lit(1), F.lit(32))


def normalize_entries(entries: DataFrame) -> DataFrame:
    """SRC-02: entries (link, title, summary, contents array, published, updated) to articles; those without link go."""
    rows = entries.filter(F.coalesce("link", F.lit("")) != "")
    content = F.coalesce(F.get("contents", F.lit(0)), "summary")
    return rows.select(F.col("link").alias("url"), "title", content.alias("content"), F.substr("summary", F.lit(1), F.lit(500)).alias("summary"), F.coalesce("published", "updated").alias("published"), content_hash(F.col("link"), F.col("title")).alias("content_hash"), *[c for c in ("feed_ord", "entry_ord") if c in entries.columns])


def merge_feeds(articles: DataFrame, since: str) -> DataFrame:
    """SRC-03, SET-03: not older than `since`, or undated; the first of each url in feed and entry order."""
    rows = articles.filter(F.col("published").isNull() | (F.col("published") >= F.lit(since).cast("timestamp")))
    return first_wins(rows, "url", "feed_ord", "entry_ord")


def semicolon_list(c: Column, most: int = 10) -> Column:
    """Entries of a `;` list, each up to its first comma, blanks and empty ones dropped, at most `most`."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(F.split_part(x, F.lit(","), F.lit(1))))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def parse_gkg(rows: DataFrame, as_of: str) -> DataFrame:
    """SRC-07: tab-separated knowledge-graph rows; without URL dropped, without date as of now."""
    url = F.col("DocumentIdentifier")
    title = F.substr(F.replace(F.element_at(F.split(F.rtrim(url), "/"), -1), F.lit("-"), F.lit(" ")), F.lit(1), F.lit(100))
    date = F.coalesce(F.try_to_timestamp(F.substr("DATE", F.lit(1), F.lit(8)), F.lit("yyyyMMdd")), F.lit(as_of).cast("timestamp"))
    return rows.filter(F.coalesce(url, F.lit("")) != "").select(
        url.alias("url"), title.alias("title"), date.alias("date"), semicolon_list(F.col("V2Themes")).alias("themes"), semicolon_list(F.col("V2Organizations")).alias("organizations"),
        semicolon_list(F.col("V2Persons")).alias("persons"), semicolon_list(F.col("V2Locations"), 5).alias("locations"), F.split_part("V2Tone", F.lit(","), F.lit(1)).try_cast("double").alias("tone"), F.col("SourceCommonName").alias("domain"),
    )


def with_themes(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """SRC-10: a wanted theme is part of any theme, in any case."""
    want = F.array(*(F.lit(w.lower()) for w in wanted))
    return rows.filter(F.exists("themes", lambda t: F.exists(want, lambda w: F.contains(F.lower(t), w))))


def parse_layoffs(rows: DataFrame, as_of: str, days_back: int = 30, min_employees: int = 0) -> DataFrame:
    """SRC-12: layoff CSV rows (alternate headers, two date formats); bad or old dates and nameless rows go."""

    def either(*names: str) -> Column:
        found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    raw = either("Date", "date")
    date = F.when(raw.contains("-"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(raw, F.lit("MM/dd/yyyy"))).cast("date")
    digits = F.nullif(F.regexp_replace(either("# Laid Off", "Laid_Off_Count"), r"\D", ""), F.lit("")).cast("long")
    percent = F.regexp_extract(F.coalesce(either("%", "Percentage"), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    out = rows.select(either("Company", "company").alias("company"), date.alias("date"), digits.alias("employees"), percent.alias("percent"), either("Industry").alias("industry"), either("Location_HQ", "Location").alias("location"), either("Source").alias("source"))
    return out.filter(F.col("company").isNotNull() & (F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days_back)) & (F.coalesce("employees", F.lit(0)) >= min_employees))


def recent_filings(rows: DataFrame, as_of: str, days_back: int, most: int = 500) -> DataFrame:
    """SRC-04, SRC-06: filings (filing_date and total_amount as text) of the last days; unreadable dates stay."""
    date = F.try_to_timestamp("filing_date", F.lit("yyyy-MM-dd")).cast("date")
    out = rows.withColumns({"date": date, "amount": parse_amount(F.col("total_amount"))})
    return out.filter(F.col("date").isNull() | (F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days_back))).orderBy(F.desc_nulls_last("date"), "cik").limit(most)


def gkg_articles(rows: DataFrame, priority: int = 2) -> DataFrame:
    """SRC-11: parsed knowledge-graph rows as articles without content; the summary names three organisations and themes."""
    three = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
    summary = F.concat(F.lit("Organizations: "), three("organizations"), F.lit(". Themes: "), three("themes"))
    return rows.select(
        F.concat(F.lit("gdelt:"), F.coalesce("domain", F.lit(""))).alias("source"), "url", "title", F.lit(None).cast("string").alias("content"), summary.alias("summary"),
        F.col("date").alias("published"), F.sha2("url", 256).alias("content_hash"), F.lit(priority).alias("feed_priority"),
    )
