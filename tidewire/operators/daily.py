"""The daily run (JOB-01) over a store of Parquet tables, and its record (SNK-15).

Each table of a store is partitioned by run, and a run writes its own partition alone: run again, it replaces what it wrote and
reads what other runs wrote, so that a run that died is run again from the start.  Runs go in the order of their names.
Counts are observed while rows are written; no table is read again for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.names import plain_key
from tidewire.functions.texts import classify
from tidewire.operators import enrichment, extraction, matching, quality, resolution, tables
from tidewire.operators.graph import star

EDGE = "subject string, subject_type string, predicate string, object string, object_type string, confidence double, context string, event_date date, source_url string"
RECORD = (
    "fetched_articles long, saved_articles long, high_signal_articles long, extracted_articles long, failed_articles long, extracted_relationships long, filing_relationships long, "
    "layoff_relationships long, directory_relationships long, filing_matches long, entities long, relationships long, invalid_removed long, types_fixed long, "
    "duplicates_found long, duplicates_merged long, data_quality_score double, enriched_entities long, elapsed_seconds double"
)
SCHEMAS = {
    "articles": "id long, url string, title string, content string, published timestamp, feed_priority int, content_hash string",
    "classified": "id long, event_type string, confidence double, is_high_signal boolean",
    "extracted": "id long, error string",
    "mentions": "name string, entity_type string",
    "edges": EDGE,
    "enrichment": "entity_id long, source string, data string",
    "runs": RECORD,
}


@dataclass
class Inputs:
    """What was fetched.  articles: url, title, content, published, feed_priority, content_hash and seq (their order); searches: the
    same of a supplementary search, after them.  filings, layoffs and directory: result (as extraction results), source_url and, where
    known, event_date;
    filing_events: event_id, company_name, amount and date of the same filings.  texts: entity_id and text of a search about entities."""

    articles: DataFrame
    searches: DataFrame | None = None
    filings: DataFrame | None = None
    filing_events: DataFrame | None = None
    layoffs: DataFrame | None = None
    directory: DataFrame | None = None
    texts: DataFrame | None = None


@dataclass
class Switches:
    searches: bool = True
    filings: bool = True
    layoffs: bool = True
    directory: bool = True
    cross_reference: bool = True


class Store:
    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run
        for name, schema in SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/run=0")

    def read(self, name: str) -> DataFrame:
        """Rows of all runs up to this one."""
        rows = self.spark.read.schema(SCHEMAS[name] + ", run string").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return rows.filter(F.col("run") <= self.run)

    def before(self, name: str) -> DataFrame:
        return self.read(name).filter(F.col("run") < self.run)

    def write(self, name: str, rows: DataFrame, **counts) -> dict[str, int]:
        """Replaces this run's rows; the counts (name to column) are observed on the way."""
        seen = Observation(f"{name} of the run")
        kept = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counts.items()))
        kept = kept.select(*(F.col(f.split()[0]) for f in SCHEMAS[name].split(", ")))
        kept.write.mode("overwrite").parquet(f"{self.path}/{name}/run={self.run}")
        return observed(seen, "rows", *counts)


def observed(seen: Observation, *names: str) -> dict[str, int]:
    """Observed counts; 0 where Spark found the rows to be none while it planned, and so observed nothing."""
    try:
        return seen.get
    except Py4JJavaError as why:
        if "AssertionError" not in str(why.java_exception):
            raise
        return dict.fromkeys(names, 0)


def edges_of(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and edges of results (kind, result, source_url, event_date); each end of an edge is a mention too."""
    r = F.col("result")
    edges = results.select("kind", "source_url", "event_date", F.inline(r["relationships"]))
    own = results.select(F.explode(r["entities"]).alias("e")).select("e.name", "e.entity_type")
    ends = [edges.select(F.col(end).alias("name"), F.col(f"{end}_type").alias("entity_type")) for end in ("subject", "object")]
    return own.unionByName(ends[0]).unionByName(ends[1]), edges


def with_ids(mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of all mentions and edges (SNK-05 to SNK-07).  An entity's id is a hash of its plain name and type,
    a relationship's one of its ends, predicate, date and source, so that no run has to know another's numbers."""
    key = lambda name, kind: F.xxhash64(plain_key(F.col(name)), F.col(kind))
    entities = mentions.filter(plain_key(F.col("name")) != "").groupBy(key("name", "entity_type").alias("id"))
    entities = entities.agg(F.min("name").alias("name"), F.first("entity_type").alias("entity_type"), F.count("*").alias("mention_count"))
    rows = edges.withColumns({"subject_id": key("subject", "subject_type"), "object_id": key("object", "object_type")})
    rows = rows.withColumn("id", F.xxhash64("subject_id", "predicate", "object_id", "event_date", "source_url", "context"))
    rows = tables.insert_relationships(rows.select("id", "subject_id", "predicate", "object_id", "event_date", "confidence", "context", "source_url"))
    return entities, rows.dropDuplicates(["id"])


def run_daily(
    spark: SparkSession,
    path: str,
    run: str,
    as_of: str,
    inputs: Inputs,
    extract: Callable[[list[tuple[str, str]]], list],
    switches: Switches = Switches(),
    max_articles: int = 500,
    enrich_most: int = 20,
) -> DataFrame:
    """Saves new articles, classifies and extracts at most `max_articles` each, adds filings, layoffs and directory companies, matches
    news with filings, resolves entities, validates and enriches; returns the run's record, one row, which the store keeps.

    An article that the extractor fails on is asked about again by the next run.  A source that is off, or not given, adds nothing
    and counts null.  Articles are identified by a hash of their url; those without a url are not saved."""
    began, store, record = time.time(), Store(spark, path, run), {}
    fetched = inputs.articles.withColumn("source_", F.lit(0))
    if switches.searches and inputs.searches is not None:
        fetched = fetched.unionByName(inputs.searches.withColumn("source_", F.lit(1)), allowMissingColumns=True)
    counted = Observation("fetched")
    fetched = fetched.observe(counted, F.count(F.lit(1)).alias("rows")).filter("url is not null")
    fresh = tables.insert_new(fetched.withColumn("order_", F.struct("source_", "seq")), store.before("articles"), order="order_")
    record["saved_articles"] = store.write("articles", fresh.withColumn("id", F.xxhash64("url")))["rows"]
    record["fetched_articles"] = observed(counted, "rows")["rows"]

    articles = store.read("articles")
    pending = articles.join(store.before("classified").select("id"), "id", "left_anti")
    pending = pending.orderBy("feed_priority", F.desc_nulls_last("published"), "id").limit(max_articles)
    kind = pending.select("id", classify(F.col("title"), F.col("content")).alias("c"))
    kind = kind.select("id", F.col("c.primary_type").alias("event_type"), "c.confidence", "c.is_high_signal")
    record["high_signal_articles"] = store.write("classified", kind, high=F.count_if("is_high_signal"))["high"]

    signals = store.read("classified").filter("is_high_signal").select("id")
    done = store.before("extracted").filter("error is null").select("id")
    asked = articles.join(signals, "id", "left_semi").join(done, "id", "left_anti")
    asked = asked.orderBy(F.desc_nulls_last("published"), "id").limit(max_articles)
    found = matching.kept(extraction.extracted(asked, extract).join(asked.select("id", F.col("url").alias("source_url")), "id"))
    marks = store.write("extracted", found, failed=F.count_if(F.col("error").isNotNull()))
    record |= {"extracted_articles": marks["rows"] - marks["failed"], "failed_articles": marks["failed"]}

    results = found.filter("error is null").select(F.lit("extracted").alias("kind"), "source_url", F.col("result.event_date").alias("event_date"), result_of(F.col("result")).alias("result"))
    for name, source in (("filing", inputs.filings), ("layoff", inputs.layoffs), ("directory", inputs.directory)):
        if source is not None and getattr(switches, {"filing": "filings", "layoff": "layoffs"}.get(name, name)):
            day = F.col("event_date") if "event_date" in source.columns else F.lit(None).cast("date")
            own = source.select(F.lit(name).alias("kind"), "source_url", day.alias("event_date"), result_of(F.col("result")).alias("result"))
            results = results.unionByName(own)
            record[f"{name}_relationships"] = 0
    results = matching.kept(results.filter(F.size("result.relationships") > 0))
    mentions, edges = edges_of(results)
    store.write("mentions", mentions)
    of = {k: F.count_if(F.col("kind") == k) for k in ("extracted", "filing", "layoff", "directory")}
    seen = store.write("edges", edges, **of)
    record["extracted_relationships"] = seen["extracted"]
    record |= {k: seen[k.split("_")[0]] for k in list(record) if k in ("filing_relationships", "layoff_relationships", "directory_relationships")}

    entities, relationships = (matching.kept(x) for x in with_ids(store.read("mentions"), store.read("edges")))
    if switches.cross_reference and switches.filings and inputs.filing_events is not None:
        news = extraction.funding_events(star(relationships.filter("predicate = 'FUNDED_BY'"), entities), as_of)
        record["filing_matches"] = matching.cross_reference(news.select("event_id", "company_name", "amount", "date"), inputs.filing_events).count()
    none = lambda schema: spark.createDataFrame([], schema)
    given = resolution.Tables(entities, relationships, none("entity_id long, tag string"), store.before("enrichment").drop("run"), none("entity_id long, normalized_alias string, alias string"))
    after, counts = resolution.resolve(given)
    record |= counts.first().asDict()
    entities, relationships, known = (matching.kept(x) for x in (after.entities, after.relationships, after.enrichment))
    report = quality.validation_report(relationships, entities, known, quality.tier_table(spark)).first()
    record |= {"entities": report.total_entities, "relationships": relationships.count(), "data_quality_score": report.data_quality_score}

    texts = inputs.texts if inputs.texts is not None else none("entity_id long, text string")
    record["enriched_entities"] = store.write("enrichment", enrichment.enrich(entities, relationships, known, texts, enrich_most))["rows"]
    for name, rows in (("entities", entities), ("relationships", relationships), ("aliases", after.aliases)):
        rows.write.mode("overwrite").parquet(f"{path}/graph/{name}/run={run}")
    record["elapsed_seconds"] = time.time() - began
    one = spark.createDataFrame([tuple(record.get(f.split()[0]) for f in RECORD.split(", "))], RECORD)
    store.write("runs", one)
    return one.withColumn("run", F.lit(run))


def result_of(result: Column) -> Column:
    """A result with its entities' names and types and its relationships as edges, whatever else it has."""
    entities = F.transform(result["entities"], lambda e: F.struct(e["name"].alias("name"), e["entity_type"].alias("entity_type")))
    fields = ("subject", "subject_type", "predicate", "object", "object_type", "confidence", "context")
    edges = F.transform(result["relationships"], lambda r: F.struct(*(r[c].alias(c) for c in fields)))
    return F.struct(entities.alias("entities"), edges.alias("relationships"))
