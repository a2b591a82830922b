"""Extraction results: parsing, building and storing them.

A result has `entities` array<struct<name, entity_type, confidence>> and `relationships`
array<struct<subject, subject_type, predicate, object, object_type, confidence, context>>.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import names as N
from tidewire.functions import texts as T

ANSWER = (
    "entities array<struct<name:string,type:string,role:string>>, relationships array<struct<subject:string,predicate:string,object:string,context:string,confidence:double>>, "
    "event_date string, amounts map<string,string>"
)
ENTITY = "struct<name:string,entity_type:string,confidence:double>"
EDGE = "struct<subject:string,subject_type:string,predicate:string,object:string,object_type:string,confidence:double,context:string>"


def entity(name: Column, kind: Column | str, confidence: float) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(name.alias("name"), kind.alias("entity_type"), F.lit(confidence).alias("confidence"))


def edge(subject: Column, predicate: str, obj: Column, kinds: tuple[str, str], confidence: float, context: Column) -> Column:
    return F.struct(subject.alias("subject"), F.lit(kinds[0]).alias("subject_type"), F.lit(predicate).alias("predicate"), obj.alias("object"), F.lit(kinds[1]).alias("object_type"), F.lit(confidence).alias("confidence"), context.alias("context"))


def parse_answer(text: Column, least: float = 0.70) -> Column:
    """FN-17: struct(entities, relationships, event_date, amounts) of an extraction answer in JSON, with or without a code fence.

    Entities that fail the name rules go, and relationships that lack an end or are not sure enough.
    An end has the type of the first entity with its name, else `unknown`.  Null and bad JSON give empty lists."""
    answer = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), ANSWER)
    given = F.coalesce(answer["entities"], F.array().cast("array<struct<name:string,type:string,role:string>>"))
    kind = lambda e: F.lower(F.coalesce(e["type"], F.lit("unknown")))
    entities = F.transform(F.filter(given, lambda e: N.is_good_entity(e["name"], kind(e))), lambda e: F.struct(N.strip_one_suffix(N.strip(e["name"]), kind(e)).alias("name"), kind(e).alias("entity_type")))
    edges = F.coalesce(answer["relationships"], F.array().cast("array<struct<subject:string,predicate:string,object:string,context:string,confidence:double>>"))
    ends = lambda r: (F.coalesce(N.strip(r["subject"]), F.lit("")) != "") & (F.coalesce(N.strip(r["object"]), F.lit("")) != "")
    sure = F.filter(edges, lambda r: ends(r) & (F.coalesce(r["confidence"], F.lit(0.8)) >= least))
    type_of = lambda x: F.coalesce(F.get(F.filter(entities, lambda e: F.lower(e["name"]) == F.lower(x)), F.lit(0))["entity_type"], F.lit("unknown"))
    typed = F.transform(
        sure,
        lambda r: F.struct(
            N.strip(r["subject"]).alias("subject"), type_of(N.strip(r["subject"])).alias("subject_type"), r["predicate"].alias("predicate"), N.strip(r["object"]).alias("object"), type_of(N.strip(r["object"])).alias("object_type"),
            F.coalesce(r["confidence"], F.lit(0.8)).alias("confidence"), r["context"].alias("context"),
        ),
    )
    return F.struct(entities.alias("entities"), typed.alias("relationships"), answer["event_date"].try_cast("date").alias("event_date"), answer["amounts"].alias("amounts"))


def simple_extraction(organizations: Column, people: Column, amounts: Column, kind: Column) -> Column:
    """FN-16: struct(entities, relationships) of named-entity arrays: of the first five of each those over two letters;
    with a round type, one organisation and an amount, one funding by `Undisclosed`."""
    named = lambda c, k: F.transform(F.filter(F.slice(c, 1, 5), lambda x: F.length(x) > 2), lambda x: entity(x, k, 0.75))
    context = F.concat(kind, F.lit(" round: $"), F.format_number(F.get(amounts, F.lit(0)), 0))
    funded = edge(F.get(organizations, F.lit(0)), "FUNDED_BY", F.lit("Undisclosed"), ("company", "investor"), 0.70, context)
    one = kind.isNotNull() & (F.size(organizations) == 1) & (F.size(amounts) > 0)
    return F.struct(F.concat(named(organizations, "company"), named(people, "person")).alias("entities"), F.when(one, F.array(funded)).otherwise(F.array().cast(f"array<{EDGE}>")).alias("relationships"))


def layoff_result(company: Column, employees: Column, percentage: Column) -> Column:
    """FN-19: the company and its LAID_OFF relationship; a percentage of null or 0 is not told."""
    share = F.when(F.coalesce(percentage, F.lit(0)) != 0, F.concat(F.lit(" ("), percentage.cast("string"), F.lit("% of workforce)"))).otherwise("")
    context = F.concat(F.lit("Laid off "), F.coalesce(employees.cast("string"), F.lit("None")), F.lit(" employees"), share)
    return F.struct(F.array(entity(company, "company", 0.95)).alias("entities"), F.array(edge(company, "LAID_OFF", F.lit("employees"), ("company", "group"), 0.95, context)).alias("relationships"))


def edge_metadata(predicate: Column, amounts: Column) -> Column:
    """SNK-07: the amounts that belong to a predicate, as a map; empty ones are left out."""
    value = lambda k: F.try_element_at(amounts, F.lit(k))
    money = lambda k: F.create_map(F.lit("amount"), value(k), F.lit("valuation"), value("valuation"))
    chosen = F.when(predicate == "ACQUIRED", money("acquisition")).when(predicate == "FUNDED_BY", money("funding")).when(predicate == "LAID_OFF", F.create_map(F.lit("count"), value("layoff_count")))
    return F.map_filter(F.coalesce(chosen, F.create_map().cast("map<string,string>")), lambda _, v: F.coalesce(v, F.lit("")) != "")


def fan_out(results: DataFrame, key: str = "id", result: str = "result") -> tuple[DataFrame, DataFrame]:
    """SNK-07: the entity mentions and the relationships of all results, each with its key and place in the result."""
    r = F.col(result)
    mentions = results.select(key, F.posexplode(r["entities"]).alias("place", "e")).select(key, "place", "e.*")
    edges = results.select(key, r["amounts"].alias("amounts"), F.posexplode(r["relationships"]).alias("place", "e")).select(key, "place", "e.*", edge_metadata(F.col("e.predicate"), F.col("amounts")).alias("metadata"))
    return mentions, edges


def funding_events(star: DataFrame, as_of: str) -> DataFrame:
    """FN-21 for relationships (subject, predicate, event_date, context, source_url, confidence): the subject is the company in
    both kinds, the amount is read from the context, an undated one is dated as of now."""
    rows = star.filter(F.col("predicate").isin("FUNDED_BY", "RAISED_FUNDING"))
    day = F.coalesce("event_date", F.lit(as_of).cast("date"))
    return rows.select(F.col("id").alias("event_id"), F.col("subject").alias("company_name"), T.money(F.col("context")).alias("amount"), day.alias("date"), T.round_type(F.lower("context")).alias("round_type"), F.lit("news").alias("source_type"), "source_url", F.coalesce("confidence", F.lit(0.8)).alias("confidence"))


def filing_events(filings: DataFrame) -> DataFrame:
    """FN-21 for filings: the amount falls back to what was sold."""
    amount = F.coalesce(F.nullif("total_amount", F.lit(0.0)), "amount_sold")
    return filings.select("company_name", amount.alias("amount"), F.col("filing_date").alias("date"), F.lit(None).cast("string").alias("round_type"), F.lit("form_d").alias("source_type"), "source_url", F.lit(0.95).alias("confidence"))


def two_stage(rows: DataFrame, routed: str, cheap: Callable[[DataFrame], DataFrame], deep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """UDF-02: rows whose flag column `routed` is true go to the deep extractor, the others (null too) to the cheap one."""
    flag = F.coalesce(F.col(routed), F.lit(False))
    return cheap(rows.filter(~flag)).unionByName(deep(rows.filter(flag)))


def answers(articles: DataFrame, extract: Callable[[list[tuple[str, str]]], list], key: str = "id", batch_rows: int = 64) -> DataFrame:
    """UDF-01: (key, answer, error) of a user's extractor over articles (key, title, content).

    The extractor gets at most `batch_rows` articles at a time as (title, content), nulls as empty texts, and gives an answer in
    JSON (or null) for each, or an exception in its place.  Where it raises or gives another number of answers, the batch is
    asked again article by article, so that one bad article costs no other; what fails alone has its error and no answer."""
    kind = articles.schema[key].dataType.simpleString()

    def ask(rows: list[tuple[str, str]]) -> list:
        got = list(extract(rows))
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} answers for {len(rows)} articles")
        return got

    def each(rows: list[tuple[str, str]]) -> list:
        try:
            return ask(rows)
        except Exception as why:  # the extractor is the user's: whatever it raises is the row's error
            return [why] if len(rows) == 1 else [x for row in rows for x in each([row])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = [[x or "" for x in part.column(k).to_pylist()] for k in (1, 2)]
                got = each(list(zip(*texts, strict=True)))
                bad = [f"{type(x).__name__}: {x}" if isinstance(x, Exception) else None for x in got]
                good = [None if isinstance(x, Exception) or x is None else str(x) for x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(good, pa.string()), pa.array(bad, pa.string())], [key, "answer", "error"])

    return articles.select(key, "title", "content").mapInArrow(run, f"`{key}` {kind}, answer string, error string")


def extracted(articles: DataFrame, extract: Callable[[list[tuple[str, str]]], list], key: str = "id", batch_rows: int = 64) -> DataFrame:
    """UDF-01: (key, result, error): the parsed answers, of whose relationships the valid ones stay."""
    rows = answers(articles, extract, key, batch_rows).withColumn("r", parse_answer(F.col("answer")))
    valid = F.filter("r.relationships", lambda e: N.relationship_reason(e["subject"], e["predicate"], e["object"]) == "OK")
    result = F.struct("r.entities", valid.alias("relationships"), "r.event_date", "r.amounts")
    return rows.select(key, F.when(F.col("error").isNull(), result).alias("result"), "error")
