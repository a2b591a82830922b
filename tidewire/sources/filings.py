"""Landed filings and company directories, and what they say as extraction results (SRC-05, SRC-14..16, FN-18, FN-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import names as N
from tidewire.functions.texts import parse_amount
from tidewire.operators.extraction import EDGE, ENTITY, edge, entity

HIT = """name string, slug string, batch string, status string, one_liner string, long_description string, industries array<string>, team_size int,
location string, city string, website string, founders array<struct<full_name:string,title:string,linkedin_url:string>>"""


def parse_filings(rows: DataFrame) -> DataFrame:
    """SRC-05: nested filings flat; without an issuer's name the filer's counts, officers are trimmed first and last names."""
    full = lambda p: N.strip(F.concat_ws(" ", F.coalesce(p["first_name"], F.lit("")), F.coalesce(p["last_name"], F.lit(""))))
    officers = F.filter(F.transform("related_persons", full), lambda x: x != "")
    return rows.select(
        F.coalesce(F.nullif("issuer.entity_name", F.lit("")), "company").alias("company_name"), F.col("cik").cast("string").alias("cik"), F.coalesce("accession_no", F.lit("")).alias("file_number"), "filing_date",
        parse_amount(F.col("total_offering_amount")).alias("total_amount"), parse_amount(F.col("total_amount_sold")).alias("amount_sold"),
        F.col("issuer.jurisdiction").alias("state_of_incorporation"), F.col("issuer.entity_type").alias("entity_type"), F.col("issuer.year_of_incorporation").alias("year_founded"),
        F.coalesce("total_already_invested", F.lit(0)).alias("total_investors"), F.coalesce(officers, F.array().cast("array<string>")).alias("officers"),
    )


def typed_edge(subject: Column, kind: Column, predicate: str, obj: Column, context: Column) -> Column:
    """An edge to a company whose subject's type is a column."""
    return edge(subject, predicate, obj, ("company", "company"), 0.95, context).withField("subject_type", kind)


def filing_results(filings: DataFrame) -> DataFrame:
    """FN-18: cik, file_number and `result` of struct(entities, relationships): the company, the one behind a special
    purpose vehicle, the officers, and the funding if an amount is told.

    `officer_roles`, where the filings have it, holds each officer's roles as one text: a director's edge is DIRECTOR_OF, an
    executive's EXECUTIVE_OF, all others' OFFICER_OF."""
    company, kind = N.clean_filing_name(F.col("company_name")), lambda n: F.when(N.is_organisation(n), "company").otherwise("person")
    rows = filings.withColumn("company", company).withColumn("behind", N.underlying_company(F.col("company")))
    roles = F.col("officer_roles") if "officer_roles" in filings.columns else F.array().cast("array<string>")
    people = F.transform("officers", lambda x, k: F.struct(N.clean_filing_name(x).alias("name"), F.coalesce(F.get(roles, k), F.lit("")).alias("role")))
    rows = rows.withColumn("people", F.filter(people, lambda x: x["name"] != ""))
    c, behind = F.col("company"), F.col("behind")
    none_e, none_r = F.array().cast(f"array<{ENTITY}>"), F.array().cast(f"array<{EDGE}>")
    inferred = F.when(behind.isNotNull() & (behind != c), F.array(entity(behind, "company", 0.75))).otherwise(none_e)
    entities = F.concat(F.array(entity(c, "company", 0.95)), inferred, F.transform("people", lambda x: entity(x["name"], kind(x["name"]), 0.95)))
    named = F.concat(F.lit("SEC Form D filing "), F.col("file_number"))
    role = lambda x: F.when(x.contains("Director"), "DIRECTOR_OF").when(x.contains("Executive"), "EXECUTIVE_OF").otherwise("OFFICER_OF")
    of = F.transform("people", lambda x: typed_edge(x["name"], kind(x["name"]), "OFFICER_OF", c, named).withField("predicate", role(x["role"])))
    told = F.concat(F.lit("$"), F.format_number("total_amount", 0), F.lit(" raised via SEC Form D ("), F.col("total_investors").cast("string"), F.lit(" investors)"))
    raised = F.array(edge(F.coalesce(behind, c), "RAISED_FUNDING", F.lit("Undisclosed Investors"), ("company", "investor"), 0.95, told))
    relationships = F.concat(of, F.when(F.col("total_amount") > 0, raised).otherwise(none_r))
    return rows.select("cik", "file_number", "filing_date", F.struct(entities.alias("entities"), relationships.alias("relationships")).alias("result"))


def parse_directory(rows: DataFrame, pages: str) -> DataFrame:
    """SRC-14: column `hit` (JSON) as companies; `pages` and the slug stand for a missing website.  Nameless and bad ones go."""
    h = F.from_json("hit", HIT)
    filled = lambda c: F.nullif(c, F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    founders = F.transform(h["founders"], lambda f: F.struct(blank(f["full_name"]).alias("name"), blank(f["title"]).alias("title"), blank(f["linkedin_url"]).alias("linkedin")))
    return rows.filter(blank(h["name"]) != "").select(
        h["name"].alias("name"), blank(h["slug"]).alias("slug"), blank(h["batch"]).alias("batch"), F.coalesce(h["status"], F.lit("Active")).alias("status"),
        F.coalesce(filled(h["one_liner"]), F.substr(blank(h["long_description"]), F.lit(1), F.lit(200))).alias("description"), h["industries"].alias("industries"), h["team_size"].alias("team_size"),
        F.coalesce(filled(h["location"]), blank(h["city"])).alias("location"), F.coalesce(filled(h["website"]), F.concat(F.lit(pages), blank(h["slug"]))).alias("website"), founders.alias("founders"),
    )


def recent_batches(year: int, n: int = 4) -> list[str]:
    """SRC-16: the first n batch codes of three years, newest year first, winter before summer."""
    return [f"{half}{y % 100:02d}" for y in range(year, year - 3, -1) for half in "WS"][:n]


def chosen(companies: DataFrame, batches: list[str] | None = None, status: str | None = None, industry: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC-15: facets that are given must fit."""
    if batches is not None:
        companies = companies.filter(F.col("batch").isin(batches))
    if status is not None:
        companies = companies.filter(F.col("status") == status)
    if industry is not None:
        companies = companies.filter(F.array_contains("industries", industry))
    return companies if limit is None else companies.orderBy("name", "slug").limit(limit)


def directory_results(companies: DataFrame, accelerator: str, short: str) -> DataFrame:
    """FN-20: slug, website and `result`: the company, its named founders, FOUNDED edges and one FUNDED_BY the accelerator."""
    founders = F.filter(F.transform("founders", lambda f: f["name"]), lambda x: x != "")
    context = F.concat(F.lit(f"{short} "), F.col("batch"), F.lit(" batch"))
    entities = F.concat(F.array(entity(F.col("name"), "company", 0.95)), F.transform(founders, lambda x: entity(x, "person", 0.95)))
    founded = F.transform(founders, lambda x: edge(x, "FOUNDED", F.col("name"), ("person", "company"), 0.95, context))
    funded = F.array(edge(F.col("name"), "FUNDED_BY", F.lit(accelerator), ("company", "investor"), 0.95, context))
    result = F.struct(F.coalesce(entities, F.array(entity(F.col("name"), "company", 0.95))).alias("entities"), F.coalesce(F.concat(founded, funded), funded).alias("relationships"))
    return companies.select("slug", "website", result.alias("result"))
