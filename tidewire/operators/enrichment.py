"""Enrichment of the most mentioned entities that have none (JOB-03), from texts and from the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import facts
from tidewire.operators import profiles, tables


def unenriched_halves(entities: DataFrame, enrichment: DataFrame, n: int = 20) -> DataFrame:
    """Of companies and of people each the n // 2 most mentioned without enrichment; of equal mentions the lower id."""
    halves = [tables.unenriched(entities.filter(F.col("entity_type") == kind), enrichment, n // 2) for kind in ("company", "person")]
    return halves[0].unionByName(halves[1])


def company_documents(chosen: DataFrame, texts: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, source, data) of companies: facts of their text, pages their name suggests, rounds, investors and openings of the graph."""
    rows = chosen.filter("entity_type = 'company'").select(F.col("id").alias("entity_id"), "name").join(texts, "entity_id", "left")
    rows = rows.join(profiles.company_facts(relationships, entities).withColumnRenamed("company_type", "graph_type"), "entity_id", "left")
    rows = rows.withColumn("f", facts.company_facts(F.col("text"), F.col("name")))
    domain, site = facts.with_pages(F.col("f"), F.col("name"))
    pages = facts.company_pages(F.col("name"))
    own = [F.col(f"f.{c}") for c in ("description", "employee_count", "employee_range", "headquarters", "founded_year", "total_funding", "total_funding_amount", "last_funding_type", "industry")]
    data = F.struct(
        *own, F.coalesce("f.company_type", "graph_type").alias("company_type"), domain.alias("domain"), site.alias("website_url"),
        pages[0].alias("company_page"), pages[1].alias("directory_page"), F.coalesce("funding_rounds", F.lit(0)).alias("funding_rounds"),
        F.coalesce("investors", F.lit("")).alias("investors"), F.coalesce("is_hiring", F.lit(False)).alias("is_hiring"), F.coalesce("job_openings", F.lit(0)).alias("job_openings"),
    )
    return rows.select("entity_id", source(), F.to_json(data).alias("data"))


def person_documents(chosen: DataFrame, texts: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, source, data) of people: facts of their text, then what the graph adds: employer, earlier ones, title of a role."""
    rows = chosen.filter("entity_type = 'person'").select(F.col("id").alias("entity_id"), "name").join(texts, "entity_id", "left")
    graph = profiles.person_facts(relationships, entities).withColumnsRenamed({"current_company": "graph_company", "title": "graph_title", "previous_companies": "graph_previous"})
    rows = rows.join(graph, "entity_id", "left").withColumn("f", facts.person_facts(F.col("text"), F.col("name")))
    earlier = F.filter(F.split(F.coalesce("graph_previous", F.lit("")), "; "), lambda x: x != "")
    level = F.when(F.col("f.current_title").isNull(), F.when(F.col("graph_title") == "Founder", "Founder").when(F.col("graph_title").isNotNull(), "C-level"))
    data = F.struct(
        F.coalesce("f.current_title", "graph_title").alias("current_title"), (F.col("f.is_executive") | F.col("graph_title").isNotNull()).alias("is_executive"),
        F.coalesce(level, F.col("f.executive_level")).alias("executive_level"), F.coalesce("f.current_company", "graph_company").alias("current_company"), F.col("f.location"),
        F.array_union(F.coalesce("f.previous_companies", F.array().cast("array<string>")), earlier).alias("previous_companies"),
        F.coalesce("f.education", F.array().cast("array<string>")).alias("education"), F.coalesce("f.skills", F.array().cast("array<string>")).alias("skills"), facts.person_page(F.col("name")).alias("search_page"),
    )
    return rows.select("entity_id", source(), F.to_json(data).alias("data"))


def source():
    """Where a document comes from: a text that was found, or the graph alone."""
    return F.when(F.coalesce("text", F.lit("")) != "", "web_search").otherwise("internal").alias("source")


def enrich(entities: DataFrame, relationships: DataFrame, enrichment: DataFrame, texts: DataFrame, n: int = 20) -> DataFrame:
    """JOB-03: (entity_id, source, data as JSON) of the chosen entities.  texts: entity_id and text, one row for each entity that
    a search found something about; the others get what the graph and their name tell.  Null facts are left out."""
    chosen = unenriched_halves(entities, enrichment, n)
    return company_documents(chosen, texts, relationships, entities).unionByName(person_documents(chosen, texts, relationships, entities))
