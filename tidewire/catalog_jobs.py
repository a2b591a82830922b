"""Registered queries of the composite jobs: extraction, facts, enrichment, reports, pages and the digest, each with its SQL where SQL can express it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewire.catalog import _ENRICHED, _NEWEST, _SOURCED, _STAR, AS_OF, _documents, _tiers, query
from tidewire.functions import constants as K
from tidewire.functions import facts
from tidewire.operators import digest, enrichment, extraction, feeds, matching, pages, quality, resolution, tables


@query("who_hired", "relationships entities", f"""
SELECT r.id, s.name AS subject, o.name AS object, r.event_date {_STAR} WHERE r.predicate = 'HIRED_BY' AND contains(lower(o.name), 'acme 5') ORDER BY r.event_date DESC NULLS LAST, r.id DESC LIMIT 100""")
def _(r, e):
    return digest.who_hired(r, e, "Acme 5").select("id", "subject", "object", "event_date")


@query("where_went", "relationships entities", f"""
SELECT r.id, s.name AS subject, o.name AS object, r.event_date {_STAR} WHERE r.predicate = 'HIRED_BY' AND contains(lower(s.name), 'pat lee 1') ORDER BY r.event_date DESC NULLS LAST, r.id DESC LIMIT 100""")
def _(r, e):
    return digest.where_went(r, e, "Pat Lee 1").select("id", "subject", "object", "event_date")


def tell(rows: list[tuple[str, str]]) -> list:
    """An extractor for the articles of the views: what their titles say; it cannot read an article without content."""
    out = []
    for title, content in rows:
        if not content:
            out.append(ValueError("no content"))
            continue
        who, _, rest = title.partition(" acquires ")
        found = {"entities": [], "relationships": []}
        if rest:
            found = {
                "entities": [{"name": who, "type": "Company"}],
                "relationships": [{"subject": who, "predicate": "ACQUIRED", "object": rest.partition(" in ")[0], "context": content, "confidence": 0.9}],
            }
        out.append("```json\n" + json.dumps(found) + "\n```")
    return out


@query("extracted_articles", "articles", """
SELECT id, CASE WHEN content = '' THEN 'ValueError: no content' END AS error, CASE WHEN content = '' THEN NULL WHEN contains(title, ' acquires ') THEN 1 ELSE 0 END AS n_relationships,
 CASE WHEN content <> '' AND contains(title, ' acquires ') THEN split_part(title, ' acquires ', 1) || ' ACQUIRED Acme, ' || content END AS told FROM articles""")
def _(a):
    found = extraction.extracted(a, tell)
    edge = F.get("result.relationships", F.lit(0))
    told = F.concat(edge["subject"], F.lit(" "), edge["predicate"], F.lit(" "), edge["object"], F.lit(", "), edge["context"])
    n = F.when(F.col("result").isNotNull(), F.size("result.relationships"))
    return found.select("id", "error", n.alias("n_relationships"), told.alias("told"))


def _found(pattern: str, group: int = 1) -> str:
    """SQL of the first match; a pattern that names the entity is made for each row."""
    group = group if "(" in pattern.replace("(?:", "") else 0
    quoted = "'(?i)" + pattern.replace("'", "''").replace("NAME", "' || regexp_escape(name) || '") + "'"
    return f"nullif(trim(regexp_extract(text, {quoted}, {group})), '')"


def _first_found(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(map(_found, patterns)) + ")"


def _kind(kinds: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{kind}'" for kind, p in kinds) + " END"


def _lists(patterns: list[str], most: int, split: bool = False) -> str:
    each = "flatten([" + ", ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in patterns) + "])"
    if split:
        each = f"flatten([[trim(y) for y in string_split(x, ',')] for x in {each}])"
    return f"array_to_string(list_transform(list_filter({each}, lambda x, i: list_position({each}, x) = i)[:{most}], lambda x: x), '; ')"


_BUCKET = "CASE " + " ".join(f"WHEN n <= {most} THEN '{b}'" if most else f"WHEN n IS NOT NULL THEN '{b}'" for most, b in K.HEAD_COUNT_BUCKETS) + " END"
_YEARS = "coalesce(" + ", ".join(f"CASE WHEN CAST({_found(p)} AS INT) BETWEEN 1900 AND 2026 THEN CAST({_found(p)} AS INT) END" for p in K.FOUNDING_YEARS) + ")"
_SUM, _UNIT = (f"coalesce({', '.join(_found(p, g) for p in K.FUNDING_TOTALS)})" for g in (1, 2))
_SITE = "coalesce(" + ", ".join(f"CASE WHEN NOT regexp_matches({_found(p)}, 'linkedin|crunchbase|wikipedia') THEN CASE WHEN {_found(p)} LIKE 'http%' THEN {_found(p)} ELSE 'https://' || {_found(p)} END END" for p in K.WEBSITES) + ")"
_TITLED = "array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) for w in regexp_extract_all({0}, '([A-Za-z]+|[^A-Za-z]+)', 1)], '')"


@query("company_text_facts", "briefs", f"""
, c AS (SELECT entity_id, name, text, CAST(replace({_first_found(K.HEAD_COUNTS)}, ',', '') AS BIGINT) AS n, {_SUM} AS sum, lower({_UNIT}) IN ('billion', 'b') AS large, {_SITE} AS website_url,
 {_first_found(K.FUNDING_ROUNDS)} AS round, {_first_found(K.INDUSTRIES)} AS industry, regexp_extract(text, '(?i)' || regexp_escape(name) || '[^.]*\\s+is\\s+([^.]+\\.)', 1) AS told FROM briefs WHERE entity_type = 'company')
SELECT entity_id, CASE WHEN told <> '' THEN name || ' is ' || told WHEN contains(lower(text), lower(name)) AND length(split_part(substr(text, instr(lower(text), lower(name)), 300), '.', 1)) > 29 THEN split_part(substr(text, instr(lower(text), lower(name)), 300), '.', 1) || '.' END AS description,
 n AS employee_count, {_BUCKET} AS employee_range, {_first_found(K.HEADQUARTERS)} AS headquarters, {_YEARS} AS founded_year, '$' || sum || CASE WHEN large THEN 'B' ELSE 'M' END AS total_funding,
 CAST(TRY_CAST(sum AS DOUBLE) * CASE WHEN large THEN 1e9 ELSE 1e6 END AS BIGINT) AS total_funding_amount, {_TITLED.format('round')} AS last_funding_type, {_TITLED.format('industry')} AS industry, {_kind(K.COMPANY_TYPES)} AS company_type,
 website_url, nullif(regexp_extract(website_url, '(?:https?://)?(?:www\\.)?([a-z0-9-]+\\.[a-z]{{2,}})', 1), '') AS domain FROM c""")
def _(b):
    return b.filter("entity_type = 'company'").select("entity_id", facts.company_facts(F.col("text"), F.col("name")).alias("f")).select("entity_id", "f.*")


_EMPLOYER = "coalesce(" + ", ".join(
    f"CASE WHEN length(regexp_replace({_found(p)}, '(?i)\\s+(?:in|as|where|and).*$', '')) BETWEEN 3 AND 49 THEN regexp_replace({_found(p)}, '(?i)\\s+(?:in|as|where|and).*$', '') END" for p in K.EMPLOYERS
) + ")"


@query("person_text_facts", "briefs", f"""
SELECT entity_id, {_first_found(K.JOB_TITLES)} AS current_title, regexp_matches(text, '(?i){K.EXECUTIVE}') AS is_executive, CASE WHEN regexp_matches(text, '(?i){K.EXECUTIVE}') THEN {_kind(K.EXECUTIVE_LEVELS)} END AS executive_level,
 {_EMPLOYER} AS current_company, {_first_found(K.PLACES)} AS location, {_lists(K.EARLIER_EMPLOYERS, 5, True)} AS previous_companies, {_lists(K.SCHOOLS, 3)} AS education, {_lists(K.SKILLS, 5)} AS skills
FROM briefs WHERE entity_type = 'person'""")
def _(b):
    rows = b.filter("entity_type = 'person'").select("entity_id", facts.person_facts(F.col("text"), F.col("name")).alias("f")).select("entity_id", "f.*")
    return rows.withColumns({c: F.array_join(c, "; ") for c in ("previous_companies", "education", "skills")})


@query("unenriched_halves", "relationships entities", _ENRICHED + """
, u AS (SELECT * FROM entities WHERE id NOT IN (SELECT entity_id FROM d))
(SELECT id, name, entity_type FROM u WHERE entity_type = 'company' ORDER BY mention_count DESC, id LIMIT 10) UNION ALL (SELECT id, name, entity_type FROM u WHERE entity_type = 'person' ORDER BY mention_count DESC, id LIMIT 10)""")
def _(r, e):
    return enrichment.unenriched_halves(e, _documents(r)).select("id", "name", "entity_type")


@query("enrichment_run", "relationships entities briefs")
def _(r, e, b):
    return enrichment.enrich(e, r, _documents(r.filter("predicate = 'LAID_OFF'")), b.select("entity_id", "text"), 200)


@query("validation_report", "relationships entities", _ENRICHED + _SOURCED + """
, k AS (SELECT count(*) AS n, count(*) FILTER (tier = 1) AS t1, count(*) FILTER (tier = 2) AS t2, count(*) FILTER (tier = 3) AS t3 FROM q),
b AS (SELECT string_agg(source || '=' || n, '; ' ORDER BY source) AS by_source FROM (SELECT source, count(*) AS n FROM q GROUP BY source)),
w AS (SELECT count(*) AS n FROM (SELECT entity_id FROM (SELECT subject_id AS entity_id, source_url FROM relationships UNION ALL SELECT object_id, source_url FROM relationships) x JOIN entities ON id = entity_id GROUP BY entity_id HAVING count(DISTINCT source_url) > 1)),
t AS (SELECT count(*) AS n, (SELECT count(DISTINCT entity_id) FROM d) AS e FROM entities)
SELECT t.n AS total_entities, t.e AS enriched_entities, round(t.e / t.n * 100, 1) AS enrichment_coverage, w.n AS multi_source_entities, by_source AS source_distribution, t1 AS tier1_primary, t2 AS tier2_reputable, t3 AS tier3_secondary,
 round((t1 * 1.0::DOUBLE + t2 * 0.7::DOUBLE + t3 * 0.4::DOUBLE) / k.n * 100, 1) AS data_quality_score FROM t, w, k, b""")
def _(r, e):
    pairs = F.transform(F.map_entries("source_distribution"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return quality.validation_report(r, e, _documents(r), _tiers(r)).withColumn("source_distribution", F.array_join(pairs, "; "))


@query("feed_counts", "feed_log", ", f AS (SELECT DISTINCT feed_id FROM feed_log) SELECT count(*) AS total, count(*) FILTER (feed_id % 9 <> 0) AS active, count(*) FILTER (feed_id % 9 = 0) AS disabled FROM f")
def _(log):
    return feeds.feed_counts(log.select("feed_id").distinct().withColumn("enabled", F.when(F.col("feed_id") % 3 == 0, F.col("feed_id") % 9 != 0)))


_CLASS = "CASE WHEN contains(predicate, 'ACQUIRED') THEN 'acquisition' WHEN contains(predicate, 'FUNDED') THEN 'funding' WHEN contains(predicate, 'DEPARTED') OR contains(predicate, 'LAID') THEN 'departure' ELSE 'hire' END"
_HOST = "split_part(replace(split_part(source_url, '/', 3), 'www.', ''), '.', 1)"
_LINE = f"id || ' ' || subject || ' ' || object || ' ' || {_CLASS} || ' ' || upper(left({_HOST}, 1)) || lower(substr({_HOST}, 2))"
_AS_OF = "1998-08-02"


@query("timeline_page", "relationships entities", f"""
, x AS (SELECT r.*, s.name AS subject, o.name AS object {_STAR} WHERE event_date IS NULL OR event_date >= DATE '{_AS_OF}' - 30 {_NEWEST.replace('event_date', 'r.event_date').replace(' id', ' r.id')} LIMIT 200)
SELECT coalesce(event_date, DATE '{_AS_OF}') AS day, count(*) AS n, string_agg({_LINE}, '; ' ORDER BY event_date DESC NULLS LAST, id DESC) AS events FROM x GROUP BY 1""")
def _(r, e):
    return pages.timeline_page(r, e, _AS_OF).withColumn("events", _told("events"))


def _told(column: str):
    """The events of a page in one text."""
    parts = lambda x: F.concat_ws(" ", x["id"].cast("string"), x["subject"], x["object"], x["event_class"], F.coalesce(x["source_label"], F.lit("")))
    return F.array_join(F.transform(column, parts), "; ")


@query("search_page", "relationships entities", f"""
, x AS (SELECT r.*, s.name AS subject, o.name AS object {_STAR} WHERE r.event_date IS NULL OR r.event_date >= DATE '{_AS_OF}' - 90),
a AS (SELECT *, 0 AS side FROM x WHERE contains(lower(subject), 'acme') {_NEWEST} LIMIT 100), b AS (SELECT *, 1 AS side FROM x WHERE contains(lower(object), 'acme') AND id NOT IN (SELECT id FROM a) {_NEWEST} LIMIT 100),
b2 AS (SELECT * FROM (SELECT *, 1 AS side FROM x WHERE contains(lower(object), 'acme') {_NEWEST} LIMIT 100) WHERE id NOT IN (SELECT id FROM a)),
v AS (SELECT * FROM a UNION ALL SELECT * FROM b2), n AS (SELECT * FROM entities WHERE contains(lower(name), 'acme') AND entity_type = 'company' ORDER BY mention_count DESC, id LIMIT 1000)
SELECT (SELECT count(*) FROM n) AS n_entities, (SELECT string_agg(id, ' ' ORDER BY mention_count DESC, id) FROM (SELECT * FROM n ORDER BY mention_count DESC, id LIMIT 50)) AS entities,
 count(*) AS n_events, string_agg({_LINE}, '; ' ORDER BY side, event_date DESC NULLS LAST, id DESC) AS events FROM v""")
def _(r, e):
    ids = F.array_join(F.transform("entities", lambda x: x["id"].cast("string")), " ")
    return pages.search_page(r, e, _AS_OF, "Acme", "company").select("n_entities", ids.alias("entities"), "n_events", _told("events").alias("events"))


@query("dashboard", "articles relationships entities", _ENRICHED + f"""
, x AS (SELECT r.*, s.name AS subject, o.name AS object, row_number() OVER (PARTITION BY r.predicate ORDER BY r.event_date DESC NULLS LAST, r.id DESC) AS place {_STAR})
SELECT 'articles' AS panel, count(*) AS n, NULL AS events FROM articles UNION ALL SELECT 'high-signal articles', count(*), NULL FROM articles WHERE is_high_signal UNION ALL SELECT 'entities', count(*), NULL FROM entities
UNION ALL SELECT 'relationships', count(*), NULL FROM relationships UNION ALL SELECT 'enriched entities', count(DISTINCT entity_id), NULL FROM d UNION ALL SELECT 'type ' || entity_type, count(*), NULL FROM entities GROUP BY entity_type
UNION ALL SELECT predicate, count(*), any_value(told) FROM relationships LEFT JOIN (SELECT predicate, string_agg({_LINE}, '; ' ORDER BY place) AS told FROM x WHERE place <= 5 GROUP BY predicate) USING (predicate)
 WHERE predicate IN ('ACQUIRED', 'FUNDED_BY', 'HIRED_BY', 'DEPARTED_FROM') GROUP BY predicate""")
def _(a, r, e):
    return pages.dashboard(a, r, e, _documents(r)).withColumn("events", _told("events"))


@query("digest_weekly", "relationships entities")
def _(r, e):
    return digest.document(r, e, "1998-08-02")


@query("digest_daily", "relationships entities")
def _(r, e):
    return digest.document(r, e, "1998-08-02", "daily")


def _tables(r, e) -> resolution.Tables:
    tags = r.select(F.col("subject_id").alias("entity_id"), F.lower("predicate").alias("tag")).distinct()
    none = r.sparkSession.createDataFrame([], "entity_id long, normalized_alias string, alias string")
    return resolution.Tables(e, r, tags, tables.upsert_enrichment(_documents(r)), none)


@query("resolved_relationships", "relationships entities")
def _(r, e):
    return resolution.resolve(_tables(r, e))[0].relationships.select("id", "subject_id", "predicate", "object_id", "event_date")


@query("cross_reference_summary", "relationships entities")
def _(r, e):
    from tidewire.catalog import _events

    news, filed = _events(r, e)
    matches = matching.kept(matching.cross_reference(news, filed))
    return matching.cross_reference_summary(news, filed, matches)
