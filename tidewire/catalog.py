"""Registered queries over the views of `tidewire.plans.views`, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import names as N
from tidewire.functions import texts as T
from tidewire.functions.constants import ENTITY_SUFFIXES, FILING_SUFFIXES, MULTIPLIERS, ROUNDS, SOURCE_TIERS
from tidewire.operators import digest, extraction, feeds, graph, lookups, matching, profiles, quality, resolution, scoring, tables
from tidewire.plans.views import view, with_views
from tidewire.sources import landed
from tidewire.streaming import jobs

AS_OF, SINCE = "2024-06-30", "1998-01-01"
_REGISTER: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, views: str, sql: str | None = None) -> Callable:
    """Registers a function of the named views' DataFrames; `sql` reads the same views.  A name is given once."""
    if name in _REGISTER:
        raise ValueError(f"{name} is registered already")

    def add(f: Callable) -> Callable:
        run = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views.split()))
        _REGISTER[name] = (run, with_views(sql, *views.split()) if sql else None)
        return f

    return add


_STAR = "FROM relationships r JOIN entities s ON s.id = r.subject_id JOIN entities o ON o.id = r.object_id"
_NEWEST = "ORDER BY event_date DESC NULLS LAST, id DESC"


@query("relationship_query", "relationships entities", f"SELECT r.id, s.name AS subject, r.predicate, o.name AS object, r.event_date, r.confidence {_STAR} WHERE r.predicate = 'HIRED_BY' AND (r.event_date IS NULL OR r.event_date >= DATE '{SINCE}') ORDER BY r.event_date DESC NULLS LAST, r.id DESC LIMIT 100")
def _(r, e):
    return graph.query(r, e, predicate="HIRED_BY", since=SINCE).select("id", "subject", "predicate", "object", "event_date", "confidence")


@query("relationship_star", "relationships entities", f"SELECT r.id, s.name AS subject, s.entity_type AS subject_type, r.predicate, o.name AS object, o.entity_type AS object_type, r.event_date, r.context, r.source_url {_STAR}")
def _(r, e):
    return graph.star(r, e).select("id", "subject", "subject_type", "predicate", "object", "object_type", "event_date", "context", "source_url")


@query("entity_search", "entities", "SELECT id, name, entity_type, mention_count FROM entities WHERE contains(lower(name), 'acme') AND entity_type = 'company' ORDER BY mention_count DESC, id LIMIT 1000")
def _(e):
    return graph.search(e, "Acme", "company")


@query("both_ends_search", "relationships entities", f"""
, x AS (SELECT r.id, s.name AS subject, o.name AS object, r.event_date {_STAR}),
a AS (SELECT *, 0 AS side FROM x WHERE contains(lower(subject), 'acme') {_NEWEST} LIMIT 50), b AS (SELECT *, 1 AS side FROM x WHERE contains(lower(object), 'acme') {_NEWEST} LIMIT 50)
SELECT id, subject, object, min(side) AS side FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def _(r, e):
    return graph.search_both_ends(r, e, "Acme").select("id", "subject", "object", "side")


_ENDS = ", ends AS (SELECT DISTINCT id, predicate, event_date, source_url, subject_id, object_id, entity_id FROM (SELECT *, subject_id AS entity_id FROM relationships UNION ALL SELECT *, object_id FROM relationships))"


@query("company_signals", "relationships entities", _ENDS + """
SELECT e.id AS entity_id, e.name, count(DISTINCT CASE WHEN predicate = 'FUNDED_BY' AND subject_id = e.id THEN x.id END) AS fundings, count(DISTINCT CASE WHEN predicate = 'ACQUIRED' AND subject_id = e.id THEN x.id END) AS acquisitions,
 count(DISTINCT CASE WHEN predicate = 'ACQUIRED' AND object_id = e.id THEN x.id END) AS acquired, count(DISTINCT CASE WHEN predicate = 'HIRED_BY' AND object_id = e.id THEN x.id END) AS hires,
 count(DISTINCT CASE WHEN predicate = 'DEPARTED_FROM' AND object_id = e.id THEN x.id END) AS departures, count(DISTINCT CASE WHEN predicate = 'LAID_OFF' AND subject_id = e.id THEN x.id END) AS layoffs, max(event_date) AS last_date
FROM entities e LEFT JOIN ends x ON x.entity_id = e.id AND x.event_date >= DATE '1998-08-02' - INTERVAL 900 DAY WHERE e.entity_type = 'company' GROUP BY e.id, e.name""")
def _(r, e):
    return graph.company_signals(r, e, "1998-08-02", 900)


@query("multi_source", "relationships entities", _ENDS + " SELECT e.id AS entity_id, e.name, count(DISTINCT source_url) AS n_sources FROM ends JOIN entities e ON e.id = entity_id GROUP BY e.id, e.name HAVING count(DISTINCT source_url) > 1")
def _(r, e):
    return graph.multi_source(r, e)


@query("recent_events", "relationships entities", """
SELECT r.id, s.name AS subject, o.name AS object, r.event_date, r.confidence FROM relationships r LEFT JOIN entities s ON s.id = r.subject_id LEFT JOIN entities o ON o.id = r.object_id
WHERE r.confidence >= 0.7 AND r.id % 8 <> 5 ORDER BY r.event_date DESC NULLS LAST, r.id DESC""")
def _(r, e):
    events = r.withColumn("canonical_event_id", F.when(F.col("id") % 8 == 5, F.col("id") - 1))
    return graph.recent_events(events, e).select("id", "subject", "object", "event_date", "confidence")


@query("graph_stats", "relationships entities", "SELECT 'entities' AS what, coalesce(entity_type, 'all') AS kind, count(*) AS n FROM entities GROUP BY ROLLUP (entity_type) UNION ALL SELECT 'relationships', coalesce(predicate, 'all'), count(*) FROM relationships GROUP BY ROLLUP (predicate)")
def _(r, e):
    return graph.stats(r, e)


@query("latest_per_predicate", "relationships", f"SELECT id, predicate, event_date, place FROM (SELECT *, row_number() OVER (PARTITION BY predicate {_NEWEST}) AS place FROM relationships) WHERE place <= 5")
def _(r):
    return graph.latest_per_predicate(r).select("id", "predicate", "event_date", "place")


@query("career_paths", "relationships entities", f"SELECT r.id, s.name AS subject, r.predicate, o.name AS object, r.event_date, row_number() OVER (PARTITION BY r.subject_id ORDER BY r.event_date DESC NULLS LAST, r.id DESC) AS place {_STAR} WHERE r.predicate IN ('HIRED_BY', 'DEPARTED_FROM')")
def _(r, e):
    return graph.career(r, e).select("id", "subject", "predicate", "object", "event_date", "place")


@query("timeline", "relationships", f"""
, x AS (SELECT coalesce(event_date, DATE '{AS_OF}') AS day, predicate FROM (SELECT * FROM relationships WHERE event_date IS NULL OR event_date >= DATE '{SINCE}' {_NEWEST} LIMIT 200))
SELECT day, count(*) AS n, count(*) FILTER (predicate IN ('FUNDED_BY', 'RAISED_FUNDING')) AS n_funding, count(*) FILTER (predicate = 'ACQUIRED') AS n_acquisition, count(*) FILTER (predicate IN ('HIRED_BY', 'DEPARTED_FROM')) AS n_move,
 count(*) FILTER (predicate = 'LAID_OFF') AS n_layoff, count(*) FILTER (predicate NOT IN ('FUNDED_BY', 'RAISED_FUNDING', 'ACQUIRED', 'HIRED_BY', 'DEPARTED_FROM', 'LAID_OFF')) AS n_other FROM x GROUP BY day""")
def _(r):
    return graph.timeline(r, AS_OF, SINCE)


@query("type_inference", "relationships entities", """
, u AS (SELECT id, name FROM entities WHERE entity_type = 'unknown'),
n AS (SELECT u.id AS entity_id, u.name,
  (SELECT count(*) FROM relationships WHERE subject_id = u.id AND predicate IN ('CEO_OF', 'CTO_OF', 'CFO_OF', 'FOUNDED')) AS exec_role,
  (SELECT count(*) FROM relationships WHERE subject_id = u.id AND predicate = 'HIRED_BY') AS hired,
  (SELECT count(*) FROM relationships WHERE subject_id = u.id AND predicate = 'FUNDED_BY') AS funded,
  (SELECT count(*) FROM relationships WHERE object_id = u.id AND predicate = 'HIRED_BY') AS hiring,
  (SELECT count(*) FROM relationships WHERE subject_id = u.id AND predicate = 'ACQUIRED') AS acquiring FROM u)
SELECT *, CASE WHEN exec_role > 0 OR hired > 0 THEN 'person' WHEN funded > 0 OR hiring > 0 OR acquiring > 0 THEN 'company' ELSE 'unknown' END AS entity_type FROM n""")
def _(r, e):
    return graph.infer_types(r, e)


@query("insert_relationships", "relationships", f"""
, x AS (SELECT id % 40 AS k, subject_id % 200 AS subject_id, predicate, object_id % 100 AS object_id, event_date, id FROM relationships)
SELECT id, subject_id, predicate, object_id, event_date FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id, event_date ORDER BY id) AS n FROM x WHERE event_date IS NOT NULL) WHERE n = 1
UNION ALL SELECT id, subject_id, predicate, object_id, event_date FROM x WHERE event_date IS NULL""")
def _(r):
    rows = r.select("id", (F.col("subject_id") % 200).alias("subject_id"), "predicate", (F.col("object_id") % 100).alias("object_id"), "event_date")
    return tables.insert_relationships(rows)


@query("upsert_entities", "relationships entities", """
, m AS (SELECT CASE WHEN r.id % 2 = 0 THEN upper(e.name) ELSE ' ' || e.name END AS name, e.entity_type, r.id AS seq, r.event_date AS day, CASE WHEN r.id % 3 = 0 THEN '' ELSE 'a' || CAST(r.id AS VARCHAR) END AS attributes FROM relationships r JOIN entities e ON e.id = r.object_id)
SELECT trim(lower(name)) AS normalized_name, entity_type, arg_min(name, seq) AS name, count(*) AS mention_count, arg_max(attributes, seq) FILTER (attributes <> '') AS attributes, min(day) AS first_seen, max(day) AS last_seen FROM m GROUP BY 1, 2""")
def _(r, e):
    name = F.when(F.col("r.id") % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit(" "), "name"))
    m = r.alias("r").join(e.select(F.col("id").alias("object_id"), "name", "entity_type"), "object_id")
    return tables.upsert_entities(m.select(name.alias("name"), "entity_type", F.col("r.id").alias("seq"), F.col("event_date").alias("day"), F.when(F.col("r.id") % 3 == 0, "").otherwise(F.concat(F.lit("a"), F.col("r.id").cast("string"))).alias("attributes")))


@query("insert_articles", "articles", """
, t AS (SELECT DISTINCT url, content_hash FROM articles WHERE id % 50 = 0), f AS (SELECT * FROM articles a WHERE a.id % 50 <> 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.url = a.url) AND NOT EXISTS (SELECT 1 FROM t WHERE t.content_hash = a.content_hash)),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
SELECT id, url, content_hash FROM u QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1""")
def _(a):
    old = F.col("id") % 50 == 0
    return tables.insert_new(a.filter(~old), a.filter(old)).select("id", "url", "content_hash")


@query("article_stats", "articles", "SELECT count(*) AS total, count(*) FILTER (processed) AS processed, count(*) FILTER (NOT processed) AS unprocessed, count(*) FILTER (is_high_signal) AS high_signal, count(*) FILTER (is_high_signal AND NOT extracted) AS pending, count(*) FILTER (NOT processed) > 500 AS backlog_warning FROM articles")
def _(a):
    return tables.article_stats(a)


@query("unprocessed_articles", "articles", "SELECT id, title, published, feed_priority FROM articles WHERE NOT processed ORDER BY feed_priority, published DESC NULLS LAST, id LIMIT 500")
def _(a):
    return tables.unprocessed(a).select("id", "title", "published", "feed_priority")


@query("unextracted_articles", "articles", "SELECT id, title, published FROM articles WHERE is_high_signal AND NOT extracted ORDER BY published DESC NULLS LAST, id LIMIT 500")
def _(a):
    return tables.unextracted(a).select("id", "title", "published")


def _classifier_sql() -> str:
    from tidewire.functions.constants import EVENT_PATTERNS

    quoted = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    scores = {k: " + ".join(f"{w} * len(regexp_extract_all(t, {quoted(p)}))" for ps, w in ((s, 2), (x, 0.5)) for p in ps) for k, (s, x) in EVENT_PATTERNS.items()}
    cases = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in scores.items())
    best = f"greatest({', '.join(scores)})"
    kind = "CASE " + " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in scores) + " END"
    return f""", x AS (SELECT id, coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(content, '') AS t FROM articles), s AS (SELECT id, {cases} FROM x)
SELECT id, CASE WHEN {best} > 0 THEN {kind} ELSE 'other' END AS primary_type, CASE WHEN {best} > 0 THEN least(1.0, {best} / 5) ELSE 0.5 END AS confidence, {best} > 0 AND least(1.0, {best} / 5) >= 0.5 AS is_high_signal FROM s"""


@query("classify_articles", "articles", _classifier_sql())
def _(a):
    return a.select("id", T.classify(F.col("title"), F.col("content")).alias("c")).select("id", "c.primary_type", "c.confidence", "c.is_high_signal")


@query("extraction_potential", "articles", r"""
, x AS (SELECT id, lower(title || ' ' || content) AS t FROM articles), y AS (SELECT id, regexp_matches(t, '(?i)\$[\d,.]+\s*(million|billion|M|B)?') AS a, regexp_matches(t, 'ceo|cto|cfo|founder|president|partner|executive|chief') AS p,
 regexp_matches(t, '(inc\.|corp\.|llc|ltd\.)') AS c, regexp_matches(t, '(january|february|march|april|may|june|july|august|september|october|november|december|\d{4})') AS d FROM x), z AS (SELECT *, (CAST(a AS INT) + CAST(p AS INT) + CAST(c AS INT) + CAST(d AS INT)) / 4.0 AS s FROM y)
SELECT id, CAST(s AS DOUBLE) AS overall_score, a AS has_amounts, p AS has_person_names, c AS has_company_names, d AS has_dates, CASE WHEN s >= 0.6 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS extraction_potential FROM z""")
def _(a):
    return a.select("id", T.extraction_potential(F.col("title"), F.col("content")).alias("q")).select("id", "q.*")


def _suffix_sql(column: str, suffixes: list[str]) -> str:
    for s in suffixes:
        s = s.lower()
        column = f"regexp_replace({column}, '^(.*){s.replace('.', chr(92) + '.')}$', '\\1', 's')"
        column = f"trim({column})"
    return f"trim(regexp_replace(regexp_replace({column}, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("normalize_names", "names", f"SELECT id, {_suffix_sql('trim(lower(name))', ENTITY_SUFFIXES)} AS entity_key, {_suffix_sql('trim(lower(name))', FILING_SUFFIXES)} AS filing_key FROM names")
def _(n):
    return n.select("id", N.normalize_name(F.col("name")).alias("entity_key"), N.normalize_name(F.col("name"), FILING_SUFFIXES).alias("filing_key"))


@query("clean_names", "names", r"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(name, '<[^>]+>', '', 'g'), 'https?://[^\s]+', '', 'g'), '\s+', ' ', 'g')) AS sanitized,
 nullif(trim(regexp_extract(name, '^([A-Za-z0-9\s]+?)(?:\s+(?:Dec|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov)\s+\d{4})?\s+a\s+[Ss]eries\s+of', 1)), '') AS underlying,
 trim(regexp_replace(regexp_replace(trim(lower(name)), '\s*(inc\.?|llc|ltd\.?|corp\.?|co\.?|global|technologies|technology)$', ''), '\s+', ' ', 'g')) AS digest_key FROM names""")
def _(n):
    c = F.col("name")
    return n.select("id", N.sanitize_name(c).alias("sanitized"), N.underlying_company(c).alias("underlying"), N.digest_key(c).alias("digest_key"))


@query("name_checks", "names")
def _(n):
    c, k = F.col("name"), F.col("entity_type")
    return n.select("id", N.is_valid_name(c).alias("valid"), N.is_good_entity(c, k).alias("good"), N.is_fund(c).alias("fund"), N.is_organisation(c).alias("organisation"), N.is_digest_company(c).alias("digest"), N.is_person_name(c).alias("person"), N.clean_filing_name(c).alias("cleaned"), N.strip_one_suffix(c, k).alias("one_suffix"), N.url_slug(c).alias("slug"), N.guessed_domain(c).alias("domain"), N.canonical_alias(c).alias("canonical"))


@query("amounts", "names", r"""
SELECT id, coalesce(nullif(regexp_extract(context, '(?i)\$(\d+(?:,\d{3})*(?:\.\d+)?)\s*(million|billion|M|B)'), ''), nullif(regexp_extract(context, '\$(\d+(?:,\d{3})*(?:\.\d+)?)'), '')) AS amount_text,
 CAST(replace(coalesce(nullif(regexp_extract(context, '(?i)(\d+(?:,\d{3})*)\s*(?:employees|people|workers|staff)', 1), ''), nullif(regexp_extract(context, '(?i)laid off (\d+(?:,\d{3})*)', 1), '')), ',', '') AS BIGINT) AS layoff_count,
 TRY_CAST(regexp_replace(context, '[$,]', '', 'g') AS DOUBLE) AS parsed,
 CASE WHEN regexp_matches(context, 'seed|pre-seed|angel') THEN 'seed' WHEN regexp_matches(context, 'series a|series-a') THEN 'series_a' WHEN regexp_matches(context, 'series b|series-b') THEN 'series_b' WHEN regexp_matches(context, 'series c|series-c|series d|series e') THEN 'series_c'
  WHEN regexp_matches(context, 'funding|raises|raised|secures|closes|investment') THEN 'funding' END AS round_type FROM names""")
def _(n):
    c = F.col("context")
    return n.select("id", T.amount_text(c).alias("amount_text"), T.layoff_count(c).alias("layoff_count"), T.parse_amount(c).alias("parsed"), T.round_type(c).alias("round_type"))


@query("money_and_routing", "names")
def _(n):
    words = F.split(F.trim("name"), " ")
    return n.select("id", T.money(F.col("context")).alias("money"), T.routing(F.col("context"), F.slice(words, 1, 2), F.slice(words, 3, 2), F.array(F.lit(1.0)), T.round_type(F.col("context"))).alias("r")).select("id", "money", "r.*")


_TIERS = "(VALUES " + ", ".join(f"({k}, '{n}', '{d}', {t}, CAST({b} AS DOUBLE))" for k, (n, d, t, b) in enumerate(SOURCE_TIERS)) + ") t(ord, source, domain, tier, base)"
_SOURCED = f""", h AS (SELECT *, regexp_replace(lower(split_part(source_url, '/', 3)), '^www\\.', '') AS host FROM relationships),
m AS (SELECT host, arg_min({{{{'source': source, 'tier': tier, 'base': base}}}}, CASE WHEN host = domain THEN -1 ELSE ord END) AS s FROM (SELECT DISTINCT host FROM h) JOIN {_TIERS} ON host <> '' AND ends_with(host, domain) GROUP BY host),
q AS (SELECT h.*, coalesce(s.source, 'Unknown') AS source, coalesce(s.tier, 3) AS tier, coalesce(s.base, 0.5) AS base FROM h LEFT JOIN m USING (host))""".replace("{{", "{").replace("}}", "}")


def _tiers(df: DataFrame) -> DataFrame:
    return quality.tier_table(df.sparkSession)


@query("source_tiers", "relationships", _SOURCED + " SELECT source, tier, count(*) AS n, (SELECT round(100 * sum(CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.4 END) / count(*), 1) FROM q) AS quality FROM q GROUP BY source, tier")
def _(r):
    return quality.tier_report(r, _tiers(r))


@query("entity_confidence", "relationships entities", _SOURCED + """
, x AS (SELECT DISTINCT entity_id, source_url, tier, base FROM (SELECT subject_id AS entity_id, source_url, tier, base FROM q UNION ALL SELECT object_id, source_url, tier, base FROM q)),
c AS (SELECT entity_id, count(*) AS n, max(base) AS base, count(*) FILTER (tier = 1) AS t1, count(*) FILTER (tier = 2) AS t2, count(*) FILTER (tier = 3) AS t3 FROM x GROUP BY entity_id)
SELECT e.id AS entity_id, coalesce(least(1.0, base + least(0.15, 0.03 * n) + least(0.10, 0.05 * t1)), 0.5) AS confidence, coalesce(n, 0) AS n_sources, coalesce(t1, 0) AS tier1, coalesce(t2, 0) AS tier2, coalesce(t3, 0) AS tier3 FROM entities e LEFT JOIN c ON c.entity_id = e.id""")
def _(r, e):
    return quality.entity_confidence(r, e, _tiers(r))


@query("relationship_confidence", "relationships", _SOURCED + " SELECT id, round(coalesce(nullif(confidence, 0), 0.8) * base, 2) AS confidence FROM q")
def _(r):
    return quality.relationship_confidence(r, _tiers(r))


@query("feed_stats", "feed_log", """
, l AS (SELECT feed_id, list({'rate': 0.0::DOUBLE, 'ms': ms, 'fails': 0::BIGINT, 'articles': articles, 'ok': ok} ORDER BY ts, seq) AS xs, count(*) AS fetches, max(ts) AS last_ts FROM feed_log GROUP BY feed_id),
r AS (SELECT feed_id, fetches, last_ts, list_reduce(list_prepend({'rate': 1.0::DOUBLE, 'ms': 0::BIGINT, 'fails': 0::BIGINT, 'articles': 0::BIGINT, 'ok': true}, xs), lambda s, x: {'rate': 0.9::DOUBLE * s.rate + CASE WHEN x.ok THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 'ms': CAST(trunc(0.9::DOUBLE * s.ms + 0.1::DOUBLE * x.ms) AS BIGINT), 'fails': CASE WHEN x.ok THEN 0::BIGINT ELSE s.fails + 1 END, 'articles': s.articles + x.articles, 'ok': x.ok}) AS s FROM l)
SELECT feed_id, s.rate AS success_rate, s.ms AS avg_ms, s.fails AS failures, s.articles AS total_articles, fetches, last_ts FROM r""")
def _(log):
    return tables.feed_stats(log)


@query("feed_status", "feed_log", """
, l AS (SELECT DISTINCT feed_id FROM feed_log), t AS (SELECT feed_id, sum(articles) AS total_articles FROM feed_log WHERE feed_id % 5 > 0 GROUP BY feed_id)
SELECT l.feed_id, CAST(coalesce(total_articles, 0) AS BIGINT) AS total_articles, CASE WHEN l.feed_id % 9 = 0 THEN 'disabled' WHEN l.feed_id % 5 > 0 AND l.feed_id % 4 > 0 THEN 'warning' ELSE 'ok' END AS status,
 CASE l.feed_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority_label FROM l LEFT JOIN t USING (feed_id)""")
def _(log):
    own = log.select("feed_id").distinct().withColumns({"enabled": F.col("feed_id") % 9 != 0, "priority": F.col("feed_id") % 3})
    state = log.filter("feed_id % 5 > 0").groupBy("feed_id").agg(F.sum("articles").alias("total_articles"), F.lit(1.0).alias("success_rate"), F.max("ts").alias("last_ts")).withColumn("failures", F.col("feed_id") % 4)
    return feeds.with_status(feeds.with_stats(own, state)).select("feed_id", "total_articles", "status", "priority_label")


_TAGGED = "SELECT entity_id, tag FROM (SELECT object_id AS entity_id, lower(predicate) AS tag FROM relationships UNION SELECT subject_id, 'active' FROM relationships) WHERE NOT (tag = 'active' AND entity_id % 3 = 0)"


@query("tag_counts", "relationships", f"SELECT tag, count(*) AS n FROM ({_TAGGED}) GROUP BY tag")
def _(r):
    first = r.select(F.col("object_id").alias("entity_id"), F.lower("predicate").alias("tag")).distinct()
    added = tables.add_tags(first, r.select(F.col("subject_id").alias("entity_id"), F.lit(" Active").alias("tag")))
    gone = r.filter("subject_id % 3 = 0").select(F.col("subject_id").alias("entity_id"), F.lit("active").alias("tag"))
    return tables.tag_counts(tables.remove_tags(added, gone))


_ENRICHED = ", d AS (SELECT object_id AS entity_id, predicate AS source, event_date AS enriched_at, id AS seq, context FROM relationships WHERE event_date IS NOT NULL)"


def _documents(r: DataFrame) -> DataFrame:
    return r.filter("event_date is not null").select(F.col("object_id").alias("entity_id"), F.col("predicate").alias("source"), F.col("event_date").alias("enriched_at"), F.col("id").alias("seq"), "context")


@query("upsert_enrichment", "relationships", _ENRICHED + " SELECT entity_id, source, enriched_at, seq, context FROM d QUALIFY row_number() OVER (PARTITION BY entity_id, source ORDER BY enriched_at DESC, seq DESC) = 1")
def _(r):
    return tables.upsert_enrichment(_documents(r))


@query("unenriched_entities", "relationships entities", _ENRICHED + " SELECT id, name, mention_count FROM entities WHERE id NOT IN (SELECT entity_id FROM d) ORDER BY mention_count DESC, id LIMIT 50")
def _(r, e):
    return tables.unenriched(e, _documents(r)).select("id", "name", "mention_count")


@query("enrichment_coverage", "relationships entities", _ENRICHED + " SELECT count(*) AS entities, count(x.entity_id) AS enriched, CASE WHEN count(*) > 0 THEN round(100.0 * count(x.entity_id) / count(*), 1) ELSE 0.0 END AS coverage FROM entities LEFT JOIN (SELECT DISTINCT entity_id FROM d) x ON x.entity_id = id")
def _(r, e):
    return tables.coverage(e, _documents(r))


@query("id_remap", "relationships entities", "SELECT r.id, s.id + 7 AS subject_id, o.id + 7 AS object_id, CASE WHEN r.confidence = 0 THEN 0.8 ELSE r.confidence END AS confidence FROM relationships r JOIN entities s ON s.id = r.subject_id AND s.entity_type <> 'unknown' JOIN entities o ON o.id = r.object_id AND o.entity_type <> 'unknown'")
def _(r, e):
    return tables.remap(r, e.filter("entity_type <> 'unknown'").select(F.col("id").alias("old"), (F.col("id") + 7).alias("new")))[0].select("id", "subject_id", "object_id", "confidence")


@query("company_scores", "relationships entities", r"""
, x AS (SELECT subject_id AS id, 's' AS e, predicate AS p, context <> '' AND NOT contains(context, 'Form D') AS news FROM relationships UNION ALL SELECT object_id, 'o', predicate, context <> '' AND NOT contains(context, 'Form D') FROM relationships),
f AS (SELECT id, bool_or(news) AS news, count(*) FILTER (e = 's' AND p = 'FUNDED_BY') AS funded, count(*) FILTER (e = 's' AND p = 'RAISED_FUNDING') AS raised, count(*) FILTER (e = 's' AND p = 'ACQUIRED') AS buys, count(*) FILTER (e = 'o' AND p = 'ACQUIRED') AS sold,
 count(*) FILTER (e = 'o' AND p = 'HIRED_BY') AS hires, count(*) FILTER (e = 'o' AND p = 'DEPARTED_FROM') AS leaves, count(*) FILTER (e = 's' AND p = 'LAID_OFF') AS layoffs FROM x GROUP BY id)
SELECT c.id, c.name, CAST(CASE WHEN news THEN 20 ELSE 0 END + CASE WHEN funded > 0 THEN 35 WHEN raised > 0 THEN 25 ELSE 0 END + CASE WHEN buys > 0 THEN 30 ELSE 0 END + CASE WHEN sold > 0 THEN 20 ELSE 0 END + 3 * least(hires, 20) + 4 * least(leaves, 10) + CASE WHEN layoffs > 0 THEN 15 ELSE 0 END AS BIGINT) AS score,
 array_to_string(list_filter([CASE WHEN news THEN 'In News' END, CASE WHEN funded > 0 THEN 'Funded (News)' WHEN raised > 0 THEN 'Funded (SEC)' END, CASE WHEN buys > 0 THEN 'Acquiring (' || CAST(least(buys, 10) AS VARCHAR) || 'x)' END, CASE WHEN sold > 0 THEN 'Was acquired' END,
  CASE WHEN hires > 0 THEN 'Hiring (' || CAST(least(hires, 20) AS VARCHAR) || ' recent)' END, CASE WHEN leaves > 0 THEN 'Departures (' || CAST(least(leaves, 10) AS VARCHAR) || ')' END, CASE WHEN layoffs > 0 THEN 'Layoffs' END], lambda y: y IS NOT NULL), '; ') AS signals
FROM entities c JOIN f USING (id) WHERE c.entity_type = 'company' AND NOT regexp_matches(lower(c.name), '\bfund\s+(i|ii|iii|iv|v|vi|vii|viii|ix|x)\b') ORDER BY score DESC, c.id LIMIT 50""")
def _(r, e):
    return scoring.company_scores(r, e)


@query("candidate_scores", "relationships entities")
def _(r, e):
    return scoring.candidate_scores(r, e)


_LATEST = f", x AS (SELECT r.*, s.name AS subject, o.name AS object {_STAR})"


@query("funding_digest", "relationships entities", _LATEST + f"""
, l AS (SELECT *, row_number() OVER (ORDER BY b, event_date DESC NULLS LAST, id DESC) AS place FROM ((SELECT *, 0 AS b FROM x WHERE predicate = 'FUNDED_BY' {_NEWEST} LIMIT 40) UNION ALL (SELECT *, 1 FROM x WHERE predicate = 'RAISED_FUNDING' {_NEWEST} LIMIT 40))),
k AS (SELECT * FROM l WHERE event_date IS NULL OR event_date BETWEEN DATE '1990-01-01' AND DATE '2030-01-01' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY place) = 1)
SELECT subject AS company, object AS investor, coalesce(nullif(regexp_extract(context, '(?i)\\$(\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)\\s*(million|billion|M|B)'), ''), nullif(regexp_extract(context, '\\$(\\d+(?:,\\d{{3}})*(?:\\.\\d+)?)'), '')) AS amount, event_date AS date, CASE WHEN contains(context, 'Form D') THEN 'SEC' ELSE 'News' END AS source FROM (SELECT * FROM k ORDER BY place LIMIT 20) ORDER BY event_date DESC NULLS LAST, place""")
def _(r, e):
    return digest.fundings(r, e, "1990-01-01", "2030-01-01")


def _placed(*branches: tuple[str, int]) -> str:
    """Table l: the newest rows of each predicate with their place, in the order given."""
    parts = " UNION ALL ".join(f"(SELECT *, {k} AS b FROM x WHERE predicate = '{p}' {_NEWEST} LIMIT {n})" for k, (p, n) in enumerate(branches))
    return _LATEST + f", l AS (SELECT *, row_number() OVER (ORDER BY b, event_date DESC NULLS LAST, id DESC) AS place FROM ({parts}))"


def _first(keys: str, n: int) -> str:
    return f"(SELECT * FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY place) = 1) ORDER BY place LIMIT {n})"


_DIGEST_KEY = "trim(regexp_replace(regexp_replace(trim(lower({0})), '\\s*(inc\\.?|llc|ltd\\.?|corp\\.?|co\\.?|global|technologies|technology)$', ''), '\\s+', ' ', 'g'))"
_LAYOFF_COUNT = r"CAST(replace(coalesce(nullif(regexp_extract(context, '(?i)(\d+(?:,\d{3})*)\s*(?:employees|people|workers|staff)', 1), ''), nullif(regexp_extract(context, '(?i)laid off (\d+(?:,\d{3})*)', 1), '')), ',', '') AS BIGINT)"


@query("layoff_digest", "relationships entities", _placed(("LAID_OFF", 45)) + f" SELECT subject AS company, {_LAYOFF_COUNT} AS count, event_date AS date FROM {_first('lower(trim(subject))', 15)}")
def _(r, e):
    return digest.layoffs(r, e)


@query("acquisition_digest", "relationships entities", _placed(("ACQUIRED", 45)) + f" SELECT subject, object, event_date AS date FROM {_first(_DIGEST_KEY.format('subject') + ', ' + _DIGEST_KEY.format('object'), 15)}")
def _(r, e):
    return digest.acquisitions(r, e)


@query("move_digest", "relationships entities", _placed(("DEPARTED_FROM", 40), ("HIRED_BY", 40)) + f"""
SELECT subject AS person, CASE predicate WHEN 'HIRED_BY' THEN 'joined' ELSE 'left' END AS action, object AS company, event_date AS date FROM {_first('lower(trim(subject)), predicate, lower(trim(object))', 20)}""")
def _(r, e):
    return digest.moves(r, e)


@query("hot_candidates", "relationships entities", _placed(("DEPARTED_FROM", 50)) + f"""
, k AS {_first('lower(trim(subject))', 50)},
t AS (SELECT k.place, x.predicate, row_number() OVER (PARTITION BY k.place ORDER BY x.event_date DESC NULLS LAST, x.id DESC) AS n FROM k JOIN x ON contains(lower(trim(x.subject)), lower(k.subject))),
r AS (SELECT place, arg_min(predicate, n) AS role FROM t WHERE n <= 10 AND predicate IN ('CEO_OF', 'CTO_OF', 'CFO_OF', 'FOUNDED') GROUP BY place)
SELECT subject AS person, object AS left_company, coalesce(upper(left(role, 1)) || lower(replace(substr(role, 2), '_OF', '')), 'Executive') AS title, CASE WHEN role IS NULL THEN 70 ELSE 90 END AS score
FROM k LEFT JOIN r USING (place) ORDER BY score DESC, place LIMIT 15""")
def _(r, e):
    return digest.hot_candidates(r, e)


def _events(r: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = graph.star(r, e).filter("event_date is not null").withColumn("amount", T.money(F.col("context")))
    news = rows.filter("predicate = 'FUNDED_BY'").select(F.col("id").alias("event_id"), F.col("subject").alias("company_name"), "amount", F.col("event_date").alias("date"))
    filed = rows.filter("predicate = 'RAISED_FUNDING'").select(F.col("id").alias("event_id"), F.col("object").alias("company_name"), "amount", F.date_add("event_date", 11).alias("date"))
    return news, filed


@query("cross_reference", "relationships entities")
def _(r, e):
    return matching.cross_reference(*_events(r, e))


@query("unmatched_filings", "relationships entities")
def _(r, e):
    news, filed = _events(r, e)
    return matching.unmatched(filed, matching.cross_reference(news, filed), "f")


@query("confidence_boosts", "relationships entities")
def _(r, e):
    news, filed = _events(r, e)
    return matching.boosts(matching.cross_reference(news, filed), news)


@query("duplicate_merges", "names")
def _(n):
    rows = n.select("id", "name", "entity_type", (F.col("id") % 19).alias("mention_count"))
    return matching.merges(rows)


@query("company_facts", "relationships entities", f"""
, x AS (SELECT subject_id AS entity_id, predicate AS p, object_id AS other_id, event_date, id FROM relationships WHERE predicate IN ('FUNDED_BY', 'ACQUIRED') UNION ALL SELECT object_id, predicate, NULL, event_date, id FROM relationships WHERE predicate = 'HIRED_BY'),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY entity_id, p {_NEWEST}) <= 20)
SELECT entity_id, count(*) FILTER (p = 'FUNDED_BY') AS funding_rounds, coalesce(string_agg(DISTINCT e.name, '; ' ORDER BY e.name) FILTER (p = 'FUNDED_BY'), '') AS investors, CASE WHEN count(*) FILTER (p = 'ACQUIRED') > 0 THEN 'acquirer' END AS company_type,
 count(*) FILTER (p = 'HIRED_BY') > 0 AS is_hiring, count(*) FILTER (p = 'HIRED_BY') AS job_openings FROM k LEFT JOIN entities e ON e.id = other_id GROUP BY entity_id""")
def _(r, e):
    return profiles.company_facts(r, e)


@query("person_facts", "relationships entities", f"""
, x AS (SELECT subject_id AS entity_id, predicate AS p, name, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY event_date DESC NULLS LAST, r.id DESC) AS place FROM relationships r JOIN entities e ON e.id = r.object_id),
k AS (SELECT *, CASE p WHEN 'CEO_OF' THEN 1 WHEN 'CTO_OF' THEN 2 WHEN 'CFO_OF' THEN 3 WHEN 'FOUNDED' THEN 4 END AS rank FROM x WHERE (p = 'HIRED_BY' AND place <= 20) OR (p = 'DEPARTED_FROM' AND place <= 10) OR p IN ('CEO_OF', 'CTO_OF', 'CFO_OF', 'FOUNDED'))
SELECT entity_id, max(name) FILTER (p = 'HIRED_BY' AND place = 1) AS current_company, coalesce(string_agg(DISTINCT name, '; ' ORDER BY name) FILTER (p = 'DEPARTED_FROM' OR (p = 'HIRED_BY' AND place > 1)), '') AS previous_companies,
 CASE min(rank) WHEN 1 THEN 'CEO' WHEN 2 THEN 'CTO' WHEN 3 THEN 'CFO' WHEN 4 THEN 'Founder' END AS title FROM k GROUP BY entity_id""")
def _(r, e):
    return profiles.person_facts(r, e)


@query("leaders", "relationships entities")
def _(r, e):
    return profiles.leaders(r, e)


@query("profile_events", "relationships", f"""
, x AS (SELECT id, subject_id AS entity_id, object_id AS other_id, 'subject' AS side, predicate, event_date FROM relationships UNION ALL SELECT id, object_id, subject_id, 'object', predicate, event_date FROM relationships WHERE subject_id <> object_id)
SELECT *, row_number() OVER (PARTITION BY entity_id {_NEWEST}) AS place FROM x QUALIFY place <= 15""")
def _(r):
    return profiles.profile_events(r)


@query("profile_sources", "relationships", """
, x AS (SELECT entity_id, source_url, max((coalesce(event_date, DATE '0001-01-01'), id)) AS m FROM (SELECT subject_id AS entity_id, source_url, event_date, id FROM relationships UNION ALL SELECT object_id, source_url, event_date, id FROM relationships) WHERE source_url <> '' GROUP BY ALL)
SELECT entity_id, source_url, row_number() OVER (PARTITION BY entity_id ORDER BY m DESC) AS place FROM x QUALIFY place <= 10""")
def _(r):
    return profiles.profile_sources(r)


@query("enrichment_overlay", "relationships", _ENRICHED + """
, x AS (SELECT entity_id, 'last_' || lower(source) AS key, arg_max(context, seq) AS value FROM d GROUP BY ALL UNION ALL SELECT entity_id, 'source', arg_max(source, seq) FROM d GROUP BY ALL)
SELECT entity_id, string_agg(key || '=' || value, ';' ORDER BY key) AS data FROM x GROUP BY entity_id""")
def _(r):
    docs = _documents(r).select("entity_id", "seq", F.create_map(F.concat(F.lit("last_"), F.lower("source")), "context", F.lit("source"), "source").alias("data"))
    pairs = F.transform(F.map_entries("data"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return profiles.overlay(docs).select("entity_id", F.array_join(pairs, ";").alias("data"))


@query("entity_page", "entities", "SELECT id, name, entity_type, mention_count FROM entities ORDER BY mention_count DESC, id LIMIT 50 OFFSET 50")
def _(e):
    return profiles.page(e, 2).select("id", "name", "entity_type", "mention_count")


@query("entity_page_counts", "entities", "SELECT entity_type, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM entities GROUP BY entity_type")
def _(e):
    return profiles.page_counts(e)


@query("search_with_events", "relationships entities", f"""
, f AS (SELECT id AS entity_id, name FROM entities WHERE contains(lower(name), 'acme') ORDER BY mention_count DESC, id LIMIT 10),
x AS (SELECT subject_id, id, predicate, event_date, row_number() OVER (PARTITION BY subject_id {_NEWEST}) AS place FROM relationships QUALIFY place <= 5)
SELECT entity_id, name, x.id, predicate, event_date, place FROM f LEFT JOIN x ON subject_id = entity_id""")
def _(r, e):
    return profiles.hits_with_events(r, e, "Acme")


@query("acquisition_listing", "relationships entities", f"""
SELECT r.id, s.name AS subject, r.predicate, o.name AS object, r.event_date, 'acquisition' AS event_class, nullif(upper(left(split_part(h, '.', 1), 1)) || lower(substr(split_part(h, '.', 1), 2)), '') AS source_label
FROM (SELECT *, replace(split_part(source_url, '/', 3), 'www.', '') AS h FROM relationships) r JOIN entities s ON s.id = r.subject_id JOIN entities o ON o.id = r.object_id WHERE r.predicate = 'ACQUIRED' ORDER BY r.event_date DESC NULLS LAST, r.id DESC LIMIT 200""")
def _(r, e):
    return profiles.listing(r, e, "ACQUIRED")


@query("stamp_classified", "articles", """
SELECT id, processed OR id % 2 = 0 AS processed, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 'funding' ELSE 'old' END AS event_type, CASE WHEN id % 2 = 0 AND id % 5 > 0 THEN (id % 5) / 10.0::DOUBLE ELSE 0.9::DOUBLE END AS classification_confidence,
 CASE WHEN id % 2 = 0 THEN id % 4 = 0 ELSE is_high_signal END AS is_high_signal, extracted OR id % 7 = 0 AS extracted FROM articles""")
def _(a):
    old = a.select("id", "processed", F.lit(None).cast("timestamp").alias("processed_at"), F.lit("old").alias("event_type"), F.lit(0.9).alias("classification_confidence"), "is_high_signal", "extracted")
    new = a.filter("id % 2 = 0").select("id", F.when(F.col("id") % 3 != 0, "funding").otherwise("").alias("event_type"), ((F.col("id") % 5) / 10).alias("confidence"), (F.col("id") % 4 == 0).alias("is_high_signal"))
    return tables.stamp_extracted(tables.stamp_classified(old, new, "2024-06-30"), a.filter("id % 7 = 0")).drop("processed_at")


@query("layoff_results", "names", """
SELECT id, name AS subject, 'LAID_OFF' AS predicate, 'employees' AS object, 'Laid off ' || CAST(id % 90 AS VARCHAR) || ' employees' || CASE WHEN id % 4 > 0 THEN ' (' || CAST(id % 4 AS VARCHAR) || '% of workforce)' ELSE '' END AS context FROM names""")
def _(n):
    made = n.select("id", extraction.layoff_result(F.col("name"), F.col("id") % 90, F.col("id") % 4).alias("r"))
    return made.select("id", F.inline("r.relationships")).select("id", "subject", "predicate", "object", "context")


_MONEY = "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(m, '([\\d.]+)\\s*{word}', 1), '') AS DOUBLE) * {factor}" for word, factor in MULTIPLIERS) + ", TRY_CAST(m AS DOUBLE))"
_ROUND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(c, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in ROUNDS) + " END"


@query("funding_events", "relationships entities", f"""
, f AS (SELECT r.*, s.name AS subject, lower(r.context) AS c, trim(regexp_replace(lower(r.context), '[$,]', '', 'g')) AS m {_STAR} WHERE r.predicate IN ('FUNDED_BY', 'RAISED_FUNDING'))
SELECT id AS event_id, subject AS company_name, {_MONEY} AS amount, coalesce(event_date, DATE '{AS_OF}') AS date, {_ROUND} AS round_type, 'news' AS source_type, source_url, coalesce(confidence, 0.8) AS confidence FROM f""")
def _(r, e):
    return extraction.funding_events(graph.star(r, e), AS_OF)


@query("high_signal_since", "articles", f"SELECT id, url, title, published FROM articles WHERE is_high_signal AND published >= DATE '{SINCE}' ORDER BY published DESC, id LIMIT 100")
def _(a):
    return lookups.high_signal(a, SINCE).select("id", "url", "title", "published")


@query("articles_by_url", "articles", "SELECT url, min(id) AS id FROM articles WHERE url IN (SELECT url FROM articles WHERE extracted) GROUP BY url")
def _(a):
    return lookups.articles_at(a, a.filter("extracted")).select("url", "id")


@query("known_hashes", "articles", "SELECT content_hash, bool_or(processed) AS known FROM articles GROUP BY content_hash")
def _(a):
    return lookups.known_hashes(a, a.filter("processed"))


@query("entities_by_name", "entities", "SELECT a.name AS asked_name, a.kind AS asked_type, min(e.id) AS id, arg_min(e.name, e.id) AS name, arg_min(e.entity_type, e.id) AS entity_type FROM (SELECT DISTINCT upper(name) AS name, CASE WHEN id % 20 < 10 THEN 'company' END AS kind FROM entities) a JOIN entities e ON lower(trim(e.name)) = lower(trim(a.name)) AND (a.kind IS NULL OR a.kind = e.entity_type) GROUP BY a.name, a.kind")
def _(e):
    return lookups.entities_named(e, e.select(F.upper("name").alias("name"), F.when(F.col("id") % 20 < 10, "company").alias("entity_type")))


@query("valid_relationships", "relationships entities")
def _(r, e):
    return lookups.valid_relationships(graph.star(r, e)).select("id", "subject", "predicate", "object")


@query("person_fixes", "names")
def _(n):
    return lookups.person_fixes(n)


@query("person_fix_counts", "names")
def _(n):
    return lookups.fix_counts(lookups.person_fixes(n))


_TAGS = ", t AS (SELECT DISTINCT subject_id AS entity_id, lower(predicate) AS tag FROM relationships)"
_MERGES = ", m AS (SELECT id - 10 * (id // 10 % 4 - 1) AS keep, id AS merge FROM entities WHERE id // 10 % 4 IN (2, 3))"


def _tags(r: DataFrame) -> DataFrame:
    return r.select(F.col("subject_id").alias("entity_id"), F.lower("predicate").alias("tag")).distinct()


def _merges(e: DataFrame) -> DataFrame:
    turn = F.floor(F.col("id") / 10) % 4
    return e.filter(turn.isin(2, 3)).select((F.col("id") - 10 * (turn - 1)).alias("keep"), F.col("id").alias("merge"))


@query("entities_by_tag", "relationships entities", _TAGS + " SELECT tag, entity_id, name, mention_count, row_number() OVER (PARTITION BY tag ORDER BY mention_count DESC, id) AS place FROM t JOIN entities ON id = entity_id WHERE tag IN ('acquired', 'laid_off')")
def _(r, e):
    return lookups.tagged(e, _tags(r), r.filter("predicate IN ('ACQUIRED', 'LAID_OFF')").select(F.col("predicate").alias("tag")))


@query("tags_of_entities", "relationships", _TAGS + " SELECT entity_id, string_agg(tag, '; ' ORDER BY tag) AS tags FROM t GROUP BY entity_id")
def _(r):
    return lookups.gathered(_tags(r), "tag", "tags")


@query("enrichment_of_entities", "relationships entities", _ENRICHED + " SELECT entity_id, seq FROM d WHERE source = 'HIRED_BY' AND entity_id IN (SELECT id FROM entities WHERE entity_type = 'unknown')")
def _(r, e):
    return lookups.enrichment_of(_documents(r), e.filter("entity_type = 'unknown'").select(F.col("id").alias("entity_id")), "HIRED_BY").select("entity_id", "seq")


@query("merged_entities", "entities", _MERGES + """
, k AS (SELECT keep, sum(mention_count) AS more, arg_min(entity_type, (-mention_count, id)) FILTER (entity_type <> 'unknown') AS kind FROM m JOIN entities ON id = merge GROUP BY keep)
SELECT id, name, CASE WHEN entity_type = 'unknown' THEN coalesce(kind, entity_type) ELSE entity_type END AS entity_type, CAST(mention_count + coalesce(more, 0) AS BIGINT) AS mention_count FROM entities LEFT JOIN k ON keep = id WHERE id NOT IN (SELECT merge FROM m)""")
def _(e):
    return resolution.merged_entities(e, _merges(e))


@query("moved_tags", "relationships entities", _TAGS + _MERGES + " SELECT DISTINCT coalesce(keep, entity_id) AS entity_id, tag FROM t LEFT JOIN m ON merge = entity_id")
def _(r, e):
    return resolution.moved(_tags(r), resolution.in_turn(_merges(e), e), ["tag"])


@query("moved_enrichment", "relationships entities", _ENRICHED + _MERGES + """
, n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY entity_id, source ORDER BY enriched_at DESC, seq DESC) = 1)
SELECT coalesce(keep, entity_id) AS entity_id, source, seq FROM n LEFT JOIN m ON merge = entity_id LEFT JOIN entities x ON x.id = merge
QUALIFY row_number() OVER (PARTITION BY coalesce(keep, entity_id), source ORDER BY keep IS NOT NULL, x.mention_count DESC, entity_id) = 1""")
def _(r, e):
    return resolution.moved(tables.upsert_enrichment(_documents(r)), resolution.in_turn(_merges(e), e), ["source"]).select("entity_id", "source", "seq")


@query("aliases_of_entities", "entities", _MERGES + " SELECT entity_id, string_agg(name, '; ' ORDER BY name) AS aliases FROM (SELECT keep AS entity_id, name FROM m JOIN entities ON id = merge GROUP BY ALL) GROUP BY entity_id")
def _(e):
    return lookups.gathered(resolution.merge_aliases(e, resolution.in_turn(_merges(e), e)), "alias", "aliases")


@query("alias_resolution", "entities", _MERGES + """
, a AS (SELECT lower(trim(x.name)) AS key, k.entity_type, arg_min(k.name, k.id) AS owner FROM m JOIN entities x ON x.id = merge JOIN entities k ON k.id = keep GROUP BY ALL)
SELECT id, name, coalesce(owner, name) AS resolved FROM entities e LEFT JOIN a ON a.key = lower(trim(e.name)) AND a.entity_type = e.entity_type""")
def _(e):
    return lookups.resolve_aliases(e, resolution.merge_aliases(e, resolution.in_turn(_merges(e), e)), e).select("id", "name", "resolved")


@query("resolution_summary", "relationships entities")
def _(r, e):
    none = lambda kind: r.sparkSession.createDataFrame([], f"entity_id long, {kind}")
    return resolution.resolve(resolution.Tables(e, r, none("tag string"), none("source string"), none("normalized_alias string, alias string")))[1]


@query("digest_record", "relationships", f"""
, k AS (SELECT * FROM relationships WHERE event_date BETWEEN DATE '{SINCE}' AND DATE '{AS_OF}')
SELECT DATE '{SINCE}' AS period_start, DATE '{AS_OF}' AS period_end, count(*) FILTER (predicate IN ('FUNDED_BY', 'RAISED_FUNDING')) AS funding_count, count(*) FILTER (predicate = 'ACQUIRED') AS acquisition_count,
 count(*) FILTER (predicate = 'HIRED_BY') AS hire_count, count(*) FILTER (predicate = 'DEPARTED_FROM') AS departure_count, count(*) FILTER (predicate = 'LAID_OFF') AS layoff_count FROM k""")
def _(r):
    return digest.record(r, SINCE, AS_OF)


@query("landed_articles", "articles", f"""
, n AS (SELECT url, title, CASE WHEN id % 4 = 1 THEN content || ' In full.' ELSE content END AS content, substr(content, 1, 500) AS summary, CASE WHEN id % 7 <> 0 THEN published END AS published,
 substr(sha256(url || '|' || title), 1, 32) AS content_hash, feed_priority, id FROM articles WHERE url NOT LIKE '%0')
SELECT url, title, content, summary, published, content_hash FROM n WHERE published IS NULL OR published >= DATE '{SINCE}'
QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed_priority, id) = 1""")
def _(a):
    day = F.when(F.col("id") % 7 != 0, F.col("published").cast("timestamp"))
    entries = a.select(
        F.when(~F.col("url").endswith("0"), F.col("url")).alias("link"), "title", F.col("content").alias("summary"),
        F.when(F.col("id") % 4 == 1, F.array(F.concat("content", F.lit(" In full.")))).alias("contents"),
        F.when(F.col("id") % 2 == 0, day).alias("published"), day.alias("updated"), F.col("feed_priority").alias("feed_ord"), F.col("id").alias("entry_ord"),
    )
    rows = landed.merge_feeds(landed.normalize_entries(entries), SINCE)
    return rows.select("url", "title", "content", "summary", F.col("published").cast("date").alias("published"), "content_hash")


@query("landed_events", "articles", f"""
, n AS (SELECT id, url || '/' || replace(title, ' ', '-') AS link, CASE WHEN id % 5 = 0 THEN 'soon' ELSE strftime(published, '%Y%m%d') || '120000' END AS day, 'ECON_' || CAST(id % 40 AS VARCHAR) || ',12; ;TAX_' || content AS themes, title || ',3;Acme Inc.,9' AS orgs FROM articles WHERE id % 6 <> 1),
l AS (SELECT *, list_filter(list_transform(string_split(themes, ';'), lambda x: trim(split_part(x, ',', 1))), lambda x: x <> '')[1:10] AS t, list_filter(list_transform(string_split(orgs, ';'), lambda x: trim(split_part(x, ',', 1))), lambda x: x <> '')[1:10] AS o FROM n)
SELECT link AS url, left(replace(string_split(link, '/')[-1], '-', ' '), 100) AS title, CASE WHEN day = 'soon' THEN DATE '{AS_OF}' ELSE strptime(left(day, 8), '%Y%m%d')::DATE END AS published, 'gdelt:news.example.com' AS source, sha256(link) AS content_hash,
 'Organizations: ' || array_to_string(o[1:3], ', ') || '. Themes: ' || array_to_string(t[1:3], ', ') AS summary FROM l WHERE len(list_filter(t, lambda x: contains(lower(x), 'econ_1') OR contains(lower(x), 'workforce'))) > 0""")
def _(a):
    rows = a.withColumn("k", (F.col("id") % 40).cast("string")).select(
        F.when(F.col("id") % 6 != 1, F.concat("url", F.lit("/"), F.replace("title", F.lit(" "), F.lit("-")))).alias("DocumentIdentifier"),
        F.when(F.col("id") % 5 == 0, "soon").otherwise(F.concat(F.date_format("published", "yyyyMMdd"), F.lit("120000"))).alias("DATE"),
        F.concat(F.lit("ECON_"), "k", F.lit(",12; ;TAX_"), "content").alias("V2Themes"), F.concat("title", F.lit(",3;Acme Inc.,9")).alias("V2Organizations"),
        F.lit(None).cast("string").alias("V2Persons"), F.lit("").alias("V2Locations"), F.lit("2.5,1,2").alias("V2Tone"), F.lit("news.example.com").alias("SourceCommonName"),
    )
    told = landed.gkg_articles(landed.with_themes(landed.parse_gkg(rows, AS_OF), ["Econ_1", "WORKFORCE"]))
    return told.select("source", "url", "title", F.col("published").cast("date").alias("published"), "summary", "content_hash")


def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.daily_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("day", F.col("day").cast("date"))


_REGISTER["daily_event_counts"] = (_daily_counts, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")


from tidewire import catalog_jobs, catalog_sources  # noqa: E402, F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _REGISTER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTER.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _REGISTER["relationship_query"][0](spark, sf_dir)
