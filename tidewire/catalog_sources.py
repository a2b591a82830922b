"""Registered queries of landed files, copies between schemas, listings and name rules, each with its SQL.

Where no table holds landed files, their texts are made from a view's rows, so that the work grows with the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.catalog import _NEWEST, _STAR, query
from tidewire.functions import constants as K
from tidewire.functions import names as N
from tidewire.functions import texts as T
from tidewire.operators import graph, listings, lookups, migration, profiles
from tidewire.sources import cards, filings, landed

# --- name and routing rules in SQL


def _any(column: str, parts: list[str]) -> str:
    """SQL: the column holds any of the parts."""
    return "(" + " OR ".join(f"contains({column}, '{_quoted(p)}')" for p in parts) + ")"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _in(column: str, words: list[str]) -> str:
    return f"{column} IN (" + ", ".join(f"'{_quoted(w)}'" for w in words) + ")"


def _matches(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{_quoted(p)}')" for p in patterns) + ")"


def _cut(column: str, heads: list[str], flags: str = "") -> str:
    """SQL: each head in turn is cut from the start."""
    for head in heads:
        column = f"regexp_replace({column}, '^{_quoted(re.escape(head))}', ''{flags})"
    return column


def _trimmed(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def _cleaned(column: str) -> str:
    return _trimmed(rf"regexp_replace({_cut(column, K.PLACEHOLDERS)}, '^LLC (.*)$', '\1 LLC', 'is')")


def _valid(c: str) -> str:
    name = _trimmed(c)
    bad = f"{_in(f'lower({name})', K.INVALID_NAMES)} OR {_matches(name, K.INVALID_PATTERNS)} OR NOT regexp_matches({name}, '[a-zA-Z]') OR length({name}) < 2 OR regexp_matches({name}, '^(https?://|www\\.)')"
    return f"coalesce(length({c}) >= 2 AND NOT ({bad}), false)"


def _organisation(c: str) -> str:
    return f"({_any(f'upper({c})', K.ORGANISATION_PARTS)} OR starts_with(upper({c}), 'LLC ') OR starts_with(upper({c}), 'THE '))"


def _fund(c: str) -> str:
    return f"({_any(f'lower({c})', K.FUND_PARTS)} OR {_matches(f'lower({c})', K.FUND_PATTERNS)})"


def _person(c: str) -> str:
    return f"(length({c}) >= 3 AND NOT {_any(f'lower({c})', K.PERSON_DENIED)})"


_LOW = _trimmed("lower(name)")
_GOOD = rf"length(name) BETWEEN 2 AND 50 AND NOT {_any(_LOW, K.BAD_FRAGMENTS)} AND NOT {_in(_LOW, K.COMMON_WORDS)} AND (entity_type <> 'person' OR regexp_matches({_trimmed('name')}, '\S\s+\S'))"
_SLUG = "name"
for _s in K.URL_SUFFIXES:
    _SLUG = f"regexp_replace({_SLUG}, '{_quoted(re.escape(_s))}$', '')"
_SLUG = rf"regexp_replace(regexp_replace({_trimmed(f'lower({_SLUG})')}, '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g')"
_NAME = _trimmed("name")
_ONE = " ".join(f"WHEN ends_with({_NAME}, '{_quoted(s)}') THEN {_trimmed(f'left({_NAME}, length({_NAME}) - {len(s)})')}" for s in K.ONE_SUFFIX)


@query("name_rules", "names", f"""
SELECT id, {_valid('name')} AS valid, {_GOOD} AS good, {_fund('name')} AS fund, {_organisation('name')} AS organisation, length(name) >= 2 AND NOT {_any('lower(name)', K.DIGEST_DENIED)} AS digest, {_person('name')} AS person,
 {_cleaned('name')} AS cleaned, CASE WHEN entity_type = 'company' THEN CASE {_ONE} ELSE {_NAME} END ELSE name END AS one_suffix, {_SLUG} AS slug, CASE WHEN replace({_SLUG}, '-', '') <> '' THEN replace({_SLUG}, '-', '') || '.com' END AS domain FROM names""")
def _(n):
    c, k = F.col("name"), F.col("entity_type")
    one = F.when(k == "company", N.strip_one_suffix(c, k)).otherwise(c)
    return n.select(
        "id", N.is_valid_name(c).alias("valid"), N.is_good_entity(c, k).alias("good"), N.is_fund(c).alias("fund"), N.is_organisation(c).alias("organisation"), N.is_digest_company(c).alias("digest"),
        N.is_person_name(c).alias("person"), N.clean_filing_name(c).alias("cleaned"), one.alias("one_suffix"), N.url_slug(c).alias("slug"), N.guessed_domain(c).alias("domain"),
    )


_MONEY = "trim(regexp_replace(lower(context), '[$,]', '', 'g'))"
_FACTORS = ", ".join(rf"TRY_CAST(nullif(regexp_extract(m, '([\d.]+)\s*{word}', 1), '') AS DOUBLE) * {factor:.0f}" for word, factor in K.MULTIPLIERS)


@query("money_and_routes", "names", f"""
, c AS (SELECT id, {_MONEY} AS m, lower(context) AS low, {_any('lower(context)', K.ACQUISITION_WORDS)} AS bought, {_any('lower(context)', K.EXECUTIVE_WORDS)} AS moved, {_any('lower(context)', K.LAYOFF_WORDS)} AS cut,
 CASE {" ".join(f"WHEN {_any('context', words)} THEN '{kind}'" for kind, words in K.ROUNDS)} END AS kind, id % 4 AS orgs, id % 3 AS people FROM names),
d AS (SELECT *, kind IS NOT NULL OR {_any('low', dict(K.ROUNDS)['funding'])} AS funded FROM c),
r AS (SELECT id, coalesce({_FACTORS}, TRY_CAST(m AS DOUBLE)) AS money, CASE WHEN bought THEN CASE WHEN orgs >= 2 THEN 'acquisition_multiple_orgs' ELSE 'acquisition_unclear_parties' END WHEN moved AND people > 0 AND orgs > 1 THEN 'executive_multiple_orgs'
 WHEN moved AND people > 1 THEN 'executive_multiple_people' WHEN moved AND orgs = 1 AND people = 1 THEN NULL WHEN cut THEN 'layoff_details' WHEN funded AND orgs = 1 AND kind IS NOT NULL THEN NULL WHEN funded AND orgs >= 2 THEN 'funding_multiple_orgs'
 WHEN NOT (bought OR moved OR cut OR funded) THEN 'unclear_event_type' ELSE 'complex_extraction' END AS reason FROM d)
SELECT id, money, reason IS NOT NULL AS needs_deep, reason FROM r""")
def _(n):
    some = lambda k: F.array_repeat(F.lit("x"), (F.col("id") % k).cast("int"))
    told = T.routing(F.col("context"), some(4), some(3), F.array(F.lit(1.0)), T.round_type(F.col("context")))
    return n.select("id", T.money(F.col("context")).alias("money"), told.alias("r")).select("id", "money", "r.*")


_FIXED = f""", p AS (SELECT id, name, {_cleaned('name')} AS new_name FROM names WHERE entity_type = 'person' AND regexp_matches(name, '{_quoted(K.MISLABELLED_PATTERN)}')),
f AS (SELECT *, CASE WHEN {_organisation('new_name')} THEN 'company' ELSE 'person' END AS new_type FROM p)"""


@query("fixed_people", "names", _FIXED + " SELECT id, name, new_name, new_type FROM f WHERE new_name <> name OR new_type <> 'person'")
def _(n):
    return lookups.person_fixes(n)


@query("fixed_people_counts", "names", _FIXED + " SELECT count(*) FILTER (new_name <> name) AS fixed_names, count(*) FILTER (new_type <> 'person') AS fixed_types FROM f WHERE new_name <> name OR new_type <> 'person'")
def _(n):
    return lookups.fix_counts(lookups.person_fixes(n))


_ODD = "CASE id % 9 WHEN 1 THEN 'reuters' WHEN 2 THEN o WHEN 3 THEN 'company' WHEN 4 THEN 'pat' WHEN 5 THEN '12345' ELSE s END"


@query("relationship_rules", "relationships entities", f"""
, x AS (SELECT r.id, r.predicate, s.name AS s, o.name AS o {_STAR}), y AS (SELECT id, predicate, {_ODD} AS subject, o AS object FROM x)
SELECT id, subject, predicate, object, CASE WHEN NOT {_valid('subject')} THEN 'Invalid subject: ' || subject WHEN NOT {_valid('object')} THEN 'Invalid object: ' || object WHEN lower({_trimmed('subject')}) = lower({_trimmed('object')}) THEN 'Self-reference: ' || subject
 WHEN predicate = 'ACQUIRED' AND ({_in('lower(subject)', K.GENERIC_TERMS)} OR {_in('lower(object)', K.GENERIC_TERMS)}) THEN 'Generic acquisition target: ' || subject || ' -> ' || object
 WHEN predicate IN ('HIRED_BY', 'DEPARTED_FROM') AND NOT regexp_matches({_trimmed('subject')}, '\\s') AND NOT regexp_matches(subject, '^\\p{{Lu}}') THEN 'Subject doesn''t look like person name: ' || subject ELSE 'OK' END AS reason FROM y""")
def _(r, e):
    odd = F.expr("CASE id % 9 WHEN 1 THEN 'reuters' WHEN 2 THEN object WHEN 3 THEN 'company' WHEN 4 THEN 'pat' WHEN 5 THEN '12345' ELSE subject END")
    rows = graph.star(r, e).select("id", "predicate", odd.alias("subject"), "object")
    return rows.withColumn("reason", N.relationship_reason(F.col("subject"), F.col("predicate"), F.col("object")))


_TITLES = list(profiles.TITLES)


@query("executives", "relationships entities", f"""
, x AS (SELECT r.id, r.subject_id, s.name AS subject, r.predicate, o.name AS company, r.event_date, coalesce(r.context <> '' AND NOT contains(r.context, 'Form D'), false) AS in_news {_STAR}
 WHERE {_in('r.predicate', [*_TITLES, 'EXECUTIVE_OF', 'OFFICER_OF', 'DIRECTOR_OF'])} AND s.entity_type = 'person' AND {_person('s.name')} AND NOT {_fund('o.name')})
SELECT subject_id, subject, predicate, company, in_news FROM x QUALIFY row_number() OVER (PARTITION BY subject_id {_NEWEST}) = 1""")
def _(r, e):
    return profiles.leaders(r, e)


# --- landed files


@query("landed_feeds", "names", """
SELECT p AS page, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS ord, 'Feed ' || id AS name, 'https://f.example/' || id AS url, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE id % 5 END AS INT) AS priority, id % 4 <> 1 AS enabled, CAST(CASE WHEN id % 2 = 0 THEN 60 ELSE 15 END AS INT) AS fetch_interval_minutes
FROM (SELECT id, id // 25 AS p FROM names)""")
def _(n):
    i = F.col("id").cast("string")
    extra = F.concat(
        F.when(F.col("id") % 3 != 0, F.concat(F.lit(', "priority": '), (F.col("id") % 5).cast("string"))).otherwise(""), F.when(F.col("id") % 4 == 1, ', "enabled": false').otherwise(""),
        F.when(F.col("id") % 2 != 0, ', "fetch_interval_minutes": 15').otherwise(""),
    )
    one = F.concat(F.lit('{"name": "Feed '), i, F.lit('", "url": "https://f.example/'), i, F.lit('"'), extra, F.lit("}"))
    listed = n.select(F.floor(F.col("id") / 25).alias("page"), F.struct("id", one.alias("one")).alias("f")).groupBy("page").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    text = F.concat(F.lit("["), F.array_join(F.transform("fs", lambda f: f["one"]), ","), F.lit("]"))
    kind = landed.FEEDS.partition(" ")[2]
    return landed.feed_rows(listed.select("page", F.from_json(text, kind).alias("feeds")), "page").select("page", "ord", "name", "url", "priority", "enabled", "fetch_interval_minutes")


@query("landed_layoffs", "articles", f"""
, n AS (SELECT id, CASE WHEN id % 9 = 2 THEN NULL ELSE title END AS company, CASE WHEN id % 7 = 3 THEN NULL ELSE published END AS date, CASE WHEN id % 4 = 0 THEN NULL ELSE 1000 + id % 500 END AS employees, CASE WHEN id % 3 = 0 THEN 12.5 WHEN id % 3 = 1 THEN 7 END AS per_cent FROM articles)
SELECT company, date, employees, CAST(per_cent AS DOUBLE) AS percent, 'Oslo' AS location FROM n WHERE company IS NOT NULL AND date >= DATE '1998-01-01' - 400 AND coalesce(employees, 0) >= 1100""")
def _(a):
    i = F.col("id")
    day = F.when(i % 7 == 3, "next week").when(i % 2 == 0, F.date_format("published", "yyyy-MM-dd")).otherwise(F.date_format("published", "MM/dd/yyyy"))
    count = F.concat(F.lit("about 1,"), F.lpad((i % 500).cast("string"), 3, "0"))
    rows = a.select(
        F.when(i % 9 != 2, F.col("title")).alias("Company"), day.alias("Date"), F.when(i % 4 != 0, count).otherwise("many").alias("# Laid Off"),
        F.when(i % 3 == 0, "12.5%").when(i % 3 == 1, "up to 7 %").otherwise("all").alias("%"), F.lit("Oslo").alias("Location_HQ"),
    )
    return landed.parse_layoffs(rows, "1998-01-01", 400, 1100).select("company", "date", "employees", "percent", "location")


@query("landed_filings", "articles", f"""
SELECT id AS cik, CASE WHEN id % 8 <> 5 THEN published END AS date, CASE WHEN id % 6 = 1 THEN NULL ELSE CAST(1000000 + id AS DOUBLE) END AS amount FROM articles WHERE id % 8 = 5 OR published >= DATE '1998-01-01' - 300 ORDER BY date DESC NULLS LAST, cik LIMIT 500""")
def _(a):
    i = F.col("id")
    told = F.concat(F.lit("$"), F.format_number(1000000 + i, 0))
    rows = a.select(i.alias("cik"), F.when(i % 8 == 5, "unknown").otherwise(F.date_format("published", "yyyy-MM-dd")).alias("filing_date"), F.when(i % 6 == 1, "n/a").otherwise(told).alias("total_amount"))
    return landed.recent_filings(rows, "1998-01-01", 300).select("cik", "date", "amount")


_FILED = rf""", f AS (SELECT id, 'A-' || id AS file_number, CASE WHEN id % 4 = 1 THEN 'Plain ' || id ELSE name END AS company_name, CASE WHEN id % 3 <> 0 THEN 100000 + id * 7 END AS amount, id % 20 AS investors FROM names),
c AS (SELECT *, {_cleaned('company_name')} AS company FROM f),
u AS (SELECT *, nullif({_trimmed(r"regexp_extract(company, '^([A-Za-z0-9\s]+?)(?:\s+(?:Dec|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov)\s+\d{4})?\s+a\s+[Ss]eries\s+of', 1)")}, '') AS behind FROM c),
o AS (SELECT id, 0 AS place, 'Ann Berg ' || id AS person, 'Director' AS role FROM names WHERE id % 2 = 0 UNION ALL SELECT id, 1, 'Nord Capital LLC', CASE WHEN id % 5 = 0 THEN 'Executive Officer' ELSE 'Promoter' END FROM names WHERE id % 2 = 0)"""


def _filings(n: DataFrame) -> DataFrame:
    """Landed filings made from names, parsed; every second one has two officers and one person without name."""
    i = F.col("id")
    person = lambda first, last: F.struct(first.cast("string").alias("first_name"), last.cast("string").alias("last_name"))
    people = F.array(person(F.lit("Ann"), F.concat(F.lit("Berg "), i.cast("string"))), person(F.lit("Nord Capital"), F.lit("LLC ")), person(F.lit(None), F.lit(" ")))
    issuer = F.struct(F.when(i % 4 != 1, F.col("name")).otherwise("").alias("entity_name"), F.lit("DE").alias("jurisdiction"), F.lit("Corporation").alias("entity_type"), F.lit(1999).alias("year_of_incorporation"))
    rows = n.select(
        issuer.alias("issuer"), F.concat(F.lit("Plain "), i.cast("string")).alias("company"), i.alias("cik"), F.concat(F.lit("A-"), i.cast("string")).alias("accession_no"), F.lit("2024-01-05").alias("filing_date"),
        F.when(i % 3 != 0, F.concat(F.lit("$"), F.format_number(100000 + i * 7, 0))).otherwise("Indefinite").alias("total_offering_amount"), F.lit(None).cast("string").alias("total_amount_sold"),
        (i % 20).cast("int").alias("total_already_invested"), F.when(i % 2 == 0, people).alias("related_persons"),
    )
    second = F.when(F.col("cik").cast("bigint") % 5 == 0, "Executive Officer").otherwise("Promoter")
    return filings.parse_filings(rows).withColumn("officer_roles", F.array(F.lit("Director"), second))


@query("filed_entities", "names", _FILED + f"""
SELECT file_number, company AS name, 'company' AS entity_type, 0.95::DOUBLE AS confidence FROM u UNION ALL SELECT file_number, behind, 'company', 0.75 FROM u WHERE behind <> company
UNION ALL SELECT file_number, person, CASE WHEN {_organisation('person')} THEN 'company' ELSE 'person' END, 0.95 FROM o JOIN u USING (id)""")
def _(n):
    return filings.filing_results(_filings(n)).select("file_number", F.explode("result.entities").alias("e")).select("file_number", "e.*")


@query("filed_edges", "names", _FILED + f"""
SELECT file_number, person AS subject, CASE WHEN {_organisation('person')} THEN 'company' ELSE 'person' END AS subject_type, CASE WHEN contains(role, 'Director') THEN 'DIRECTOR_OF' WHEN contains(role, 'Executive') THEN 'EXECUTIVE_OF' ELSE 'OFFICER_OF' END AS predicate, company AS object, 'company' AS object_type, 'SEC Form D filing ' || file_number AS context
FROM o JOIN u USING (id) UNION ALL SELECT file_number, coalesce(behind, company), 'company', 'RAISED_FUNDING', 'Undisclosed Investors', 'investor', '$' || format('{{:,}}', amount) || ' raised via SEC Form D (' || investors || ' investors)' FROM u WHERE amount > 0""")
def _(n):
    return filings.filing_results(_filings(n)).select("file_number", F.explode("result.relationships").alias("r")).select("file_number", "r.*").drop("confidence")


_HIT = """, h AS (SELECT id, name, 'co-' || id AS slug, (['W24', 'S24', 'W23', 'S22', 'W21'])[id % 5 + 1] AS batch, CASE WHEN id % 6 = 2 THEN 'Acquired' ELSE 'Active' END AS status,
 CASE WHEN id % 4 = 0 THEN 'Long ' || repeat('word ', 60) ELSE 'Tools of ' || name END AS told, id % 3 = 0 AS two, CASE WHEN id % 7 = 0 THEN 'https://dir.example/companies/co-' || id ELSE 'https://' || id || '.example' END AS website, CASE WHEN id % 2 = 0 THEN 'Oslo' ELSE 'Bergen' END AS location FROM names WHERE id % 11 <> 4)"""


def _directory(n: DataFrame) -> DataFrame:
    """Directory hits made from names, as JSON texts, parsed."""
    i = F.col("id")
    founder = lambda name, title: F.struct(name.alias("full_name"), F.lit(title).alias("title"))
    founders = F.when(i % 3 == 0, F.array(founder(F.concat(F.lit("Ann "), i.cast("string")), "CEO"), founder(F.lit("Bo Li"), "CTO"), founder(F.lit(""), "x")))
    industries = F.when(i % 2 == 0, F.array(F.lit("Fintech"), F.lit("B2B"))).otherwise(F.array(F.lit("Health")))
    hit = F.to_json(F.struct(
        F.when(i % 11 != 4, F.col("name")).alias("name"), F.concat(F.lit("co-"), i.cast("string")).alias("slug"), F.get(F.array(*map(F.lit, ("W24", "S24", "W23", "S22", "W21"))), (i % 5).cast("int")).alias("batch"),
        F.when(i % 6 == 2, "Acquired").alias("status"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Tools of "), "name")).alias("one_liner"), F.concat(F.lit("Long "), F.repeat(F.lit("word "), 60)).alias("long_description"),
        industries.alias("industries"), F.when(i % 2 == 0, "Oslo").alias("location"), F.lit("Bergen").alias("city"), F.when(i % 7 != 0, F.concat(F.lit("https://"), i.cast("string"), F.lit(".example"))).alias("website"), founders.alias("founders"),
    ))
    return filings.parse_directory(n.select(hit.alias("hit")), "https://dir.example/companies/")


@query("directory_companies", "names", _HIT + """
SELECT name, slug, batch, status, left(told, 200) AS description, website, location, CASE WHEN two THEN 3 END AS founders FROM h WHERE batch IN ('W24', 'S24', 'W23', 'S23') AND status = 'Active' AND id % 2 = 0 ORDER BY name, slug LIMIT 500""")
def _(n):
    rows = filings.chosen(_directory(n), filings.recent_batches(2024), "Active", "Fintech", 500)
    return rows.select("name", "slug", "batch", "status", "description", "website", "location", F.when(F.col("founders").isNotNull(), F.size("founders")).alias("founders"))


@query("directory_edges", "names", _HIT + """
SELECT slug, 'Ann ' || id AS subject, 'FOUNDED' AS predicate, name AS object, 'Acc ' || batch || ' batch' AS context FROM h WHERE two UNION ALL SELECT slug, 'Bo Li', 'FOUNDED', name, 'Acc ' || batch || ' batch' FROM h WHERE two
UNION ALL SELECT slug, name, 'FUNDED_BY', 'Accelerator', 'Acc ' || batch || ' batch' FROM h""")
def _(n):
    rows = filings.directory_results(_directory(n), "Accelerator", "Acc").select("slug", F.explode("result.relationships").alias("r"))
    return rows.select("slug", "r.subject", "r.predicate", "r.object", "r.context")


@query("landed_cards", "entities", """
, n AS (SELECT id, name, id // 40 % 25 AS page_id, id // 10 % 4 AS turn FROM entities),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY id) - 1 AS place FROM n WHERE turn <> 3)
SELECT page_id, place, CASE WHEN turn = 1 THEN name || ' & Co' ELSE name END AS name, 'n' || id AS slug, 'Active' AS status, CASE WHEN turn = 1 THEN 'https://d.example/companies/n' ELSE '/companies/n' END || id AS website FROM c WHERE place < 15 AND turn <> 2""")
def _(e):
    i, turn = F.col("id").cast("string"), F.floor(F.col("id") / 10) % 4
    card = (
        F.when(turn == 0, F.concat(F.lit('<a class="_c company-row" href="/companies/n'), i, F.lit('"><img src=x.png><div><span class="co-name">'), "name", F.lit("</span><span>Oslo</span></div></a>")))
        .when(turn == 1, F.concat(F.lit("<a href='https://d.example/companies/n"), i, F.lit("' class=company><span class='pill'><span class='the name'> <b>"), "name", F.lit("</b> &amp; Co\n</span></span></a>")))
        .when(turn == 2, F.concat(F.lit('<A CLASS="company" HREF="/companies/n'), i, F.lit('"><span>'), "name", F.lit("</span></A>")))
        .otherwise(F.concat(F.lit('<a class="person" href="/p/'), i, F.lit('"><span class="name">'), "name", F.lit("</span></a>")))
    )
    rows = e.select((F.floor(F.col("id") / 40) % 25).alias("page_id"), F.struct("id", card.alias("card")).alias("c")).groupBy("page_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    head = F.lit('<html><script>var a = "<a class=company>";</script><!-- <a class="company"> --><body>')
    pages = rows.select("page_id", F.concat(head, F.array_join(F.transform("cs", lambda c: c["card"]), "\n"), F.lit("</body></html>")).alias("html"))
    return cards.company_cards(pages, limit=15).select("page_id", "place", "name", "slug", "status", "website")


# --- copy to another schema

_NEW = r"regexp_replace(md5('tide:' || id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"


@query("copied_articles", "articles", """
SELECT url, title, content_hash, is_high_signal, CASE WHEN processed THEN 'classified' ELSE 'pending' END AS classification_status, CASE WHEN extracted THEN 'extracted' ELSE 'pending' END AS extraction_status FROM articles
WHERE url NOT IN (SELECT url FROM articles WHERE id % 1200 < 100) QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1""")
def _(a):
    return migration.articles_to_copy(a, a.filter("id % 1200 < 100")).select("url", "title", "content_hash", "is_high_signal", "classification_status", "extraction_status")


def _enrichment(e: DataFrame) -> DataFrame:
    """Up to two enrichment rows of an entity, one of them null."""
    k = F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("k")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int"))
    rows = e.select(F.col("id").alias("entity_id"), k).filter("k > 0")
    return rows.select("entity_id", F.concat(F.lit("s"), F.col("k").cast("string")).alias("source"), F.when(F.col("entity_id") % 4 != 0, F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}"))).alias("data"), day.alias("enriched_at"))


@query("copied_entities", "entities", "SELECT " + _NEW + """ AS id, name, entity_type, CASE WHEN coalesce(mention_count, 0) = 0 THEN 1 ELSE mention_count END AS mention_count,
 CASE WHEN id % 3 = 0 THEN NULL WHEN id % 4 = 0 THEN '{}' ELSE '{"k": ' || (id % 3) || '}' END AS enrichment_data, CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'enriched' END AS enrichment_status FROM entities""")
def _(e):
    copied, ids = migration.entities_to_copy(e, "tide")
    return migration.with_enrichment(copied, _enrichment(e), ids).select("id", "name", "entity_type", "mention_count", "enrichment_data", "enrichment_status")


@query("copy_record", "articles entities relationships", """
, e AS (SELECT id FROM entities WHERE entity_type <> 'unknown'), r AS (SELECT subject_id IN (SELECT id FROM e) AND object_id IN (SELECT id FROM e) AS whole FROM relationships)
SELECT 'articles' AS what, count(DISTINCT url) AS n FROM articles UNION ALL SELECT 'entities', count(*) FROM e UNION ALL SELECT 'relationships', count(*) FILTER (whole) FROM r UNION ALL SELECT 'skipped', count(*) FILTER (NOT whole) FROM r
UNION ALL SELECT 'enrichment', count(*) FILTER (id % 3 > 0) FROM e""")
def _(a, e, r):
    known = e.filter("entity_type <> 'unknown'")
    return migration.migration_record(migration.migrate({"articles": a, "entities": known, "relationships": r, "enrichment": _enrichment(e)}, "tide"))


# --- listings


@query("overview", "relationships entities articles", """
SELECT 'entities' AS what, entity_type AS kind, count(*) AS n FROM entities GROUP BY ALL UNION ALL SELECT 'entities', 'all', count(*) FROM entities UNION ALL SELECT 'relationships', predicate, count(*) FROM relationships GROUP BY ALL UNION ALL SELECT 'relationships', 'all', count(*) FROM relationships
UNION ALL SELECT 'articles', 'total', count(*) FROM articles UNION ALL SELECT 'articles', 'processed', count(*) FROM articles WHERE processed UNION ALL SELECT 'articles', 'high_signal', count(*) FROM articles WHERE is_high_signal""")
def _(r, e, a):
    return listings.overview(r, e, a)


@query("newest_acquisitions", "relationships entities", f"""
SELECT r.id, s.name AS subject, o.name AS object, CAST(round(r.confidence * 100) AS INT) AS per_cent, r.event_date, left(r.source_url, 50) AS source {_STAR} WHERE r.predicate = 'ACQUIRED' ORDER BY r.event_date DESC NULLS LAST, r.id DESC LIMIT 20""")
def _(r, e):
    return listings.acquisitions(r, e)


@query("entity_listing", "entities", """
, s AS (SELECT * FROM entities WHERE contains(lower(name), 'e') ORDER BY mention_count DESC, id LIMIT 1000) SELECT id, entity_type, name, mention_count FROM s WHERE entity_type = 'company' ORDER BY mention_count DESC, id LIMIT 50""")
def _(e):
    return listings.entity_listing(e, "e", "company")


@query("search_listing", "relationships entities", f"""
, h AS (SELECT id AS hit_id, name AS hit FROM entities WHERE contains(lower(name), 'pat lee 1') ORDER BY mention_count DESC, id LIMIT 10),
x AS (SELECT hit_id, r.id, r.predicate, o.name AS object, row_number() OVER (PARTITION BY hit_id ORDER BY r.event_date DESC NULLS LAST, r.id DESC) AS place {_STAR} JOIN h ON contains(lower(s.name), lower(h.hit)))
SELECT h.hit_id, h.hit, x.id, x.predicate, x.object, x.place FROM h LEFT JOIN x ON x.hit_id = h.hit_id AND x.place <= 5""")
def _(r, e):
    return listings.search_listing(r, e, "Pat Lee 1")


@query("hire_listing", "relationships entities", f"""
SELECT r.id, s.name AS subject, r.event_date {_STAR} WHERE r.predicate = 'HIRED_BY' AND contains(lower(o.name), 'inc') ORDER BY r.event_date DESC NULLS LAST, r.id DESC LIMIT 20""")
def _(r, e):
    return listings.hires(r, e, "Inc")
