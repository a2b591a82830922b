"""Event-graph tables derived from the supplied star schema by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents pages".split()

PREDICATES = "ACQUIRED FUNDED_BY HIRED_BY DEPARTED_FROM FOUNDED CEO_OF CTO_OF CFO_OF INVESTED_IN LAID_OFF RAISED_FUNDING DIRECTOR_OF EXECUTIVE_OF OFFICER_OF".split()
_PREDICATE = "CASE o_orderkey % 14 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PREDICATES)) + " END"

VIEWS = {
    "articles": """
SELECT o_orderkey AS id, 'https://news.example.com/' || CAST(o_orderkey % 1200 AS VARCHAR(20)) AS url, o_orderkey AS seq,
       CASE o_orderkey % 6 WHEN 0 THEN c_name || ' acquires Acme in strategic deal' WHEN 1 THEN c_name || ' raises $' || CAST(o_custkey AS VARCHAR(20)) || ' million series B'
            WHEN 2 THEN c_name || ' joins Acme as CTO' WHEN 3 THEN 'Acme layoffs: ' || c_name || ' laid off' WHEN 4 THEN c_name || ' files for IPO' ELSE 'Notes on ' || c_name END AS title,
       CASE o_orderkey % 4 WHEN 0 THEN 'The transaction closed in March 2024; Acme Inc. bought the shares.' WHEN 1 THEN 'The CEO said investors value it at $2.5 billion.'
            WHEN 2 THEN 'A workforce reduction and restructuring followed.' ELSE '' END AS content,
       CAST(o_orderdate AS DATE) AS published, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS feed_priority, 'h' || CAST(o_orderkey % 1000 AS VARCHAR(20)) AS content_hash,
       o_orderstatus <> 'O' AS processed, o_orderkey % 3 = 0 AS is_high_signal, o_orderkey % 9 = 0 AS extracted
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "entities": """
SELECT s_suppkey * 10 + 1 AS id, CASE s_suppkey % 5 WHEN 0 THEN 'Acme ' || CAST(s_suppkey AS VARCHAR(20)) || ' Inc.' WHEN 1 THEN 'Borealis ' || CAST(s_suppkey AS VARCHAR(20)) || ' LLC'
            WHEN 2 THEN 'Corvid ' || CAST(s_suppkey AS VARCHAR(20)) || ' Fund II' WHEN 3 THEN 'Dynamo ' || CAST(s_suppkey AS VARCHAR(20)) || ' Technologies' ELSE 'Ember ' || CAST(s_suppkey AS VARCHAR(20)) END AS name,
       CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE 'company' END AS entity_type, s_suppkey % 13 AS mention_count FROM {supplier}
UNION ALL SELECT c_custkey * 10 + 2, 'Pat Lee ' || CAST(c_custkey AS VARCHAR(20)), CASE WHEN c_custkey % 11 = 0 THEN 'unknown' ELSE 'person' END, c_custkey % 17 FROM {customer}
UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 3, n_name || ' Capital', 'investor', CAST(n_nationkey AS BIGINT) % 5 FROM {nation}""",
    "relationships": f"""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 14 IN (0, 1, 9, 10) THEN (o_orderkey * 7 % n + 1) * 10 + 1 WHEN o_orderkey % 14 = 8 THEN (o_orderkey % 25) * 10 + 3 ELSE o_custkey * 10 + 2 END AS subject_id,
       {_PREDICATE} AS predicate,
       CASE WHEN o_orderkey % 14 = 1 THEN (o_orderkey % 25) * 10 + 3 ELSE (o_orderkey * 3 % n + 1) * 10 + 1 END AS object_id,
       CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS event_date, CAST(0.5 AS DOUBLE) + CAST(o_orderkey % 5 AS DOUBLE) / 10 AS confidence,
       CASE o_orderkey % 5 WHEN 0 THEN 'Form D filing of $1,250,000' WHEN 1 THEN 'raised $' || CAST(o_orderkey % 90 + 1 AS VARCHAR(20)) || ' million' WHEN 2 THEN 'laid off 1,200 employees' WHEN 3 THEN '' ELSE 'per a report' END AS context,
       CASE o_orderkey % 6 WHEN 0 THEN 'https://www.techcrunch.com/a/' WHEN 1 THEN 'https://sec.gov/b/' WHEN 2 THEN 'https://notwsj.com/c/' WHEN 3 THEN 'https://blog.example.org/d/' WHEN 4 THEN '' ELSE 'http://inc.com/e/' END
         || CASE WHEN o_orderkey % 6 = 4 THEN '' ELSE CAST(o_orderkey % 40 AS VARCHAR(20)) END AS source_url
FROM {{orders}}, (SELECT count(*) AS n FROM {{supplier}}) s""",
    "briefs": """
SELECT c_custkey * 10 + 2 AS entity_id, 'Pat Lee ' || CAST(c_custkey AS VARCHAR(20)) AS name,
       CASE c_custkey % 7 WHEN 0 THEN 'Pat Lee ' || CAST(c_custkey AS VARCHAR(20)) || ' is the current Chief Officer of Acme Works. Based in Oslo, Norway.' WHEN 1 THEN 'She serves as Lead Engineer, from Rome. Expertise in pumps, known for valves.'
            WHEN 2 THEN 'Pat Lee works here; previously at Foo, Bar Baz. Graduated from Delta State University.' WHEN 3 THEN 'CTO of Tiny Labs, lives in Bergen. Stanford and MIT.' WHEN 4 THEN 'joined Delta Works in 2020 as Vice President.'
            WHEN 5 THEN 'An ex-CFO at Quux, now Director.' ELSE '' END AS text, 'person' AS entity_type FROM {customer}
UNION ALL SELECT s_suppkey * 10 + 1, 'Acme ' || CAST(s_suppkey AS VARCHAR(20)),
       CASE s_suppkey % 6 WHEN 0 THEN 'Acme ' || CAST(s_suppkey AS VARCHAR(20)) || ' today is a startup that builds pumps. It employs about 1,' || CAST(100 + s_suppkey % 800 AS VARCHAR(20)) || ' people. Founded in 1850, since 19' || CAST(10 + s_suppkey % 80 AS VARCHAR(20)) || '.'
            WHEN 1 THEN 'Headquartered in Palo Alto, California. Raised $' || CAST(s_suppkey AS VARCHAR(20)) || '.5 million in a series B.' WHEN 2 THEN 'See https://www.linkedin.com/x or website: www.acme-' || CAST(s_suppkey AS VARCHAR(20)) || '.example for more, a public company.'
            WHEN 3 THEN CAST(s_suppkey AS VARCHAR(20)) || ' workers in Berlin; it focuses on deep sea industry; privately held. A pre-seed.' WHEN 4 THEN 'An e-commerce firm with funding of $2 billion, see http://acme.io/about.' ELSE '' END, 'company' FROM {supplier}""",
    "feed_log": """
SELECT user_id AS feed_id, ts, event_id AS seq, event_type <> 'error' AS ok, CAST(floor(abs(coalesce(value, 0)) * 10) AS BIGINT) AS ms, event_id % 7 AS articles FROM {events}""",
    "names": """
SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '  ' || p_name || ' Inc. ' WHEN 1 THEN p_name || ' Holdings LLC' WHEN 2 THEN 'LLC ' || p_name WHEN 3 THEN 'N/A ' || p_brand || ' Corp.' WHEN 4 THEN 'Series A'
       WHEN 5 THEN p_name || ' Dec 2025 a Series of Big Fund, LLC' WHEN 6 THEN '<b>' || p_name || '</b> https://x.example' WHEN 7 THEN p_type || ' Technologies Group' WHEN 8 THEN CAST(p_partkey AS VARCHAR(20))
       WHEN 9 THEN 'Vincent ' || p_brand WHEN 10 THEN p_name || ' Fund IV' ELSE '- ' || p_name || ' & Co.' END AS name,
       CASE p_partkey % 6 WHEN 0 THEN '$' || CAST(p_size AS VARCHAR(20)) || '.5 million' WHEN 1 THEN '$1,' || CAST(100 + p_size AS VARCHAR(20)) || ' raised' WHEN 2 THEN 'laid off 2,' || CAST(100 + p_size AS VARCHAR(20)) || ' workers'
       WHEN 3 THEN CAST(p_size AS VARCHAR(20)) || 'k' WHEN 4 THEN 'series-b of ' || CAST(p_size AS VARCHAR(20)) || ' bn' ELSE 'nothing' END AS context,
       CASE WHEN p_partkey % 3 = 0 THEN 'person' ELSE 'company' END AS entity_type FROM {part}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in sql}
    return spark.sql(sql.replace("VARCHAR(20)", "STRING"), **tables)


def with_views(sql: str, *names: str) -> str:
    """The query after the definitions of the views it reads, for DuckDB."""
    plain = {t: t for t in BASE}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names) + "\n" + sql
