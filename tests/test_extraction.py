import datetime
import json

from pyspark.sql import functions as F

from tidewire.operators import extraction, profiles, tables


def parsed(spark, *texts):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id int, text string")
    return rows.select("id", extraction.parse_answer(F.col("text")).alias("result"))


def test_answers(spark):
    answer = {
        "entities": [{"name": "Workday Inc.", "type": "company", "role": "acquirer"}, {"name": "HiredScore", "type": "company", "role": None}, {"name": "x", "type": "company", "role": ""}],
        "relationships": [{"subject": "HiredScore", "predicate": "ACQUIRED", "object": "Nobody", "context": "c", "confidence": 0.9}, {"subject": "A", "predicate": "P", "object": "B", "context": "", "confidence": 0.5}, {"subject": "A", "predicate": "P", "object": " ", "context": "", "confidence": 0.9}],
        "event_date": "2024-02-26",
        "amounts": {"acquisition": "$530M", "valuation": ""},
    }
    found = parsed(spark, "```json\n" + json.dumps(answer) + "\n```", "not valid json", None, "", "{bad}")
    first, *bad = (r.result for r in found.orderBy("id").collect())
    assert [e.name for e in first.entities] == ["Workday", "HiredScore"]
    assert [(e.subject, e.subject_type, e.object_type) for e in first.relationships] == [("HiredScore", "company", "unknown")]
    assert first.event_date == datetime.date(2024, 2, 26)
    assert all((r.entities, r.relationships, r.event_date) == ([], [], None) for r in bad)
    mentions, edges = extraction.fan_out(found)
    assert mentions.count() == 2 and [r.metadata for r in edges.collect()] == [{"amount": "$530M"}]


def test_simple_extraction(spark):
    rows = spark.createDataFrame([(["Acme"], ["Al", "Ann Lee"], [2500000.0], "seed"), (["Acme", "Borealis"], [], [1.0], "seed"), ([], [], [], None)], "o array<string>, p array<string>, a array<double>, k string")
    one, two, none = (r.r for r in rows.select(extraction.simple_extraction(F.col("o"), F.col("p"), F.col("a"), F.col("k")).alias("r")).collect())
    assert [e.name for e in one.entities] == ["Acme", "Ann Lee"]
    assert [(e.object, e.context) for e in one.relationships] == [("Undisclosed", "seed round: $2,500,000")]
    assert len(two.entities) == 2 and two.relationships == [] and none.entities == []


def test_two_stages_see_each_row_once(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, needs_deep boolean")
    made = extraction.two_stage(rows, "needs_deep", lambda x: x.select("id", F.lit("cheap").alias("by")), lambda x: x.select("id", F.lit("deep").alias("by")))
    assert sorted((r.id, r.by) for r in made.collect()) == [(1, "deep"), (2, "cheap"), (3, "cheap")]


def test_events_of_filings(spark):
    rows = spark.createDataFrame([("A", 0.0, 5.0, "2024-01-01", "u"), ("B", 7.0, 5.0, "2024-01-01", "u"), ("C", None, None, None, None)], "company_name string, total_amount double, amount_sold double, filing_date string, source_url string")
    assert [r.amount for r in extraction.filing_events(rows).collect()] == [5.0, 7.0, None]


def test_overlay_takes_the_last_value_with_its_null(spark):
    rows = spark.createDataFrame([(1, 1, {"a": "x", "b": "y"}), (1, 2, {"a": None}), (2, 1, {})], "entity_id int, seq int, data map<string,string>")
    assert [(r.entity_id, r.data) for r in profiles.overlay(rows).collect()] == [(1, {"a": None, "b": "y"})]


def test_feed_totals_and_labels(spark):
    old, new = (spark.createDataFrame(x, "feed_name string, total_articles int, high_signal_articles int") for x in ([("a", 1, 1), ("b", 2, 2)], [("b", 5, 4), ("c", 7, 6)]))
    assert sorted(tuple(r) for r in tables.upsert_feed_totals(old, new).collect()) == [("a", 1, 1), ("b", 5, 4), ("c", 7, 6)]
    urls = spark.createDataFrame([("https://www.techcrunch.com/a",), ("",), (None,)], "u string")
    assert [r.x for r in urls.select(profiles.source_label(F.col("u")).alias("x")).collect()] == ["Techcrunch", None, None]
    kinds = spark.createDataFrame([("FUNDED_BY", {"valuation": "$2B", "amount": ""}), ("LAID_OFF", {"count": "9"}), ("CEO_OF", None)], "p string, m map<string,string>")
    shown = kinds.select(profiles.event_class(F.col("p")).alias("k"), profiles.event_amount(F.col("m")).alias("a")).collect()
    assert [tuple(r) for r in shown] == [("funding", "$2B"), ("departure", "9"), ("hire", None)]
