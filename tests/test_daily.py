"""The daily run over a store: two days, one of them run twice."""

import json

from pyspark.sql import functions as F

from tidewire.operators import daily, extraction


NAMES = ["Zed", "Quartz Labs", "Corvid Energy", "Dynamo", "Ember Foods", "Fjord"]


def extractor():
    def extract(rows):
        out = []
        for title, content in rows:
            if "unreadable" in content:
                raise ValueError("unreadable")
            a, _, b = title.partition(" acquires ")
            edge = {"subject": a, "predicate": "ACQUIRED", "object": b, "confidence": 0.9}
            names = [{"name": a, "type": "company"}, {"name": b, "type": "company"}]
            out.append(json.dumps({"entities": names, "relationships": [edge], "event_date": "2024-03-01"}) if b else None)
        return out

    return extract


def articles(spark, rows):
    schema = "url string, title string, content string, published string, feed_priority int, content_hash string, seq long"
    return spark.createDataFrame(rows, schema).withColumn("published", F.to_timestamp("published"))


def test_two_days(spark, tmp_path):
    day = lambda k, n: [(f"u{k}-{i}", f"{NAMES[i]} acquires Acme Robotics", "The acquisition closed: a merger, acquired for cash." + " unreadable" * (i == 3), "2024-03-01", 1, f"h{k}-{i}", i) for i in range(n)]
    one = [*day(1, 6), ("u1-0", "again", "", None, 1, "hx", 9), ("u9", "Weather", "Rain.", None, 2, "h9", 10), (None, "no url", "", None, 1, "h", 11)]
    layoffs = spark.createDataFrame([("Borealis", 40, "https://layoffs.example/1")], "company string, employees long, source_url string")
    layoffs = layoffs.select(extraction.layoff_result(F.col("company"), F.col("employees"), F.lit(None).cast("double")).alias("result"), "source_url")
    path = str(tmp_path / "store")
    run = lambda name, rows, **more: daily.run_daily(spark, path, name, "2024-03-02", daily.Inputs(articles(spark, rows), **more), extractor()).first()
    first = run("2024-03-01", one, layoffs=layoffs)
    want = {"fetched_articles": 9, "saved_articles": 7, "high_signal_articles": 6, "extracted_articles": 5, "failed_articles": 1, "extracted_relationships": 5, "layoff_relationships": 1}
    assert {k: first[k] for k in want} == want
    assert (first.filing_relationships, first.relationships, first.enriched_entities) == (None, 5, 7)
    again = run("2024-03-01", one, layoffs=layoffs)
    assert first.asDict() | {"elapsed_seconds": 0} == again.asDict() | {"elapsed_seconds": 0}
    # the next day: old articles are known, what failed is asked about again, switched off sources add nothing
    second = run("2024-03-02", [*one, *day(2, 2)], searches=articles(spark, day(3, 1)))
    want = {"fetched_articles": 12, "saved_articles": 3, "high_signal_articles": 3, "extracted_articles": 3, "failed_articles": 1, "extracted_relationships": 3, "layoff_relationships": None}
    assert {k: second[k] for k in want} == want
    store = daily.Store(spark, path, "2024-03-02")
    assert store.read("runs").count() == 2 and store.read("articles").count() == 10
    off = daily.run_daily(spark, str(tmp_path / "other"), "1", "2024-03-02", daily.Inputs(articles(spark, one), searches=articles(spark, day(3, 1)), layoffs=layoffs), extractor(), daily.Switches(searches=False, layoffs=False)).first()
    assert (off.fetched_articles, off.layoff_relationships) == (9, None)


def test_a_day_without_anything(spark, tmp_path):
    r = daily.run_daily(spark, str(tmp_path / "s"), "1", "2024-03-02", daily.Inputs(articles(spark, [])), extractor()).first()
    assert (r.fetched_articles, r.saved_articles, r.extracted_relationships, r.entities, r.data_quality_score, r.enriched_entities) == (0, 0, 0, 0, 0.0, 0)
