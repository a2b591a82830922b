from pyspark.sql import functions as F

from tidewire.operators import feeds


def test_state_and_status(spark):
    own = spark.createDataFrame([(1, "a", True, 0), (2, "b", False, 1), (3, "c", True, 2)], "feed_id int, url string, enabled boolean, priority int")
    stats = spark.createDataFrame([(1, 5, 2, 0.75, None)], "feed_id int, total_articles int, failures int, success_rate double, last_ts timestamp")
    found = feeds.with_status(feeds.with_stats(own, stats)).orderBy("feed_id").select("total_articles", "status", "rate_band", "priority_label").collect()
    assert [tuple(r) for r in found] == [(5, "warning", "medium", "high"), (0, "disabled", "high", "medium"), (0, "ok", "high", "low")]
    more = spark.createDataFrame([("a",), ("z",)], "url string")
    assert [r.url for r in feeds.not_configured(more, own).collect()] == ["z"]


def test_searches_are_cut_before_they_are_merged(spark):
    hits = spark.createDataFrame([(q, p, u, d) for q, p, u, d in [(0, 0, "a", "2024-01-01"), (0, 1, "b", "2024-03-01"), (0, 2, "c", "2024-01-02"), (1, 0, "b", None), (1, 1, "d", "2024-01-03")]], "query_ord int, place int, url string, date string").withColumn("date", F.col("date").cast("date"))
    assert sorted((r.query_ord, r.url) for r in feeds.merged_searches(hits, 2, 4).collect()) == [(0, "a"), (0, "b"), (1, "d")]
    assert [r.url for r in feeds.historical(hits.filter("query_ord = 0"), "2024-01-01", "2024-01-31", 2).collect()] == ["a"]


def test_digest_record_summary_and_landed_articles(spark):
    from pyspark.sql import functions as F

    from tidewire.functions.texts import amounts_of
    from tidewire.operators import digest
    from tidewire.sources import landed

    r = spark.sql("SELECT * FROM VALUES ('FUNDED_BY', DATE '2024-01-01'), ('RAISED_FUNDING', DATE '2024-01-02'), ('HIRED_BY', DATE '2023-01-01'), ('LAID_OFF', NULL) AS t(predicate, event_date)")
    assert tuple(digest.record(r, "2024-01-01", "2024-01-31").first())[2:] == (2, 0, 0, 0, 0)
    assert tuple(digest.record(r.limit(0), "2024-01-01", "2024-01-31").first())[2:] == (0, 0, 0, 0, 0)
    s = spark.createDataFrame([(2, "Layoffs", 3), (1, "Funding Rounds", 2), (3, "M&A", 0)], "place int, title string, n int")
    assert digest.summary(s).first().summary == "This week: 2 funding rounds, 3 layoffs."
    assert digest.summary(s.limit(0)).first().summary == "No significant events this period."
    g = spark.sql("SELECT 'u' AS url, 't' AS title, TIMESTAMP '2024-01-01' AS date, array('a', 'b', 'c', 'd') AS organizations, array('x') AS themes, 'd.example' AS domain")
    a = landed.gkg_articles(g).first()
    assert (a.source, a.summary, a.content, a.feed_priority) == ("gdelt:d.example", "Organizations: a, b, c. Themes: x", None, 2)
    assert spark.range(1).select(amounts_of(F.array(F.lit("$1 million"), F.lit("none"), F.lit("$2.5 billion")))).first()[0] == [2.5e9, 1e6]
