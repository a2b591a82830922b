"""Incremental ingest and classification as streams over landed files (STR-01, STR-02)."""

from tidewire.streaming import jobs

SCHEMA = "url string, title string, content string, published timestamp"


def land(spark, folder, rows):
    spark.createDataFrame(rows, "url string, title string, content string, day string").selectExpr("url", "title", "content", "timestamp(day) AS published").coalesce(1).write.mode("append").parquet(folder)


def run(stream, tmp_path, out):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()


def test_a_url_comes_once_over_runs(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    articles = lambda: jobs.unseen_articles(spark.readStream.schema(SCHEMA).parquet(landed))
    land(spark, landed, [("u1", "a", "x", "2024-03-01"), ("u1", "a again", "x", "2024-03-01"), ("u2", "b", None, "2024-03-02")])
    run(articles(), tmp_path, out)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2"]
    land(spark, landed, [("u2", "b later", "y", "2024-03-03"), ("u3", "c", "", "2024-03-04"), (None, "no url", "", "2024-03-04"), (None, "nor this", "", "2024-03-04")])
    run(articles(), tmp_path, out)
    got = spark.read.parquet(out).collect()
    assert sorted(r.url or "" for r in got) == ["", "u1", "u2", "u3"]
    assert [r.title for r in got if r.url == "u2"] == ["b"]


def test_a_stream_is_classified_as_a_table_is(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    land(spark, landed, [("u1", "Acme acquires Beta", "The acquisition closed", "2024-03-01"), ("u2", "Acme layoffs", "laid off 200 workers", "2024-03-02"), ("u3", None, None, "2024-03-03"), ("u4", "", "nothing", "2024-03-03")])
    run(jobs.classified(spark.readStream.schema(SCHEMA).parquet(landed)), tmp_path, out)
    want = jobs.classified(spark.read.schema(SCHEMA).parquet(landed))
    got = spark.read.parquet(out).select(want.columns)
    by_url = lambda df: {r.url: r for r in df.collect()}
    assert by_url(got) == by_url(want) and len(by_url(got)) == 4
