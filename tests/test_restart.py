"""A user's extractor, and extraction that dies and starts again."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import extraction
from tidewire.streaming import extraction as restart


def extractor():
    def extract(rows):
        """Acquisitions told as `A acquires B`; an article without content cannot be read."""
        out = []
        for title, content in rows:
            if not content:
                raise ValueError("no content")
            a, _, b = title.partition(" acquires ")
            out.append(json.dumps({"entities": [{"name": a, "type": "Company"}], "relationships": [{"subject": a, "predicate": "ACQUIRED", "object": b, "confidence": 0.9}]}) if b else None)
        return out

    return extract


extract = extractor()  # made by a function, so that workers need not import this file


def test_extractor_errors_stay_with_their_rows(spark):
    rows = [(k, f"Zed{k} acquires Acme", "text" if k % 7 else None) for k in range(100)] + [(200, None, "x"), (201, "Acme acquires acme", "x"), (202, "Nothing", "x")]
    df = spark.createDataFrame(rows, "id long, title string, content string").repartition(3)
    got = {r.id: r for r in extraction.extracted(df, extract, batch_rows=16).collect()}
    assert len(got) == 103
    for k in range(100):
        if k % 7:
            assert got[k].error is None and [(x.subject, x.subject_type, x.object) for x in got[k].result.relationships] == [(f"Zed{k}", "company", "Acme")]
        else:
            assert (got[k].result, got[k].error) == (None, "ValueError: no content")
    assert [got[k].result.relationships for k in (200, 201, 202)] == [[], [], []]
    assert extraction.extracted(df.limit(0), extract).count() == 0
    short = {r.id: r.error for r in extraction.answers(df, lambda rows: [None]).collect()}
    assert set(short.values()) == {None}  # asked one by one
    one = {r.id: r for r in extraction.answers(df, lambda rows: [KeyError(t) if t == "Nothing" else "{}" for t, _ in rows]).collect()}
    assert one[202].error == "KeyError: 'Nothing'" and one[1].answer == "{}"


def test_extraction_dies_and_starts_again(spark, tmp_path):
    schema = "id long, url string, title string, content string"
    land = lambda ids, n: spark.createDataFrame([(k, f"u{k}", f"Zed{k} acquires Acme", "text" if k % 5 else "") for k in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = restart.Store(spark, str(tmp_path / "store"))
    land(range(20), 0)

    def die():
        raise RuntimeError("killed between write and mark")

    with pytest.raises(Exception, match="killed between write and mark"):
        restart.run_stream(stream(), store, str(tmp_path / "c"), extract, between=die).awaitTermination()
    assert store.marks().count() == 0 and store.results().count() == 0
    assert store.read("answers", restart.ANSWERS).count() == 20  # written, not counted
    land(range(20, 30), 1)
    restart.run_stream(stream(), store, str(tmp_path / "c"), extract).awaitTermination()
    done = [r.id for r in store.results().collect()]
    assert sorted(done) == [k for k in range(30) if k % 5]
    # failures were asked again with the second batch, and stay open
    tries = {r.id: r.n for r in store.marks().groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert all(tries[k] == (1 if k % 5 else 2 if k < 20 else 1) for k in range(30))
    assert sorted(r.id for r in store.failed(5).collect()) == [0, 5, 10, 15, 20, 25]
    mended = lambda rows: extract([(t, c or "text") for t, c in rows])
    restart.retry(store, "1", mended)
    restart.retry(store, "1", mended)
    assert sorted(r.id for r in store.results().collect()) == list(range(30)) and store.failed(5).count() == 0
    land(range(25, 33), 2)  # some are known
    restart.run_stream(stream(), store, str(tmp_path / "c"), extract).awaitTermination()
    assert sorted(r.id for r in store.results().collect()) == [*range(30), 31, 32]


def test_failures_end_after_so_many_tries(spark, tmp_path):
    store = restart.Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1, "u", "t", "")], "id long, url string, title string, content string")
    restart.run_batch(store, one, "a", extract, most=2)
    for run in "bc":
        restart.retry(store, run, extract, most=2)
    assert [r.attempts for r in store.marks().orderBy("attempts").collect()] == [1, 2]
