import datetime
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidewire.operators import matching, tables
from tidewire.streaming import jobs


def test_undated_relationships_stay(spark):
    rows = spark.createDataFrame([(1, 1, "P", 2, None), (2, 1, "P", 2, None), (3, 1, "P", 2, "2024-01-01"), (4, 1, "P", 2, "2024-01-01")], "id long, subject_id long, predicate string, object_id long, event_date string")
    assert sorted(r.id for r in tables.insert_relationships(rows).collect()) == [1, 2, 3]
    assert sorted(r.id for r in tables.insert_relationships(rows, null_safe=True).collect()) == [1, 3]


def test_entity_upsert_and_merge(spark):
    m = spark.createDataFrame([("Google", "company", 1, "2024-01-02", "a"), ("google ", "company", 2, "2024-01-01", ""), ("GOOGLE", "company", 3, "2024-01-05", None)], "name string, entity_type string, seq int, day string, attributes string")
    first = tables.upsert_entities(m)
    r = first.first()
    assert (r.normalized_name, r.name, r.mention_count, r.attributes, r.first_seen, r.last_seen) == ("google", "Google", 3, "a", "2024-01-01", "2024-01-05")
    again = tables.merge_entities(first, first).first()
    assert (again.mention_count, again.name) == (6, "Google")


def test_insert_new_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "u1", "h1"), (2, "u1", "h2"), (3, "u2", "h1"), (4, "u3", "h3")], "seq int, url string, content_hash string")
    new = tables.insert_new(rows, rows.limit(0))
    assert sorted(r.seq for r in new.collect()) == [1, 4]
    assert tables.insert_new(rows, new).count() == 0


def test_greedy_merges_like_a_walk(spark):
    rng = random.Random(4)
    for _ in range(4):
        n = {i: rng.randrange(4) for i in range(14)}
        rank = sorted(n, key=lambda i: (-n[i], i))
        pairs = [(a, b) for x, a in enumerate(rank) for b in rank[x + 1 :] if rng.random() < 0.2]
        gone, want = set(), set()
        for a, b in pairs:
            if a not in gone and b not in gone:
                gone.add(b)
                want.add((a, b))
        if pairs:
            df = spark.createDataFrame([(a, b, n[a], n[b], 1.0) for a, b in pairs], "keep long, merge long, keep_n long, merge_n long, similarity double")
            assert {tuple(r) for r in matching.greedy_merges(df).collect()} == want


def test_merged_edges_and_difflib_ratio(spark):
    edges = spark.createDataFrame([(1, 1, "P", 9, "2024-01-01"), (2, 2, "P", 9, "2024-01-01"), (3, 1, "P", 2, "2024-01-01"), (4, 2, "P", 9, None)], "id long, subject_id long, predicate string, object_id long, event_date string")
    got = matching.rewrite_relationships(edges, spark.createDataFrame([(1, 2)], "keep long, merge long")).collect()
    assert sorted((r.id, r.subject_id) for r in got) == [(1, 1), (4, 1)]
    names = spark.createDataFrame([("abcdefgh", "efghabcd"), ("xayb", "axby")], "a string, b string")
    assert [r[0] for r in names.select(matching.difflib_ratio("a", "b")).collect()] == [SequenceMatcher(None, a, b).ratio() for a, b in names.collect()]


def test_cross_reference_like_all_pairs(spark):
    news = [(1, "Acme Robotics Inc", 1e6, "2024-03-01"), (2, "Borealis Labs", None, "2024-03-05"), (3, "Nothing Like It", 5.0, "2024-03-05")]
    filed = [(10, "ACME ROBOTICS LLC", 1.1e6, "2024-03-20"), (11, "Acme Robotic", 9e6, "2024-03-02"), (12, "Borealis", 3.0, "2024-03-05"), (13, "Acme Robotics", 1e6, "2024-07-01")]
    mk = lambda x: spark.createDataFrame(x, "event_id long, company_name string, amount double, date string").withColumn("date", F.to_date("date"))
    got = {r.n_id: r.f_id for r in matching.cross_reference(mk(news), mk(filed)).collect()}
    assert got == {1: 10, 2: 12}


def test_feed_state_in_batches_is_the_fold(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 3, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), i, rng.random() < 0.7, rng.randrange(900), 2) for i in range(60)]
    log = spark.createDataFrame(rows, "feed_id long, ts timestamp, seq long, ok boolean, ms long, articles long")
    for k in range(3):
        log.filter((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.feed_state(stream).writeStream.outputMode("update").format("memory").queryName("feeds").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.feed_id: (r.failures, r.total_articles, r.fetches) for r in spark.sql("select * from feeds where fetches = 20").collect()}
    want = {r.feed_id: (r.failures, r.total_articles, r.fetches) for r in tables.feed_stats(log).collect()}
    assert got == want
