"""Table maintenance as DataFrame to DataFrame jobs: insert-if-new, upserts, folds and counts."""

from __future__ import annotations

from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions.names import plain_key


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """W-01: the first row of each key; rows with a null key all stay."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("n_", n).filter((F.col("n_") == 1) | F.col(key).isNull()).drop("n_")


def insert_new(rows: DataFrame, target: DataFrame, order: str = "seq") -> DataFrame:
    """SNK-01: rows whose url and content hash the target lacks, first ones within the batch."""
    fresh = rows.join(target.select("url"), "url", "left_anti").join(target.select("content_hash"), "content_hash", "left_anti")
    return first_wins(first_wins(fresh, "url", order), "content_hash", order)


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """SNK-05, AGG-12: one row for each (plain name, type): first spelling, mentions, last attributes given, first and last day.

    mentions: name, entity_type, seq, day, attributes (string, null or empty: none)."""
    given = F.nullif(F.col("attributes"), F.lit(""))
    return mentions.groupBy(plain_key(F.col("name")).alias("normalized_name"), "entity_type").agg(
        F.min_by("name", "seq").alias("name"), F.count("*").alias("mention_count"), F.max_by("attributes", F.when(given.isNotNull(), F.col("seq"))).alias("attributes"),
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
    )


def merge_entities(target: DataFrame, news: DataFrame) -> DataFrame:
    """SNK-05 against a table: the target's spelling and first day stay, counts add up, later attributes win."""
    t, n = target.alias("t"), news.alias("n")
    rows = t.join(n, ["normalized_name", "entity_type"], "full_outer")
    c = lambda x: F.coalesce(F.col(f"t.{x}"), F.col(f"n.{x}"))
    return rows.select(
        "normalized_name", "entity_type", c("name").alias("name"), (F.coalesce("t.mention_count", F.lit(0)) + F.coalesce("n.mention_count", F.lit(0))).alias("mention_count"),
        F.coalesce(F.nullif(F.col("n.attributes"), F.lit("")), F.col("t.attributes")).alias("attributes"), F.least("t.first_seen", "n.first_seen").alias("first_seen"), F.greatest("t.last_seen", "n.last_seen").alias("last_seen"),
    )


def insert_relationships(rows: DataFrame, target: DataFrame | None = None, order: str = "id", null_safe: bool = False) -> DataFrame:
    """SNK-06: first of each (subject, predicate, object, date); undated rows never clash unless null_safe."""
    key = ["subject_id", "predicate", "object_id", "event_date"]
    dated = rows if null_safe else rows.filter(F.col("event_date").isNotNull())
    if target is not None:
        dated = dated.join(target.select(*key), key, "left_anti")
    kept = dated.withColumn("n_", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("n_ = 1").drop("n_")
    return kept if null_safe else kept.unionByName(rows.filter(F.col("event_date").isNull()))


def article_stats(articles: DataFrame) -> DataFrame:
    """AGG-01, AGG-17."""
    c = F.count_if
    out = articles.agg(F.count("*").alias("total"), c("processed").alias("processed"), c(~F.col("processed")).alias("unprocessed"), c("is_high_signal").alias("high_signal"), c(F.col("is_high_signal") & ~F.col("extracted")).alias("pending"))
    return out.withColumn("backlog_warning", F.col("unprocessed") > 500)


def unprocessed(articles: DataFrame, limit: int = 500) -> DataFrame:
    """FLT-01, SRT-03."""
    return articles.filter(~F.col("processed")).orderBy("feed_priority", F.desc_nulls_last("published"), "id").limit(limit)


def unextracted(articles: DataFrame, limit: int = 500) -> DataFrame:
    """FLT-02."""
    return articles.filter(F.col("is_high_signal") & ~F.col("extracted")).orderBy(F.desc_nulls_last("published"), "id").limit(limit)


def feed_stats(log: DataFrame) -> DataFrame:
    """W-03: running state of each feed, folded in order of (ts, seq): success rate and fetch time as moving
    averages (0.9 old, 0.1 new; the time is cut to a whole number each step), failures in a row, totals.

    One feed's log is one ordered fold; bound it by a time range, or use the streaming form."""
    state = F.struct(F.lit(1.0).alias("rate"), F.lit(0).cast("long").alias("ms"), F.lit(0).cast("long").alias("fails"), F.lit(0).cast("long").alias("articles"))

    def step(s, x):
        return F.struct(
            (0.9 * s.rate + F.when(x.ok, 0.1).otherwise(0.0)).alias("rate"), (0.9 * s.ms + 0.1 * x.ms).cast("long").alias("ms"),
            F.when(x.ok, F.lit(0).cast("long")).otherwise(s.fails + 1).alias("fails"), (s.articles + x.articles).alias("articles"),
        )

    rows = log.groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "ok", "ms", "articles"))).alias("xs"), F.max("ts").alias("last_ts"), F.count("*").alias("fetches"))
    s = F.aggregate("xs", state, step)
    return rows.select("feed_id", s.rate.alias("success_rate"), s.ms.alias("avg_ms"), s.fails.alias("failures"), s.articles.alias("total_articles"), "fetches", "last_ts")


def add_tags(tags: DataFrame, news: DataFrame) -> DataFrame:
    """SNK-09."""
    new = news.select("entity_id", plain_key(F.col("tag")).alias("tag")).distinct()
    return tags.unionByName(new.join(tags, ["entity_id", "tag"], "left_anti"))


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """SNK-10."""
    return tags.join(gone.select("entity_id", plain_key(F.col("tag")).alias("tag")), ["entity_id", "tag"], "left_anti")


def tag_counts(tags: DataFrame) -> DataFrame:
    """AGG-03."""
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def upsert_enrichment(rows: DataFrame) -> DataFrame:
    """SNK-08: the last document of each (entity, source)."""
    return rows.withColumn("n_", F.row_number().over(W.partitionBy("entity_id", "source").orderBy(F.desc("enriched_at"), F.desc("seq")))).filter("n_ = 1").drop("n_")


def unenriched(entities: DataFrame, enrichment: DataFrame, n: int = 50) -> DataFrame:
    """J-14."""
    return entities.join(enrichment.select(F.col("entity_id").alias("id")), "id", "left_anti").orderBy(F.desc("mention_count"), "id").limit(n)


def coverage(entities: DataFrame, enrichment: DataFrame) -> DataFrame:
    """AGG-06: per cent of entities with an enrichment, one decimal; 0 without entities."""
    have = enrichment.select(F.col("entity_id").alias("id"), F.lit(1).alias("has")).distinct()
    out = entities.select("id").join(have, "id", "left").agg(F.count("*").alias("entities"), F.count("has").alias("enriched"))
    return out.withColumn("coverage", F.when(F.col("entities") > 0, F.round(100.0 * F.col("enriched") / F.col("entities"), 1)).otherwise(0.0))


def remap(relationships: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-13, J-18: relationships with both ends renamed by (old, new), and those that lack an end."""
    s, o = ids.select(F.col("old").alias("subject_id"), F.col("new").alias("s")), ids.select(F.col("old").alias("object_id"), F.col("new").alias("o"))
    rows = relationships.join(s, "subject_id", "left").join(o, "object_id", "left")
    whole = F.col("s").isNotNull() & F.col("o").isNotNull()
    confidence = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.8))
    return rows.filter(whole).withColumns({"subject_id": F.col("s"), "object_id": F.col("o"), "confidence": confidence}).drop("s", "o"), rows.filter(~whole).drop("s", "o")


def stamp_classified(articles: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """SNK-03: results (id, event_type, confidence, is_high_signal), one for each id, mark their articles processed;
    an empty type or a confidence of null or 0 leaves the old value, the flag always counts."""
    new = results.select("id", F.nullif("event_type", F.lit("")).alias("new_type"), F.nullif("confidence", F.lit(0.0)).alias("new_confidence"), F.col("is_high_signal").alias("new_signal"), F.lit(True).alias("met"))
    rows = articles.join(new, "id", "left")
    met = F.coalesce("met", F.lit(False))
    values = {
        "processed": F.col("processed") | met, "processed_at": F.when(met, F.lit(now).cast("timestamp")).otherwise(F.col("processed_at")), "event_type": F.coalesce("new_type", "event_type"),
        "classification_confidence": F.coalesce("new_confidence", "classification_confidence"), "is_high_signal": F.when(met, F.col("new_signal")).otherwise(F.col("is_high_signal")),
    }
    return rows.withColumns(values).select(*articles.columns)


def stamp_extracted(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK-04: articles of the ids are marked extracted; others keep their mark."""
    met = ids.select("id", F.lit(True).alias("met")).distinct()
    return articles.join(met, "id", "left").withColumn("extracted", F.col("extracted") | F.coalesce("met", F.lit(False))).select(*articles.columns)


def upsert_feed_totals(target: DataFrame, news: DataFrame) -> DataFrame:
    """SNK-14: (feed_name, total_articles, high_signal_articles); new totals take the place of the old."""
    new = news.select("feed_name", *[F.col(c).alias(f"new_{c}") for c in ("total_articles", "high_signal_articles")])
    both = target.join(new, "feed_name", "full_outer")
    return both.select("feed_name", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("total_articles", "high_signal_articles")])


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names in spark.checkpoint.dir; a session of one machine may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or mkdtemp(prefix="spark-"))
