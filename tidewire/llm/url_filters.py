"""URL filters: host rules, and logistic regression on hashed character n-grams elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); a rule's name is host and path together.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
#: Rows of the labelled table that the model is fitted on, at most.
MAX_LABELLED = 4000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the host or a parent of it; else null."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def ngrams(hosts: list[str], paths: list[str], sizes=SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each character n-gram (UTF-8 bytes) of `^host$` and of `^path$`."""
    texts = [f"\1{h}\2".encode() for h in hosts] + [f"\3{p}\4".encode() for p in paths]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    owner, raw = np.repeat(np.arange(len(texts)), size), np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    rows, cells = [], []
    for n in sizes:
        if len(raw) < n:
            continue
        code = np.full(len(raw) - n + 1, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(1099511628211) + raw[k : len(raw) - n + 1 + k]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        inside = owner[: len(code)] == owner[n - 1 :]
        side = (owner[: len(code)] >= len(hosts)).astype(np.uint64)
        rows.append((owner[: len(code)] % max(1, len(hosts)))[inside])
        cells.append((((code >> np.uint64(40)) * np.uint64(2) + side) % np.uint64(buckets)).astype(np.int64)[inside])
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def chance(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    rows, cells = ngrams(hosts, paths)
    n = np.maximum(1, np.bincount(rows, minlength=len(hosts)))
    z = np.bincount(rows, weights[cells], minlength=len(hosts)) / np.sqrt(n) + bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(hosts: list[str], paths: list[str], blocked: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over the whole small table; no rows give a model that blocks nothing."""
    weights, bias, seen = np.zeros(BUCKETS), -1e-3, np.full(BUCKETS, 1e-8)
    if not len(hosts):
        return weights, bias
    rows, cells = ngrams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(hosts))))
    for _ in range(steps):
        z = np.bincount(rows, weights[cells], minlength=len(hosts)) * scale + bias
        gap = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - blocked
        grad = np.bincount(cells, (gap * scale)[rows], minlength=BUCKETS) / len(hosts) + decay * weights
        seen += grad**2
        weights -= rate * grad / np.sqrt(seen)
        bias -= rate * gap.mean()
    return weights, float(bias)


def filter_urls(urls: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row for each input row: id, host, path, rule, score (chance of block), verdict.

    `labelled` (host, path, blocked 0/1) is the small table the model learns from; at most
    `max_labelled` of its distinct rows, by hash, are read to the driver.  The longest rule
    that fits decides; the model decides where none fits.  A null url has empty parts, which
    the model judges like any other; an empty labelled table allows all that no rule blocks.
    """
    table = labelled.select("host", "path", F.col("blocked").cast("int").alias("blocked")).dropna().distinct()
    rows = table.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(max_labelled).toPandas()
    weights, bias = fit(list(rows.host), list(rows.path), rows.blocked.to_numpy(float))
    model = urls.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # BUCKETS numbers

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        w, b = model.value
        return pd.Series(chance(list(host), list(path), w, b))

    host, path = url_parts(F.col(url_col).cast("string"))
    out = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    out = out.select("*", name.alias("rule"), verdict.alias("ruled"), score("host", "path").alias("score"))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("ruled", by_model)).drop("ruled")
