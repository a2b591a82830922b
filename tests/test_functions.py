from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewire.functions import names as N
from tidewire.functions import texts as T
from tidewire.operators.matching import lcs

CASES = [
    ("Workday acquires HiredScore for $530M", "acquisition", True), ("Anthropic raises $2B Series D led by Google", "funding", True), ("Former Google VP joins Anthropic as CTO", "executive_move", True),
    ("Meta lays off 10,000 employees in restructuring", "layoff", True), ("Reddit files for IPO, plans public listing", "ipo", True), ("New iPhone features revealed", "other", False),
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("title,kind,signal", CASES)
def test_classify(spark, title, kind, signal):
    got = one(spark, T.classify(F.col("t"), F.col("c")), t=title, c="")
    assert (got.primary_type, got.is_high_signal) == (kind, signal)


@pytest.mark.parametrize("name,key", [("  Acme Holdings Inc. ", "acme"), ("ACME Technologies Systems", "acme technologies"), ("A.B-C Ltd", "abc"), ("Co", "co")])
def test_normalize_name(spark, name, key):
    assert one(spark, N.normalize_name(F.col("n")), n=name) == key


def test_name_rules(spark):
    assert one(spark, N.clean_filing_name(F.col("n")), n="LLC Acme") == "Acme LLC"
    assert one(spark, N.underlying_company(F.col("n")), n="SpaceX Dec 2025 a Series of Big Fund") == "SpaceX"
    assert one(spark, N.is_organisation(F.col("n")), n="Vincent Chase") is True  # holds INC
    assert one(spark, N.is_fund(F.col("n")), n="Growth Fund II") is True
    assert one(spark, N.is_valid_name(F.col("n")), n="Series A") is False
    assert one(spark, N.canonical_alias(F.col("n")), n="Facebook") == "meta"
    assert one(spark, N.relationship_reason(F.col("s"), F.col("p"), F.col("o")), s="Acme", p="ACQUIRED", o=" acme").startswith("Self-reference")


@pytest.mark.parametrize("text,value", [("$2.5 billion", 2.5e9), ("$530M", 5.3e8), ("1,200", 1200.0), ("12k", 12e3), ("none", None)])
def test_money(spark, text, value):
    assert one(spark, T.money(F.col("t")), t=text) == value


def test_amounts_in_context(spark):
    assert one(spark, T.amount_text(F.col("t")), t="raised $12.5 million today") == "$12.5 million"
    assert one(spark, T.layoff_count(F.col("t")), t="laid off 1,200 workers") == 1200


@pytest.mark.parametrize("a,b", [("kitten", "sitting"), ("", "abc"), ("acme corp", "acme co"), ("aaaa", "aa")])
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs(a, b) == table[-1][-1] >= sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
