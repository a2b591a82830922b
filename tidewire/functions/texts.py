"""Column builders over article texts and contexts (FN-01, FN-02, FN-11..15, FN-22, FN-23, SRC-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import constants as K
from tidewire.functions.names import contains_any


def classify(title: Column, content: Column) -> Column:
    """struct(primary_type, all_types, confidence, matched_keywords, is_high_signal); the title counts twice.

    Patterns follow Unicode's classes; an ASCII text is searched without them, to the same result."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    patterns = [(place, kind, p, weight) for place, (kind, both) in enumerate(K.EVENT_PATTERNS.items()) for ps, weight in zip(both, (2.0, 0.5), strict=True) for p in ps]

    def found(flags: str) -> Column:
        return F.array(*(F.regexp_extract_all(text, F.lit(f"(?{flags}){p}"), F.lit(1 if "(" in p else 0)) for _, _, p, _ in patterns))

    def ranked(words: Column) -> Column:
        scores = {}
        for k, (place, kind, _, weight) in enumerate(patterns):
            scores[place, kind] = scores.get((place, kind), F.lit(0.0)) + F.size(words[k]) * weight
        rows = [F.struct((-score).alias("least"), F.lit(place).alias("place"), F.lit(kind).alias("kind")) for (place, kind), score in scores.items()]
        return F.array_sort(F.filter(F.array(*rows), lambda x: x.least < 0))

    def verdict(x: Column) -> Column:
        some, top = F.size(x.ranked) > 0, F.get(x.ranked, F.lit(0))
        confidence = F.when(some, F.least(F.lit(1.0), -top.least / 5)).otherwise(0.5)
        return F.struct(
            F.coalesce(top.kind, F.lit("other")).alias("primary_type"),
            F.when(some, F.transform(x.ranked, lambda r: r.kind)).otherwise(F.array(F.lit("other"))).alias("all_types"),
            confidence.alias("confidence"),
            F.array_sort(F.array_distinct(F.flatten(x.words))).alias("matched_keywords"),
            (some & (confidence >= 0.5)).alias("is_high_signal"),
        )

    # what is found is bound to a name, so that each pattern is searched once
    words = F.when(text.rlike(r"^[\x00-\x7F]*$"), found("i")).otherwise(found("iU"))
    bound = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), ranked(w).alias("ranked")))
    return F.get(F.transform(bound, verdict), F.lit(0))


def extraction_potential(title: Column, content: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, content))
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    checks = {
        "has_amounts": text.rlike("(?i)" + K.AMOUNT_PATTERN), "has_person_names": contains_any(text, K.PERSON_INDICATORS),
        "has_company_names": text.rlike(r"(inc\.|corp\.|llc|ltd\.)"), "has_dates": text.rlike(rf"({months}|\d{{4}})"),
    }
    score = sum((c.cast("int") for c in checks.values()), F.lit(0)) / 4
    band = F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")
    return F.struct(score.alias("overall_score"), *(c.alias(n) for n, c in checks.items()), band.alias("extraction_potential"))


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def amount_text(c: Column) -> Column:
    return F.coalesce(_found(c, r"(?i)\$(\d+(?:,\d{3})*(?:\.\d+)?)\s*(million|billion|M|B)"), _found(c, r"\$(\d+(?:,\d{3})*(?:\.\d+)?)"))


def layoff_count(c: Column) -> Column:
    first = _found(c, r"(?i)(\d+(?:,\d{3})*)\s*(?:employees|people|workers|staff)", 1)
    return F.replace(F.coalesce(first, _found(c, r"(?i)laid off (\d+(?:,\d{3})*)", 1)), F.lit(","), F.lit("")).cast("long")


def parse_amount(c: Column) -> Column:
    """Dollar text to double; what is no number is null."""
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def money(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(c), "[$,]", ""))
    tries = [_found(text, rf"([\d.]+)\s*{word}", 1).try_cast("double") * factor for word, factor in K.MULTIPLIERS]
    return F.coalesce(*tries, text.try_cast("double"))


def round_type(c: Column) -> Column:
    return F.coalesce(*(F.when(contains_any(c, words), kind) for kind, words in K.ROUNDS))


def routing(text: Column, orgs: Column, people: Column, amounts: Column, kind: Column) -> Column:
    """struct(needs_deep, reason) from keywords and how many organisations and people were met."""
    low = F.lower(text)
    bought, moved, cut = (contains_any(low, x) for x in (K.ACQUISITION_WORDS, K.EXECUTIVE_WORDS, K.LAYOFF_WORDS))
    funded = kind.isNotNull() | contains_any(low, dict(K.ROUNDS)["funding"])
    n, m = F.size(orgs), F.size(people)
    reason = (
        F.when(bought, F.when(n >= 2, "acquisition_multiple_orgs").otherwise("acquisition_unclear_parties"))
        .when(moved & (m > 0) & (n > 1), "executive_multiple_orgs")
        .when(moved & (m > 1), "executive_multiple_people")
        .when(moved & (n == 1) & (m == 1), F.lit(None))
        .when(cut, "layoff_details")
        .when(funded & (n == 1) & (F.size(amounts) > 0) & kind.isNotNull(), F.lit(None))
        .when(funded & (n >= 2), "funding_multiple_orgs")
        .when(~(bought | moved | cut | funded), "unclear_event_type")
        .otherwise("complex_extraction")
    )
    return F.struct(reason.isNotNull().alias("needs_deep"), reason.alias("reason"))


def amounts_compatible(a: Column, b: Column, tolerance: float = 0.20) -> Column:
    known = a.isNotNull() & b.isNotNull() & (a != 0) & (b != 0)
    return F.when(known, F.abs(a - b) / F.greatest(a, b) <= tolerance).otherwise(True)


def match_score(similarity: Column, days: Column, compatible: Column, window: int = 30) -> Column:
    near = F.greatest(F.lit(0.0), (F.lit(window) - days) / window)
    return F.least(F.lit(1.0), 0.5 * similarity + 0.3 * near + 0.2 * compatible.cast("int"))


def amounts_of(texts: Column) -> Column:
    """SRT-05: the amounts of an array of money texts, largest first; what is no amount is left out."""
    return F.sort_array(F.filter(F.transform(texts, money), lambda x: x.isNotNull()), asc=False)
