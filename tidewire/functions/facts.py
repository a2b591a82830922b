"""Facts about companies and people in texts (FN-25, FN-26, FN-28): tables of ordered patterns, of which the first that gives a value counts.

A null text gives no facts.  Patterns are searched as in Python: without regard to case, by Unicode's classes, a line
ends at a line feed alone."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import constants as K
from tidewire.functions.names import guessed_domain, strip, url_slug

FLAGS = "(?iUd)"


def quoted(name: Column) -> Column:
    """A pattern that the name alone fits."""
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def pattern_of(pattern: str, name: Column | None) -> Column:
    if "NAME" not in pattern or name is None:
        return F.lit(FLAGS + pattern)
    before, after = pattern.split("NAME")
    return F.concat(F.lit(FLAGS + before), quoted(name), F.lit(after))


def found(text: Column, pattern: str, name: Column | None = None, group: int | None = None) -> Column:
    """What the first match of the pattern gives: its group, or all of it where it has none; null without a match."""
    group = group if group is not None else min(1, re.compile(pattern).groups)
    return F.nullif(F.call_function("regexp_extract", text, pattern_of(pattern, name), F.lit(group)), F.lit(""))


def first_found(text: Column, patterns: list[str], name: Column | None = None, take: Callable[[Column], Column] = strip) -> Column:
    return F.coalesce(*(take(found(text, p, name)) for p in patterns))


def all_found(text: Column, patterns: list[str], most: int, split: str | None = None) -> Column:
    """Distinct values of all matches, pattern by pattern in order of place, at most so many."""
    each = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(FLAGS + p), F.lit(1)) for p in patterns)))
    if split:
        each = F.flatten(F.transform(each, lambda x: F.transform(F.split(x, split), strip)))
    return F.slice(F.array_distinct(each), 1, most)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def first_kind(text: Column, kinds: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(has(text, p), kind) for kind, p in kinds))


def titled(c: Column) -> Column:
    """Each run of letters with one capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def description(text: Column, name: Column) -> Column:
    told = F.concat(name, F.lit(" is "), found(text, r"NAME[^.]*\s+is\s+([^.]+\.)", name))
    at = F.call_function("locate", F.lower(name), F.lower(text))
    snippet = F.concat(F.split_part(F.substr(text, at, F.lit(300)), F.lit("."), F.lit(1)), F.lit("."))
    return F.coalesce(told, F.when((at > 0) & (F.length(snippet) > 30), snippet))


def company_facts(text: Column, name: Column) -> Column:
    """FN-25.  A year outside 1900 to 2026 and a site of a directory leave the word to the next pattern."""
    count = F.replace(first_found(text, K.HEAD_COUNTS), F.lit(","), F.lit("")).try_cast("long")
    band = F.coalesce(*(F.when(count <= most if most else count.isNotNull(), label) for most, label in K.HEAD_COUNT_BUCKETS))
    year = lambda c: F.when(c.cast("int").between(1900, 2026), c.cast("int"))
    # the number and the unit of the first pattern that is met
    sums = F.coalesce(*(F.when(found(text, p).isNotNull(), F.struct(found(text, p).alias("n"), F.lower(found(text, p, group=2)).alias("unit"))) for p in K.FUNDING_TOTALS))
    large = sums["unit"].isin("billion", "b")
    site = lambda c: F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))
    own = lambda c: F.when(~site(c).rlike("|".join(K.OTHER_SITES)), site(c))
    url = first_found(text, K.WEBSITES, take=own)
    return F.struct(
        description(text, name).alias("description"),
        count.alias("employee_count"),
        band.alias("employee_range"),
        first_found(text, K.HEADQUARTERS).alias("headquarters"),
        first_found(text, K.FOUNDING_YEARS, take=year).alias("founded_year"),
        F.concat(F.lit("$"), sums["n"], F.when(large, "B").otherwise("M")).alias("total_funding"),
        (sums["n"].try_cast("double") * F.when(large, 1e9).otherwise(1e6)).cast("long").alias("total_funding_amount"),
        titled(first_found(text, K.FUNDING_ROUNDS)).alias("last_funding_type"),
        titled(first_found(text, K.INDUSTRIES)).alias("industry"),
        first_kind(text, K.COMPANY_TYPES).alias("company_type"),
        url.alias("website_url"),
        F.nullif(F.regexp_extract(url, r"(?:https?://)?(?:www\.)?([a-z0-9-]+\.[a-z]{2,})", 1), F.lit("")).alias("domain"),
    )


def person_facts(text: Column, name: Column) -> Column:
    """FN-26.  An employer's name has over two and under fifty letters; lists keep the order of the text."""
    executive = F.coalesce(has(text, K.EXECUTIVE), F.lit(False))

    def employer(c: Column) -> Column:
        short = F.regexp_replace(strip(c), FLAGS + r"\s+(?:in|as|where|and).*$", "")
        return F.when((F.length(short) > 2) & (F.length(short) < 50), short)

    return F.struct(
        first_found(text, K.JOB_TITLES, name).alias("current_title"),
        executive.alias("is_executive"),
        F.when(executive, first_kind(text, K.EXECUTIVE_LEVELS)).alias("executive_level"),
        first_found(text, K.EMPLOYERS, name, take=employer).alias("current_company"),
        first_found(text, K.PLACES).alias("location"),
        all_found(text, K.EARLIER_EMPLOYERS, 5, split=",").alias("previous_companies"),
        all_found(text, K.SCHOOLS, 3).alias("education"),
        all_found(text, K.SKILLS, 5).alias("skills"),
    )


def company_pages(name: Column) -> Column:
    """FN-28: the addresses of a company's pages in two directories."""
    return F.array(*(F.concat(F.lit(page), url_slug(name)) for page in K.COMPANY_PAGES))


def person_page(name: Column) -> Column:
    """FN-28: the address of a search for a person."""
    return F.concat(F.lit(K.PERSON_SEARCH), F.url_encode(name))


def with_pages(facts: Column, name: Column) -> tuple[Column, Column]:
    """A company's domain and site: those of the text, else what its name suggests."""
    domain = F.coalesce(facts["domain"], guessed_domain(name))
    return domain, F.coalesce(facts["website_url"], F.concat(F.lit("https://"), domain))
