"""Column builders for entity names (FN-03..10, FN-27, FLT-09..16, FN-30)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import constants as K


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_key(c: Column) -> Column:
    """Lower case without outer white space."""
    return strip(F.lower(c))


def contains_any(c: Column, parts: list[str]) -> Column:
    return c.rlike("|".join(re.escape(p) for p in parts))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def without_suffixes(c: Column, suffixes: list[str]) -> Column:
    """Each suffix in turn is cut once, if the text (without outer white space) then ends with it, with the white space before it."""
    cut = reduce(lambda x, suffix: F.regexp_replace(x, r"(?U)\s*" + re.escape(suffix) + r"\z", ""), suffixes, c)
    # most names end with none, which one look tells
    return F.when(c.rlike("(?:" + "|".join(map(re.escape, suffixes)) + r")\z"), cut).otherwise(c)


def normalize_name(c: Column, suffixes: list[str] = K.ENTITY_SUFFIXES) -> Column:
    base = without_suffixes(plain_key(c), [s.lower() for s in suffixes])
    return squeeze(F.regexp_replace(base, r"(?U)[^\w\s]", ""))


def strip_one_suffix(name: Column, kind: Column) -> Column:
    """The first suffix that fits is cut from a company's name, case-sensitive."""
    name = strip(name)
    cut = F.coalesce(*(F.when(name.endswith(s), strip(F.substr(name, F.lit(1), F.length(name) - len(s)))) for s in K.ONE_SUFFIX), name)
    return F.when(kind == "company", cut).otherwise(name)


def digest_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(plain_key(c), r"\s*(inc\.?|llc|ltd\.?|corp\.?|co\.?|global|technologies|technology)$", ""))


def clean_filing_name(c: Column) -> Column:
    for p in K.PLACEHOLDERS:
        c = F.regexp_replace(c, "^" + re.escape(p), "")
    c = F.regexp_replace(c, r"(?is)^LLC (.*)\z", "$1 LLC")
    return strip(c)


def underlying_company(c: Column) -> Column:
    months = "Dec|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov"
    found = F.regexp_extract(c, rf"^([A-Za-z0-9\s]+?)(?:\s+(?:{months})\s+\d{{4}})?\s+a\s+[Ss]eries\s+of", 1)
    return F.nullif(strip(found), F.lit(""))


def sanitize_name(c: Column) -> Column:
    for pattern in ("<[^>]+>", 'target="_blank">', 'href="[^"]*"', r"https?://[^\s]+"):
        c = F.regexp_replace(c, pattern, "")
    return F.coalesce(squeeze(c), F.lit(""))


def url_slug(c: Column) -> Column:
    for s in K.URL_SUFFIXES:
        c = F.regexp_replace(c, re.escape(s) + r"\z", "")
    return F.regexp_replace(F.regexp_replace(plain_key(c), r"[^a-z0-9\s-]", ""), r"\s+", "-")


def guessed_domain(c: Column) -> Column:
    bare = F.replace(url_slug(c), F.lit("-"), F.lit(""))
    return F.when(bare != "", F.concat(bare, F.lit(".com")))


def is_valid_name(c: Column) -> Column:
    name = strip(c)
    bad = F.lower(name).isin(K.INVALID_NAMES) | reduce(Column.__or__, (name.rlike(p) for p in K.INVALID_PATTERNS))
    bad = bad | ~name.rlike("[a-zA-Z]") | (F.length(name) < 2) | name.rlike(r"^(https?://|www\.)")
    return F.coalesce((F.length(c) >= 2) & ~bad, F.lit(False))


def relationship_reason(s: Column, p: Column, o: Column) -> Column:
    """OK, or why the relationship is not valid."""
    generic = F.lower(s).isin(K.GENERIC_TERMS) | F.lower(o).isin(K.GENERIC_TERMS)
    one_word = ~strip(s).rlike(r"(?U)\s") & ~s.rlike(r"^\p{Lu}")
    return (
        F.when(~is_valid_name(s), F.concat(F.lit("Invalid subject: "), s))
        .when(~is_valid_name(o), F.concat(F.lit("Invalid object: "), o))
        .when(plain_key(s) == plain_key(o), F.concat(F.lit("Self-reference: "), s))
        .when((p == "ACQUIRED") & generic, F.concat(F.lit("Generic acquisition target: "), s, F.lit(" -> "), o))
        .when(p.isin("HIRED_BY", "DEPARTED_FROM") & one_word, F.concat(F.lit("Subject doesn't look like person name: "), s))
        .otherwise("OK")
    )


def is_good_entity(name: Column, kind: Column) -> Column:
    low = plain_key(name)
    good = F.length(name).between(2, 50) & ~contains_any(low, K.BAD_FRAGMENTS) & ~low.isin(K.COMMON_WORDS)
    return F.coalesce(good & ((kind != "person") | strip(name).rlike(r"(?U)\S\s+\S")), F.lit(False))


def is_fund(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(contains_any(low, K.FUND_PARTS) | reduce(Column.__or__, (low.rlike(p) for p in K.FUND_PATTERNS)), F.lit(False))


def is_organisation(c: Column) -> Column:
    up = F.upper(c)
    return F.coalesce(contains_any(up, K.ORGANISATION_PARTS) | up.startswith("LLC ") | up.startswith("THE "), F.lit(False))


def is_digest_company(c: Column) -> Column:
    return F.coalesce((F.length(c) >= 2) & ~contains_any(F.lower(c), K.DIGEST_DENIED), F.lit(False))


def is_person_name(c: Column) -> Column:
    return F.coalesce((F.length(c) >= 3) & ~contains_any(F.lower(c), K.PERSON_DENIED), F.lit(False))


def canonical_alias(c: Column) -> Column:
    """J-10: canonical name of a known alias, after normalising."""
    names = F.create_map(*(F.lit(x) for canonical, others in K.KNOWN_ALIASES.items() for other in others for x in (other, canonical)))
    return F.get(F.transform(F.array(normalize_name(c)), lambda key: F.coalesce(F.try_element_at(names, key), key)), F.lit(0))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.75, "medium").otherwise("low")
