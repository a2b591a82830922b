"""Company cards of landed directory pages (SRC-17)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FOUNDER = "array<struct<name:string,title:string,linkedin:string>>"


class CardReader(HTMLParser):
    """Gathers `a` elements with "company" in their class, and of each the text of its first `span` with "name" in its class."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []  # tag, and the card or name that the element is

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        kind, found = given.get("class", ""), None
        if tag == "a" and "company" in kind:
            found = {"href": given.get("href", ""), "name": None}
            self.cards.append(found)
        elif tag == "span" and "name" in kind:
            found = {"text": []}
            for _, card in self.open:
                if card and "href" in card and card["name"] is None:
                    card["name"] = found
        if tag not in VOID:
            self.open.append((tag, found))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        for _, found in self.open:
            if found and "text" in found:
                found["text"].append(data)


def cards_of(html: str | None, limit: int) -> list[tuple[int, str, str]]:
    """(place, name, href) of the first `limit` cards; those without a name count but are left out."""
    reader = CardReader()
    reader.feed(html or "")
    reader.close()
    return [(k, "".join(c["name"]["text"]).strip(), c["href"]) for k, c in enumerate(reader.cards[:limit]) if c["name"]]


def company_cards(pages: DataFrame, page: str = "page_id", html: str = "html", limit: int = 500) -> DataFrame:
    """SRC-17: companies of each page's first `limit` cards, with the columns of `filings.parse_directory` after the page's
    id and the card's place on it.

    A null or empty page has none; a card without link gives an empty slug and website; a name of white space is empty."""
    kind = pages.schema[page].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(p, *card) for p, text in zip(rows["page"], rows["html"], strict=True) for card in cards_of(text, limit)]
            yield pd.DataFrame(found, columns=["page", "place", "name", "href"])

    rows = pages.select(F.col(page).alias("page"), F.col(html).alias("html")).filter("page IS NOT NULL AND html IS NOT NULL")
    found = rows.mapInPandas(read, f"page {kind}, place int, name string, href string")
    none = lambda of: F.array().cast(of)
    return found.select(
        F.col("page").alias(page), "place", "name", F.element_at(F.split("href", "/"), -1).alias("slug"), F.lit("").alias("batch"), F.lit("Active").alias("status"), F.lit("").alias("description"),
        none("array<string>").alias("industries"), F.lit(None).cast("int").alias("team_size"), F.lit("").alias("location"), F.col("href").alias("website"), none(FOUNDER).alias("founders"),
    )
