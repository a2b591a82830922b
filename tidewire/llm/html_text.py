"""HTML main text by two-pass block rules.

The first pass cuts a page into blocks and decides them by length, link density, stop-word
density and the elements they stand in.  The second lets each block that is still open (too
short, or without stop words) inherit the label of its nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_slices

#: Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can do for from had has have he her his i if in into is it its me more my no not of on one or our
    she so some than that the their them then there these they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat ich ihr im in ist
    mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais mes ne nous on ou où par pas plus pour qu que qui
    sa se ses son sont sur tout très tu un une vous y
    al como con cual de del desde donde el ella ellos en entre era es esta este fue ha hasta hay la las lo los más mi muy no nos o para pero por porque
    que se sin sobre son su sus también te tiene todo un una uno y ya""".split()
)
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br td th".split())
#: Elements that hold no article text, and those that do not when they stand outside the article.
NEVER = frozenset("head title nav footer aside form menu dialog".split())
#: Of these a form may be the page itself; what shows that an element is.
PAGE = frozenset("article main h1".split())
OUTSIDE = frozenset("header hgroup".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
#: Parts of class names and ids of elements that hold no article text, whatever stands in them.
_NAMES = r"""ads?|advert\w*|adverti[sz]ing|banners?|promos?|sponsor(?:ed|s)?|sidebars?|navbar|navigation|breadcrumbs?|footer|cookies?|consent|
gdpr|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|sharing|related|recommend\w*|teasers?|
comments?|commentlist|disqus|replies|reply|respond|widgets?|pagination|pager|toolbar|copyright|disclaimer|skiplink|hidden"""
UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{''.join(_NAMES.split())})(?=$|[\s_-])", re.I)
#: A name says so only by its last part, these left aside, and not after one of the others: `post-comments` is unwanted,
#: `comments-open`, `related-work` and `has-sidebar` are names that weigh against a block.
CONTAINERS = frozenset(
    """area bar block blocks body bottom box button buttons col column container content fixed form group head header holder icons inner item items left link links list main message module
    msg nav news notice outer panel posts articles stories products videos topics reading primary region right row secondary section sections slot sticky text thread title top unit wrap wrapper zone""".split()
)
NOT_ITSELF = frozenset("has have no non not with without is".split())
#: These say so as a whole name; as a part of one, or the last ones outside an article, they only weigh against a block.
_WHOLE = "menus?|nav|notices?|alerts?|search|share|social|skip|side|legal|discussion|promotions?"
WHOLE = re.compile(rf"(?:^|\s)(?:{_WHOLE})(?=$|\s)", re.I)
DOUBTFUL = re.compile(rf"(?:^|[\s_-])(?:{_WHOLE})(?=$|[\s_-])", re.I)
DOUBTFUL_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|masthead|top|bar)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)
    |<(noscript|template|svg|math|textarea|select|button|iframe|object|canvas|audio|video|title)\b[^>]*>(?:(?:(?!<\2\b).)*?</\2\s*>)?
    |<(/?)([a-z][a-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*+)>|<[!?/][^>]*+>""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
#: Scripts that put no blanks between words, and their commonest letters of grammar.
UNSPACED = re.compile(r"[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]")
GRAMMAR = frozenset("的了是在不和有我他这個个们中来上大为到说就也要以时会可你对生能而子那得于着下自之のはをにがとでもた")

MAX_LINKS = 0.5
SOME_LINKS = 0.2
SHORT_WORDS = 20
STOP_SHARE = 0.1


class Block:
    __slots__ = ("text", "words", "links", "stops", "scopes", "unwanted", "doubtful", "inside", "heading", "para", "label")

    def __init__(self, text: str, link_chars: int, place: Place):
        letters = LETTERS.findall(text.lower())
        self.text, self.words = text, len(text.split())
        self.links = link_chars / max(1, len(text))
        self.stops = sum(w in STOP_WORDS for w in letters) / max(1, len(letters))
        unspaced = UNSPACED.findall(text)
        if 2 * len(unspaced) > sum(map(len, letters)):
            # two letters count as a word
            self.words = max(self.words, len(unspaced) // 2)
            self.stops = 2 * sum(c in GRAMMAR for c in unspaced) / len(unspaced)
        self.scopes, self.unwanted, self.doubtful, self.inside = place.scopes, place.unwanted, place.doubtful, place.inside
        self.heading, self.para, self.label = place.tag[:1] == "h" and place.tag[1:].isdigit(), place.tag == "p", None

    def prose(self) -> bool:
        return self.words >= SHORT_WORDS and self.stops >= STOP_SHARE and self.links <= SOME_LINKS


class Scope:
    """An element that its name, or being a form, marks as no article; whether it holds what a page is made around."""

    __slots__ = ("page",)

    def __init__(self):
        self.page = False


class Place(NamedTuple):
    """An open element: scopes it is in, whether an element says that no article is here, names of doubt, inside an article."""

    tag: str
    scopes: tuple[Scope, ...]
    unwanted: bool
    doubtful: bool
    inside: bool


NOWHERE = Place("", (), False, False, False)


def says_unwanted(value: str) -> bool:
    """Whether one of the names of a class or id says that its element holds no article."""
    for name in value.split():
        if WHOLE.fullmatch(name):
            return True
        parts = [x for x in re.split(r"[_-]+", name.lower()) if x]
        while len(parts) > 1 and (parts[-1] in CONTAINERS or parts[-1].isdigit()):
            parts.pop()
        if parts and not NOT_ITSELF.intersection(parts) and UNWANTED.search(parts[-1]):
            return True
    return False


def _named_unwanted(tag: str, attributes: str) -> bool:
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() not in ("class", "id"):
            continue
        if tag not in ("html", "body", "article", "main") and says_unwanted(value):
            return True
        if tag == "article" and re.search(r"comment|teaser|related|promo|(?:^|[\s_-])ads?(?=$|[\s_-])", value, re.I):
            return True
    return False


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the element itself, its role or its being hidden says that no article is in it."""
    if (tag in NEVER and tag != "form") or (tag in OUTSIDE and not inside):
        return True
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _doubtful(tag: str, attributes: str, inside: bool) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    names = (a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))
    return any(DOUBTFUL.search(x) or UNWANTED.search(x) or not inside and DOUBTFUL_OUTSIDE.search(x) for x in names)


def blocks(page: str) -> Iterator[Block]:
    """The page's blocks with text, in order."""
    stack: list[Place] = []
    pieces: list[str] = []
    link_chars, in_link, at = 0, False, 0

    def flush() -> Iterator[Block]:
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        if text:
            yield Block(text, link_chars, stack[-1] if stack else NOWHERE)
        pieces.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if in_link:
            link_chars += len(" ".join(text.split()))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[4] or m[7]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[3] or m[6], m[5] or m[8] or ""
        if tag == "a":
            in_link = not closing
        elif tag in SPACE:
            pieces.append(" ")
        if tag not in BLOCK:
            if tag in ("span", "td", "th", "a", "b", "i", "em", "strong", "small") or tag in VOID:
                continue
            if not attributes and not any(x[0] == tag for x in stack):
                continue
        yield from flush()
        if closing:
            in_link = False
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID:
            if stack and stack[-1][0] == "p" and tag in BLOCK:
                stack.pop()
            if tag == "body":
                stack = [x for x in stack if x[0] == "html"]
            if stack and stack[-1][0] in CLOSES.get(tag, ()):
                stack.pop()
            around = stack[-1] if stack else NOWHERE
            own, named = _unwanted(tag, attributes, around.inside), tag == "form" or _named_unwanted(tag, attributes)
            if tag in PAGE and not (own or named or around.unwanted):
                for scope in around.scopes:
                    scope.page = True
            scopes = (*around.scopes, Scope()) if named else around.scopes
            doubtful, inside = around.doubtful or _doubtful(tag, attributes, around.inside), around.inside or (tag in ("article", "main") and not (own or named))
            stack.append(Place(tag, scopes, around.unwanted or own, doubtful, inside))
    if at < len(page):
        add(page[at:])
    yield from flush()


def weigh_scopes(found: list[Block]) -> None:
    """Marks blocks of scopes as unwanted.  Where that would leave a page no prose, forms and names that hold the page's
    article or first heading, or, without these, all of its prose in several blocks, count for nothing."""
    if any(b.prose() and not b.unwanted and not b.scopes for b in found):
        void = set()
    else:
        void = {s for b in found for s in b.scopes if s.page}
        if not void:
            several = Counter(s for b in found if b.prose() and not b.unwanted for s in b.scopes[:1])
            void = {s for s, n in several.items() if n > 1 and len(several) == 1}
    for b in found:
        b.unwanted = b.unwanted or any(s not in void for s in b.scopes)


def decide(found: list[Block]) -> None:
    """First pass: True (text), False (not), None (open).  In an element with a doubtful name a block
    with links needs what prose has: length, stop words, few links.  A paragraph of an article may be
    one link; its neighbours say."""
    weigh_scopes(found)
    marked = any(b.inside and not b.unwanted for b in found)
    for b in found:
        linked = b.links > MAX_LINKS and not (b.inside and b.para and not b.doubtful)
        if b.unwanted or (marked and not b.inside) or linked or (b.doubtful and b.links > 0 and not b.prose()):
            b.label = False
        elif b.words < SHORT_WORDS:
            b.label = False if b.links > SOME_LINKS and not b.inside else None
        elif b.stops >= STOP_SHARE and b.links <= MAX_LINKS:
            b.label = True


def inherit(found: list[Block]) -> list[bool]:
    """Second pass: open blocks take the label of the nearest decided one; at equal distance the
    following one's for headings, else text wins inside an article and for paragraphs without links.  Without any decided
    neighbour a block without links is text."""
    n = len(found)
    before, after = [None] * n, [None] * n
    last = None
    for k in range(n):
        before[k] = last
        last = k if found[k].label is not None else last
    last = None
    for k in reversed(range(n)):
        after[k] = last
        last = k if found[k].label is not None else last
    # outside blocks of a page with an article say nothing about the blocks in it
    marked = any(b.inside and not b.unwanted for b in found)
    out = []
    for k, b in enumerate(found):
        if b.label is not None:
            out.append(b.label)
            continue
        near = [(abs(j - k), found[j].label, j > k) for j in (before[k], after[k]) if j is not None and (not marked or found[j].inside and not found[j].unwanted)]
        near.sort(key=lambda x: x[0])
        if not near:
            out.append(b.links == 0)
        elif len(near) == 1 or near[0][0] < near[1][0] or near[0][1] == near[1][1]:
            out.append(near[0][1])
        else:
            out.append(next(label for _, label, later in near if later) if b.heading else b.inside or b.para and b.links == 0)
    return out


def main_text(page: str | None) -> str:
    found = list(blocks(page or ""))
    decide(found)
    return "\n\n".join(b.text for b, keep in zip(found, inherit(found), strict=True) if keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: id, url, text, n_chars, from the whole page.

    Null, empty or text-free pages give an empty text.  Broken markup is read as far as it
    goes: an element that is not closed ends with its parent, and of one that hides its content
    (a button, a drawing) without a closing tag the tag alone is dropped; only an unclosed script,
    style or comment hides the rest of a page.  Repeated rows are extracted one
    by one; other columns are not read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return map_slices(pages.select(id_col, url_col, F.col(html_col).cast("string")), run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long", rows=64)
