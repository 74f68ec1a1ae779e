"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags and double line breaks; each block carries its words, its linked
characters, and the elements it stands in. First pass, block by block: blocks in menus, headers, footers, sidebars,
notices, adverts, forms and comments are bad; blocks that are mostly links are bad; then stop-word density, length
and link density tell good blocks, bad ones, and ambiguous short or nearly good ones. How dense stop words must be
depends on the page: where they are few in all of its longer texts, as in a language whose words aren't listed, the
bounds are lower in proportion, so that length and links decide. Second pass: an ambiguous block takes the label of its
nearest decided neighbours, the better one first if it is nearly good; a heading goes with what follows it, and a short
block that has a good one right beside it in the same element and of the same kind goes with that. An article that
the author marks shifts the thresholds, for prose there may have no stop words: what would be bad or ambiguous inside
of it is ambiguous and leans to good unless its links are many, and what is ambiguous outside of it is good between
good neighbours only. The mark counts nothing where more good text stands outside than text with few links inside,
as on a page whose related items are marked as articles.

Defined results: a null, blank or plain-menu page has the empty text; blocks of a page where no block is decided are all kept; unclosed and stray tags are borne, an
unclosed head ends at the first text or tag that may not stand in it; equal rows
have equal texts; an empty table gives no rows; further columns are not read. Time is in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import in_batches, table

#: Common words of four languages.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like
    me more my no not of on one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann mehr mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même mon ne nous on ont ou où par pas plus pour qu que qui sa se ses son sont sur ta te tu un une vous
    al algo como con cual cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene un una uno y ya yo""".split()
)
#: Element names by what they do.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option button datalist".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())  # any other start tag ends an open head
REGIONS = frozenset("nav header footer aside form dialog menu".split())
ARTICLES = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|comments?|commentlist|disqus|replies|respond|share|social|related|recommended|widget|toolbar|pagination|pager|login|signup|search)(?=$|[\s_-])",
    re.I,
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?=$|[\s_-])", re.I)
BAD_ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alertdialog|alert|form|menu|menubar|toolbar)$", re.I)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINKS_MOST = 0.2
LINKS_MOST_IN_ARTICLE = 0.6

_NEXT = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("article", "home", "linked", "parts", "region")

    def __init__(self, region: bool, article: bool, home: tuple[str, int]):
        self.parts: list[str] = []
        self.linked, self.region, self.article = 0, region, article
        self.home = home  # its element's name, and which element that stands in


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Of an element: not to be read at all, a region without main text, a place of comments."""
    if tag in SILENT:
        return True, False, False
    region, comments, hidden = tag in REGIONS, False, False
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id") and tag not in ("body", "html"):
                region |= bool(BAD_NAME.search(value)) and tag not in ARTICLES
                comments |= bool(COMMENTS.search(value))
            elif name == "role":
                region |= bool(BAD_ROLE.match(value))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
    return hidden and tag not in ("html", "body"), region or comments, comments


def blocks(html: str) -> list[Block]:
    """In page order, with their raw text."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, int]] = []  # element, silent, region, article, comments, each with those around it, and its number
    current: Block | None = None
    links = breaks = pos = number = 0

    def home() -> tuple[str, int]:
        at = len(stack) - 1
        while at >= 0 and stack[at][0] not in BLOCKS:
            at -= 1
        return (stack[at][0] if at >= 0 else "", stack[at - 1][5] if at > 0 else 0)

    def add(text: str) -> None:
        nonlocal current, breaks
        if stack and stack[-1][0] == "head" and text and not text.isspace():
            pop(len(stack) - 1)
        silent, region, article, *_ = stack[-1][1:] if stack else (False, False, False)
        if silent or not text:
            return
        if text.isspace():
            if current:
                current.parts.append(" ")
            return
        if current is None:
            current = Block(region, article, home())
            found.append(current)
        text = unescape(text) if "&" in text else text
        current.parts.append(text)
        breaks = 0
        if links:
            current.linked += len(" ".join(text.split()))

    def pop(to: int) -> None:
        nonlocal links
        for tag, *_ in stack[to:]:
            links -= tag == "a"
        del stack[to:]

    size = len(html)
    while pos < size:
        at = html.find("<", pos)
        if at < 0:
            add(html[pos:])
            break
        add(html[pos:at])
        m = _NEXT.match(html, at)
        if not m:
            add("<")
            pos = at + 1
            continue
        pos = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and stack and (tag == "body" or (stack[-1][0] == "head" and tag not in IN_HEAD and tag not in ("head", "html"))):
            for k, x in enumerate(stack):
                if x[0] == "head":
                    pop(k)
                    break
        if tag in ("script", "style", "textarea", "title") and not closing:  # raw text up to the end tag
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else size
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                current = None
            elif current:
                current.parts.append(" ")
            continue
        if tag in BLOCKS:
            current = None
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in VOID:
            continue
        if stack and (closers := CLOSED_BY.get(stack[-1][0])) and tag in closers:
            pop(len(stack) - 1)
        elif tag in BLOCKS and len(stack) > 1 and any(x[0] == "p" for x in stack[-6:]):
            for k in range(len(stack) - 1, max(-1, len(stack) - 7), -1):  # a paragraph with open inline elements ends too
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        silent, region, comments = _marks(tag, m[3])
        around, number = stack[-1] if stack else ("", False, False, False, False, 0), number + 1
        if tag in ARTICLES and not around[4] and not comments:
            # an article inside a menu or header that was never closed
            stack.append((tag, around[1] or silent, silent, True, False, number))
        else:
            stack.append((tag, around[1] or silent, around[2] or region, around[3], around[4] or comments, number))
        links += tag == "a"
    return found


GOOD, BAD, SHORT, NEAR, INSIDE, OUTSIDE = "good", "bad", "short", "near", "inside", "outside"


def _stops(text: str) -> tuple[int, int]:
    """How many stop words a text has, of how many words."""
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found), len(found)


def _labels(some: list[tuple[Block, str]]) -> tuple[list[str], list[bool]]:
    """The labels on a page without marks, and whether a block is short or has about as many stop words as prose on this page."""
    plain = [not b.region and b.linked / len(t) <= LINKS_MOST for b, t in some]
    stops = [_stops(t) if len(t) >= LENGTH_LOW and not b.region else (0, 0) for b, t in some]
    n, of = (sum(x) for x in zip(*(x for x, ok in zip(stops, plain, strict=True) if ok), strict=True)) if any(plain) else (0, 0)
    page = n / max(1, of)
    low, high = min(STOP_LOW, 0.5 * page), min(STOP_HIGH, 0.75 * page)
    labels, wordy = [], []
    for (b, t), ok, (n, of) in zip(some, plain, stops, strict=True):
        size, density = len(t), n / max(1, of)
        wordy.append(size < LENGTH_LOW or density >= low)
        if not ok:
            labels.append(BAD)
        elif size < LENGTH_LOW:
            labels.append(BAD if b.linked else SHORT)
        elif density >= high:
            labels.append(GOOD if size > LENGTH_HIGH else NEAR)
        else:
            labels.append(NEAR if density >= low else BAD)
    return labels, wordy


def _first(some: list[tuple[Block, str]]) -> list[str]:
    labels, wordy = _labels(some)
    inside = sum(len(t) for b, t in some if b.article and not b.region and b.linked / len(t) <= LINKS_MOST)
    if not inside or inside < sum(len(t) for (b, t), x in zip(some, labels, strict=True) if x == GOOD and not b.article):
        return labels
    for i, (b, t) in enumerate(some):
        if b.region or labels[i] == GOOD:
            continue
        if not b.article:
            labels[i] = BAD if labels[i] == BAD else OUTSIDE
        else:
            labels[i] = BAD if b.linked / len(t) > (LINKS_MOST_IN_ARTICLE if wordy[i] else LINKS_MOST) else INSIDE
    return labels


def _around(labels: list[str]) -> list[set[str]]:
    """The nearest decided labels before and after each block."""
    before, after = [], []
    for out, order in ((before, labels), (after, labels[::-1])):
        last = BAD
        for x in order:
            out.append(last)
            last = x if x in (GOOD, BAD) else last
    return [{x, y} for x, y in zip(before, reversed(after), strict=True)]


def _second(labels: list[str], some: list[Block]) -> list[str]:
    """Each ambiguous block by the nearest decided labels before and after it; those inside of articles first, then headings."""
    if INSIDE in labels:
        good = any(x == GOOD and b.article for x, b in zip(labels, some, strict=True))
        labels = [(GOOD if GOOD in n or not good else BAD) if x == INSIDE else x for x, n in zip(labels, _around(labels), strict=True)]
    if not any(x in (GOOD, BAD) for x in labels):  # nothing speaks against any block
        return [GOOD] * len(labels)
    labels = [(GOOD if GOOD in n or GOOD not in labels else BAD) if x == NEAR else x for x, n in zip(labels, _around(labels), strict=True)]
    after = BAD
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] == SHORT and after == GOOD and some[i].home[0] in HEADINGS:
            labels[i] = GOOD
        if labels[i] in (GOOD, BAD):
            after = labels[i]
    for order in (range(1, len(labels)), range(len(labels) - 2, -1, -1)):
        for i in order:
            beside = i - 1 if order.step > 0 else i + 1
            if labels[i] == SHORT and labels[beside] == GOOD and some[i].home == some[beside].home:
                labels[i] = GOOD
    return [(GOOD if n == {GOOD} else BAD) if x in (SHORT, OUTSIDE) else x for x, n in zip(labels, _around(labels), strict=True)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    some = [(b, t) for b in blocks(html) if (t := " ".join("".join(b.parts).split()))]
    labels = _second(_first(some), [b for b, _ in some])
    return "\n".join(t for (_, t), x in zip(some, labels, strict=True) if x == GOOD)


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns, text and n_chars of each row."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h.as_py()) for h in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=[*keys, "text", "n_chars"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "text string, n_chars long"])
    return in_batches(pages.select(*keys, F.col(html).cast("string")), run, schema)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
