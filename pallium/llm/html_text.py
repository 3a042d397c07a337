"""Main text of web pages (operator 8).

A page becomes a flat list of text blocks. Each block is described by its word
count and link density, those of the blocks before and after it, and where it
stands (in the article and how much of the page the article holds, in an
element of boilerplate, in a part with a name of boilerplate and how much of
the page that part holds, a heading).
A decision tree, trained here on the small labelled table below, keeps or
drops it. Parsing is two passes over the page's tags, in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import column_of

#: Quotes count after an equals sign; one without a partner is a character like others.
_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|[!?/][^>]*>)""", re.S)
_UNFINISHED = re.compile("<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PARTS = re.compile("[0-9a-z]+")

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that begin and end blocks and whose nesting is followed.
NESTING = {"address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
           "figcaption", "figure", "footer", "form", "header", "html", "li", "main", "nav", "ol", "section", "summary", "table",
           "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BLOCKS = NESTING | HEADINGS | {"center", "hr", "legend", "p", "pre"}
#: Elements without text of the page; what stands in them is skipped.
SKIPPED = {"audio", "button", "canvas", "datalist", "iframe", "math", "noscript", "object", "option", "script", "select", "style", "svg",
           "template", "textarea", "title", "video"}
#: Those whose content is raw text: without an end tag they run to the end of the page.
RAW = {"script", "style", "textarea", "title"}
#: Boilerplate by element or role; words of class or id that hint at it, which the tree weighs.
BOILERPLATE = {"aside", "dialog", "footer", "form", "header", "menu", "nav"}
ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "menu", "navigation", "search", "toolbar"}
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie "
    "cookies copyright dialog footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split())
#: Such words in a name say what its part is, unless the part holds the article or most of the page.
SAYING = frozenset(
    "ad ads advert advertisement adverts comment commentlist comments consent cookie cookies disqus gdpr newsletter notice "
    "notices promo promotion replies respond responses sidebar sponsor sponsored subscribe".split())
#: Comments of readers, if they are a whole name (but for numbers); in a longer name, a hint.
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond responses".split())
#: Elements that hold the page or its article, whatever their class says.
HOLDERS = {"html", "body", "main", "article"}
#: Besides <article>, <main> and role=main, these whole names mark the article.
MAIN_NAMES = {"main", "main-content", "main_content", "maincontent"}
#: Kinds of boilerplate: a header of the article, whose headings are main text; any other.
TITLE, DROPPED = 1, 2
#: An article with this share of the page's unlinked words is one, whatever the names around it.
ARTICLE_SHARE = 0.2
#: Named parts and marks weigh fully from this share on; small linked articles beside a weak mark are cards.
MOST, CARD_LINKS = 0.5, 0.1


@dataclass
class Block:
    text: str
    words: int
    linked: int
    region: int
    boilerplate: int
    heading: bool
    part: int
    named: bool = False
    said: bool = False
    share: float = 1.0
    place: int = 0
    mark: float = 0.0

    @property
    def dropped(self) -> bool:
        return self.boilerplate == DROPPED or self.boilerplate == TITLE and not self.heading


@dataclass
class Entry:
    """An open element: outermost marked region (-1: none), kind of
    boilerplate, innermost part with a name of boilerplate (-1: none), the
    same for headings."""

    name: str = ""
    region: int = -1
    boilerplate: int = 0
    part: int = -1
    heading_part: int = -1


@dataclass
class Part:
    """A part with a name of boilerplate, or an article in one; whether the
    name says what it is."""

    parent: int
    article: bool
    said: bool = False
    words: int = 0


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; white space within is one space."""
    blocks: list[Block] = []
    stack: list[Entry] = []
    parts: list[Part] = []
    regions = 0
    depth: Counter[str] = Counter()
    text: list[tuple[str, bool]] = []
    anchors = heading = False
    # No tag ends after the last '>': what follows is text up to an unfinished tag.
    at, end = 0, page.rfind(">") + 1
    unfinished = _UNFINISHED.search(page, end)
    tail = page[end:unfinished.start()] if unfinished else page[end:]

    def flush() -> None:
        nonlocal text
        if not text:
            return
        whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
        if whole:
            linked = sum(len(html.unescape(t).split()) for t, a in text if a)
            in_ = stack[-1] if stack else Entry()
            words = whole.count(" ") + 1 if any(map(str.isalnum, whole)) else 0
            blocks.append(Block(whole, words, min(linked, words), in_.region, in_.boilerplate, heading,
                                in_.heading_part if heading else in_.part))
        text = []

    tags, open_end = _tags(page, end)
    if open_end:
        tail = ""
    ends = _skipped_to(tags)
    i = 0
    while i < len(tags):
        begin, after, closing, name, rest = tags[i]
        if begin > at:
            text.append((page[at:begin], anchors))
        at = after
        if name == "a":
            anchors = not closing
        elif name == "br":
            text.append((" ", anchors))
        elif name in SKIPPED:
            if i in ends:
                i = ends[i]
                at = tags[i][1]
            elif name == "option" and not closing:  # its end tag may be left out
                at = tags[i + 1][0] if i + 1 < len(tags) else end
        elif name in BLOCKS or name in BOILERPLATE:
            flush()
            heading = name in HEADINGS and not closing
            if name in NESTING or name in BOILERPLATE:
                anchors = False
                if not closing:
                    stack.append(_entered(name, rest, stack[-1] if stack else Entry(), parts, regions))
                    regions = max(regions, stack[-1].region + 1)
                    depth[name] += 1
                elif depth[name]:
                    while True:
                        left = stack.pop().name
                        depth[left] -= 1
                        if left == name:
                            break
        i += 1
    if at < end and not open_end:
        text.append((page[at:end], anchors))
    text.append((tail, anchors))
    flush()
    _weigh(blocks, parts)
    _mark(blocks, regions)
    return blocks


def _tags(page: str, end: int) -> tuple[list[tuple[int, int, bool, str, str]], bool]:
    """The page's tags and comments (without a name) in order: where they
    begin and end, whether end tags, name, rest. Raw text holds none; whether
    one is left open, which ends the page."""
    tags, at = [], 0
    while at < end:
        tag = _TAG.search(page, at, end)
        if tag is None:
            break
        at = tag.end()
        closing, name, rest = bool(tag.group(1)), (tag.group(2) or "").lower(), tag.group(3) or ""
        tags.append((tag.start(), at, closing, name, rest))
        if name in RAW and not closing and not rest.endswith("/"):
            stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            if stop is None:
                return tags, True
            at = stop.end()
            tags.append((stop.start(), at, True, name, ""))
    return tags, False


def _skipped_to(tags: list[tuple[int, int, bool, str, str]]) -> dict[int, int]:
    """The end tag of each start tag of a skipped element; one that is still
    open where an element around it ends, or the page, has none."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth: Counter[str] = Counter()
    for i, (_, _, closing, name, rest) in enumerate(tags):
        if name not in SKIPPED and name not in NESTING and name not in BOILERPLATE:
            continue
        if not closing:
            if name not in SKIPPED or not rest.endswith("/"):
                stack.append((name, i))
                depth[name] += 1
        elif depth[name]:
            while True:
                left, start = stack.pop()
                depth[left] -= 1
                if left == name:
                    break
            if name in SKIPPED:
                ends[start] = i
    return ends


def _attributes(rest: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    return found


def _entered(name: str, rest: str, outer: Entry, parts: list[Part], regions: int) -> Entry:
    attributes = _attributes(rest)
    roles, words, comments = set(attributes.get("role", "").lower().split()), set(), False
    main = name in ("article", "main") or "main" in roles
    for kind in ("class", "id", "role"):
        for one in attributes.get(kind, "").lower().split():
            found = _PARTS.findall(one)
            words.update(found)
            main = main or one in MAIN_NAMES
            whole = [w for w in found if not w.isdigit()]
            comments = comments or len(whole) == 1 and whole[0] in COMMENT_WORDS
    hidden = ("hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
              or _NOT_SHOWN.search(attributes.get("style", "")) is not None)
    level = 0
    if name in BOILERPLATE or name not in HOLDERS and roles & ROLES or comments and name not in ("html", "body") or hidden:
        level = TITLE if name == "header" and outer.region >= 0 and not comments and not hidden else DROPPED
    part, heading_part = outer.part, outer.heading_part
    hints = words & (BOILERPLATE_WORDS | COMMENT_WORDS) if name not in HOLDERS else set()
    if hints or name in ("article", "main") and part >= 0:
        parts.append(Part(part, not hints, bool(hints & SAYING)))
        part = len(parts) - 1
        if hints != {"header"} or outer.region < 0:
            heading_part = part
    region = regions if main and outer.region < 0 and name not in ("html", "body") else outer.region
    return Entry(name, region, max(level, outer.boilerplate), part, heading_part)


def _weigh(blocks: list[Block], parts: list[Part]) -> None:
    """Whether each block is in a named part, and the share of the page's
    unlinked words which that part holds."""
    page = 0
    for b in blocks:
        if not b.dropped:
            page += b.words - b.linked
            if b.part >= 0:
                parts[b.part].words += b.words - b.linked
    for p in reversed(parts):
        if p.parent >= 0:
            parts[p.parent].words += p.words
    weighed: list[tuple[bool, bool, float]] = []
    for p in parts:
        share = p.words / page if page else 1.0
        outer = weighed[p.parent] if p.parent >= 0 else (False, False, 1.0)
        if p.article:
            weighed.append((False, False, 1.0) if share >= ARTICLE_SHARE and not outer[1] else outer)
        else:
            # What is in a part that says so is of it, whatever its own name.
            weighed.append((True, outer[1] or p.said and share < MOST, share))
    for b in blocks:
        if b.part >= 0:
            b.named, b.said, b.share = weighed[b.part]


def _mark(blocks: list[Block], regions: int) -> None:
    """Place of each block: 1 in the article, -1 outside it, 0 if the page marks
    none; and the share of the page's unlinked words which the marked regions
    hold. If they hold the lesser part, a small one is not the article."""
    if not any(b.region >= 0 and not b.boilerplate for b in blocks):
        return
    own, linked, page = [0] * regions, [0] * regions, 0
    for b in blocks:
        if not b.dropped and not b.said and not (b.named and b.share < MOST):
            page += b.words - b.linked
            if b.region >= 0:
                own[b.region] += b.words - b.linked
                linked[b.region] += b.linked
    mark = sum(own) / page if page else 1.0
    for b in blocks:
        b.mark, b.place = mark, 1 if b.region >= 0 else -1
        if b.region >= 0 and mark < MOST and own[b.region] < ARTICLE_SHARE * page:
            b.place = -1
            if not b.named and linked[b.region] > CARD_LINKS * (own[b.region] + linked[b.region]):
                b.named, b.share = True, own[b.region] / page


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "boilerplate", "heading",
            "share", "mark")


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block. ``place``: 1 in the article, -1 outside it, 0 if the
    page marks none; the marked regions have ``mark`` of the page's unlinked
    words. ``boilerplate``: 2 in such an element or a small part whose name
    says so, 1 in a part with a name that hints at it or a card, which has
    ``share`` of them."""
    own = [(b.words, b.linked / b.words if b.words else 0.0) for b in blocks]
    rows = []
    for i, b in enumerate(blocks):
        before, after = own[i - 1] if i else (0, 0.0), own[i + 1] if i + 1 < len(own) else (0, 0.0)
        rows.append([*own[i], *before, *after, b.place, 2 if b.dropped or b.said else int(b.named), b.heading, b.share, b.mark])
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


ANY_SIZE, SHORT, LONG = (0, 1, 4, 12, 16, 40, 60, 150), (1, 4, 12), (16, 40, 150)
NOTICE, PROSE = (1, 4, 12, 16, 40), (60, 150)
ANY_DENSITY, ENDS = (0.0, 0.2, 0.7, 1.0), (0.0, 1.0)
EDGE, SOME, NONE = (0, 2, 40), (0.0, 0.7, 1.0), (0.0,)
#: Place and mark: in the article, on a page that marks none, outside of an article that holds most, beside a weak mark.
IN, UNMARKED, OUTSIDE, BESIDE = ((1, 0.1), (1, 1.0)), ((0, 0.0),), ((-1, 0.6), (-1, 1.0)), ((-1, 0.0), (-1, 0.1), (-1, 0.4))
FREE, ANYWHERE = UNMARKED + BESIDE, IN + UNMARKED + OUTSIDE + BESIDE
# The labelled parts of pages, made by hand: what the part is; its words and
# link densities; words before, words after and density of the neighbours;
# place, boilerplate, heading; 1 for main text. A part without a name of
# boilerplate is labelled the same with one that holds most of the page.
PARTS = (
    ("paragraph or line of an article", ANY_SIZE, ANY_DENSITY, EDGE, EDGE, ENDS, IN, 0, 0, 1),
    ("title of an article", SHORT, ANY_DENSITY, EDGE, EDGE, ENDS, IN, 0, 1, 1),
    ("element of boilerplate", ANY_SIZE, ANY_DENSITY, EDGE, EDGE, ENDS, ANYWHERE, 2, 0, 0),
    ("heading of an element of boilerplate", SHORT, ANY_DENSITY, EDGE, EDGE, ENDS, ANYWHERE, 2, 1, 0),
    ("notice, label or line of a small named part", NOTICE, ANY_DENSITY, EDGE, EDGE, ENDS, ANYWHERE, 1, 0, 0),
    ("heading of a small named part", SHORT, ANY_DENSITY, EDGE, EDGE, ENDS, ANYWHERE, 1, 1, 0),
    ("links of a small named part", PROSE, (0.7, 1.0), EDGE, EDGE, ENDS, ANYWHERE, 1, 0, 0),
    ("prose of a small named part", PROSE, (0.0, 0.2), EDGE, EDGE, ENDS, IN + FREE, 1, 0, 1),
    ("prose of a small named part outside of the article", PROSE, (0.0, 0.2), EDGE, EDGE, ENDS, OUTSIDE, 1, 0, 0),
    ("outside of the article", ANY_SIZE, ANY_DENSITY, EDGE, EDGE, ENDS, OUTSIDE, 0, 0, 0),
    ("heading outside of the article", SHORT, ANY_DENSITY, EDGE, EDGE, ENDS, OUTSIDE, 0, 1, 0),
    ("paragraph of an unmarked page or beside a weak mark", LONG, (0.0, 0.2), EDGE, EDGE, SOME, FREE, 0, 0, 1),
    ("short line beside unlinked text", SHORT, (0.0, 0.2), EDGE, EDGE, NONE, FREE, 0, 0, 1),
    ("short line after a paragraph, before links", SHORT, (0.0, 0.2), (20, 60), EDGE, (0.2,), FREE, 0, 0, 1),
    ("heading before a paragraph", SHORT, NONE, EDGE, (20, 60), SOME, FREE, 0, 1, 1),
    ("heading before short lines", SHORT, NONE, EDGE, (1, 2, 12), NONE, FREE, 0, 1, 1),
    ("signs without a word", (0,), NONE, EDGE, EDGE, SOME, FREE, 0, 0, 0),
    ("menu of an unmarked page", SHORT, (0.7, 1.0), EDGE, EDGE, SOME, FREE, 0, 0, 0),
    ("list of teasers", LONG, (0.7, 1.0), EDGE, EDGE, SOME, FREE, 0, 0, 0),
    ("label among menus", SHORT, NONE, EDGE, EDGE, (0.7, 1.0), FREE, 0, 0, 0),
    ("heading of a menu", SHORT, NONE, EDGE, (1, 2), (0.7, 1.0), FREE, 0, 1, 0),
)
#: Boilerplate and share: of its elements; of named parts, small; of parts without such a name, and named ones that hold most.
SHARES = {2: ((2, 0.0), (2, 1.0)), 1: ((1, 0.0), (1, 0.1), (1, 0.4)), 0: ((0, 1.0), (1, 0.6), (1, 1.0))}
LABELLED = np.array([
    [words, density, before, linked, after, linked, place, named, heading, share, mark, label]
    for _, sizes, densities, befores, afters, links, places, boilerplate, heading, label in PARTS
    for words in sizes for density in densities for before in befores for after in afters for linked in links
    for place, mark in places for named, share in SHARES[boilerplate]
], dtype=float)


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    below: Node | None = None
    above: Node | None = None
    main: bool = False


def grow(x: np.ndarray, y: np.ndarray, least: int = 1) -> Node:
    """A binary tree by the best drop in Gini impurity; ties go to the earlier
    feature and the lower limit."""
    node = Node(main=bool(y.mean() >= 0.5))
    if len(set(y.tolist())) < 2:
        return node
    best = 1e-9
    impurity = 2 * len(y) * y.mean() * (1 - y.mean())
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            under = x[:, feature] < limit
            if min(under.sum(), (~under).sum()) < least:
                continue
            rest = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[under], y[~under]))
            if impurity - rest > best + 1e-9:
                best, node.feature, node.limit = impurity - rest, feature, float(limit)
    if node.feature >= 0:
        under = x[:, node.feature] < node.limit
        node.below, node.above = grow(x[under], y[under], least), grow(x[~under], y[~under], least)
    return node


def decide(node: Node, row: np.ndarray) -> bool:
    while node.feature >= 0:
        node = node.below if row[node.feature] < node.limit else node.above
    return node.main


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(LABELLED[:, :-1], LABELLED[:, -1])


def main_text(page: str) -> str:
    """The blocks that the tree keeps, in page order, joined by line ends."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if decide(tree(), row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row.

    A null or empty page, or one without main text, has an empty text; null
    ids and urls and repeated rows are kept. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(p) for p in column_of(batch, "html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))
