"""Main text of web pages from flat text blocks.

A page is cut into a flat row of text blocks, at every tag that starts or ends a block. A block knows its number of
words, its link density (words inside links), the same of its neighbours before and after, whether it is a heading, and
whether it stands inside an element that names itself (by tag, role, class or id) as an article or as something around
one. A decision tree over these numbers, grown from the small labelled table below, says which blocks are main text.

Defined results: null or empty html has no text; text outside any tag is a block like others; elements that never hold
running text (scripts, styles, forms, heads ...) are left out with all they hold; unclosed elements end with the page;
a tag that never ends counts as text, with all that follows; a page of any length is read in time linear in it, however
broken; character references are decoded once; white space inside a block becomes one space; repeated rows are each
worked on; other columns are kept as they are, but for clashes with the output's names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import lean, read

#: What starts a piece of markup: a comment, a CDATA section, a declaration, or a tag's name.
TOKEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: Inside a tag: its end, or the quote that starts a value.
IN_TAG = re.compile(r"(>)|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements whose content is not markup: it ends with their end tag alone.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements that are left out with all they hold.
DROPPED = {"head", "noscript", "template", "svg", "math", "canvas", "object", "select", "button", "form", "video", "audio", "map", "dialog", "datalist"} | RAW
#: Elements that don't end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are kept on the stack: what they say holds for all inside.
CONTAINERS = set("nav header footer aside article main section div ul ol dl table details figure blockquote menu address body".split())
#: Names in classes, ids and roles.
AROUND = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert nav navbar navigation menu breadcrumb breadcrumbs crumbs sidebar side "
    "widget widgets related recommended recommendations trending popular share sharing social comment comments commentlist reply replies respond disqus discussion footer foot bottom header masthead topbar toolbar "
    "newsletter subscribe subscription signup login popup modal overlay pagination pager paging toc copyright legal disclaimer tags tagcloud search form complementary contentinfo dialog meta byline".split()
)
ARTICLE = set("article post entry story content main body text".split())
NAME = re.compile(r"[a-z]+|\d+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    around: bool
    article: bool


def names_of(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    found, hidden = set(), False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            found.update(NAME.findall(value.lower()))
        elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return found, hidden


class Scanner:
    """Finds a page's markup from left to right, in time linear in the page however broken it is."""

    def __init__(self, page: str):
        self.page = page
        #: Once a tag didn't end, quotes hide no > any more: else each < would be followed to the page's end.
        self.quotes = True
        self.closed: dict[str, dict[int, int]] = {}

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at `at`; -1 where none does."""
        page, start = self.page, at
        while self.quotes:
            m = IN_TAG.search(page, at)
            if m is None:
                self.quotes = False
            elif m[1]:
                return m.start()
            else:
                end = page.find(m[2], m.end())
                at = end + 1 if end >= 0 else m.end()
        return page.find(">", start)

    def tokens(self):
        """(start, end, closing, tag, attributes); the tag is None for what is neither text nor a tag. send(place) goes on from there."""
        page, at = self.page, 0
        while (m := TOKEN.search(page, at)) is not None:
            if m[2] is None:
                mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                end = page.find(mark, m.end())
                at = end + len(mark) if end >= 0 else len(page)
                yield m.start(), at, False, None, ""
                continue
            end = self.tag_end(m.end())
            if end < 0:  # no > is left: text from here on
                return
            at = end + 1
            to = yield m.start(), at, bool(m[1]), m[2].lower(), page[m.end() : end]
            if to is not None:
                at = to
                yield

    def skip(self, tag: str, start: int, at: int) -> int:
        """Where the dropped element that starts at `start` ends (its start tag ends at `at`); the page's end where it is not closed, but for a form, which then counts for nothing."""
        page = self.page
        if tag in RAW:
            m = RAW_END[tag].search(page, at)
            return m.end() if m else len(page)
        if tag not in self.closed:  # once for a page and tag: each start's end
            pairs, open_ = self.closed.setdefault(tag, {}), []
            for m in TURN[tag].finditer(page):
                if m[1]:
                    if open_:
                        pairs[open_.pop()] = m.end()
                elif not m[0].endswith("/>"):
                    open_.append(m.start())
        if (end := self.closed[tag].get(start)) is not None:
            return max(end, at)
        if tag == "head" and (m := BODY.search(page, at)):
            return m.start()
        return at if tag == "form" else len(page)


RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
TURN = {tag: re.compile(rf"<(/?){tag}\b[^>]*>", re.I) for tag in DROPPED - RAW}
BODY = re.compile(r"<body\b", re.I)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    #: (tag, around, article) of the open containers.
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    link = 0
    heading = own = False

    def close() -> None:
        nonlocal own, heading
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(html.unescape(t).split()) for t, a in parts if a)
                _, around, article = stack[-1]
                out.append(Block(text, text.count(" ") + 1, linked, heading, around or own, article))
            parts.clear()
        own = heading = False

    scanner, at = Scanner(page), 0
    tokens = scanner.tokens()
    opened: Counter[str] = Counter()
    for start, end, closing, tag, attributes in tokens:
        if start > at:
            parts.append((page[at:start], link > 0))
        at = end
        if tag is None:
            continue
        if tag in DROPPED:
            if not closing and not attributes.endswith("/"):
                at = scanner.skip(tag, start, at)
                tokens.send(at)
                close() if tag not in ("button", "svg", "math", "noscript", "script", "style", "template") else None
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br":
                parts.append((" ", False))
            continue
        close()
        link = 0
        if tag not in CONTAINERS:
            if not closing:
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                if attributes.strip():
                    names, hidden = names_of(attributes)
                    own = hidden or bool(names & AROUND)
            continue
        if closing:
            while opened[tag]:
                name = stack.pop()[0]
                opened[name] -= 1
                if name == tag:
                    break
            continue
        _, around, article = stack[-1]
        names, hidden = names_of(attributes) if attributes.strip() else (set(), False)
        if tag in ("article", "main") or names & ARTICLE and tag != "body" and not names & AROUND:
            article = True
        if tag in ("nav", "aside", "footer", "menu") or hidden or tag == "header" and not article or tag != "body" and names & (AROUND - {"header", "meta"} if article else AROUND):
            around = True
        stack.append((tag, around, article))
        opened[tag] += 1
    if at < len(page):
        parts.append((page[at:], link > 0))
    close()
    return out


#: The classifier's view of a block.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "around", "article")


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(min(1, b.linked / b.words) for b in found), 0])
    flags = np.array([(b.heading, b.around, b.article) for b in found], float).reshape(n, 3)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], flags])


#: The labelled table: the blocks of some pages of different layouts in page order, each as (words, words in links,
#: heading, around, article, main text). Neighbours are what stands beside a block in its page.
NAV, NAV2, MENU, MENU2 = (1, 1, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0), (1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0)
PAGES = [
    # elements say what they are
    [NAV, NAV2, NAV, NAV, (6, 0, 0, 1, 0, 0), (9, 0, 1, 0, 1, 1), (80, 0, 0, 0, 1, 1), (5, 0, 0, 0, 1, 1), (60, 2, 0, 0, 1, 1), (1, 0, 0, 0, 1, 1), (12, 0, 0, 0, 1, 1), (14, 1, 0, 1, 0, 0)],
    [NAV, NAV, (14, 0, 0, 1, 0, 0), (3, 0, 1, 0, 1, 1), (4, 0, 0, 0, 1, 1), (8, 1, 0, 0, 1, 1), (10, 4, 0, 0, 1, 1), (22, 6, 0, 0, 1, 1), (2, 0, 1, 0, 1, 1), (45, 1, 0, 0, 1, 1), (9, 1, 0, 1, 0, 0)],
    [(25, 2, 0, 1, 0, 0), NAV, (11, 0, 1, 0, 1, 1), (7, 0, 0, 0, 1, 1), (6, 0, 0, 1, 1, 0), (33, 3, 0, 0, 1, 1), (50, 0, 0, 1, 1, 0), (70, 0, 0, 0, 1, 1), (3, 0, 1, 1, 0, 0), (65, 1, 0, 1, 0, 0), (30, 0, 0, 1, 0, 0)],
    [NAV2, (8, 0, 1, 0, 1, 1), (120, 6, 0, 0, 1, 1), (4, 4, 0, 0, 1, 0), (3, 3, 0, 0, 1, 0), (5, 5, 0, 0, 1, 0), (7, 7, 0, 0, 1, 0), (12, 0, 0, 1, 1, 0), (40, 0, 0, 1, 1, 0), (5, 1, 0, 1, 0, 0)],
    [(2, 0, 1, 0, 1, 1), (1, 0, 0, 0, 1, 1), (6, 2, 0, 0, 1, 1), (15, 5, 0, 0, 1, 1), (3, 1, 0, 0, 1, 1), (28, 2, 0, 0, 1, 1), (90, 9, 0, 0, 1, 1), (100, 0, 0, 1, 0, 0), (13, 0, 0, 1, 0, 0)],
    # nothing says what it is
    [MENU, MENU2, MENU, MENU, (7, 0, 1, 0, 0, 1), (75, 0, 0, 0, 0, 1), (40, 2, 0, 0, 0, 1), (24, 0, 0, 0, 0, 1), (9, 0, 0, 0, 0, 1), (52, 1, 0, 0, 0, 1), (4, 0, 0, 0, 0, 0), MENU2, MENU, (6, 2, 0, 0, 0, 0)],
    [MENU2, MENU2, (5, 0, 0, 0, 0, 0), (4, 2, 0, 0, 0, 0), (60, 3, 0, 0, 0, 1), (35, 0, 0, 0, 0, 1), (6, 0, 1, 0, 0, 1), (44, 4, 0, 0, 0, 1), (18, 2, 0, 0, 0, 1), (58, 0, 0, 0, 0, 1), (12, 6, 0, 0, 0, 0), (6, 5, 0, 0, 0, 0)],
    [MENU, (3, 0, 1, 0, 0, 0), (20, 13, 0, 0, 0, 0), (30, 21, 0, 0, 0, 0), (25, 18, 0, 0, 0, 0), (9, 8, 0, 0, 0, 0), (10, 0, 1, 0, 0, 1), (85, 0, 0, 0, 0, 1), (30, 3, 0, 0, 0, 1), (48, 0, 0, 0, 0, 1), (7, 7, 0, 0, 0, 0)],
    [MENU, MENU, (2, 0, 1, 0, 0, 0), MENU2, (6, 6, 0, 0, 0, 0), (5, 3, 0, 0, 0, 0), (8, 0, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (7, 4, 0, 0, 0, 0)],
    [MENU, MENU, MENU, (34, 0, 0, 0, 0, 1), (47, 1, 0, 0, 0, 1), (19, 0, 0, 0, 0, 1), MENU2, MENU, MENU2],
    [MENU, MENU2, (22, 0, 0, 0, 0, 1), (16, 0, 0, 0, 0, 1), MENU, MENU, (5, 0, 0, 0, 0, 0)],
    [(95, 0, 0, 0, 0, 1), (110, 4, 0, 0, 0, 1), (38, 1, 0, 0, 0, 1), (15, 0, 0, 0, 0, 1), (72, 2, 0, 0, 0, 1)],
]


def table(pages: list = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    x = [features([Block("", w, n, bool(h), bool(o), bool(a)) for w, n, h, o, a, _ in page]) for page in pages]
    return np.concatenate(x), np.array([b[5] for page in pages for b in page], float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, tree at most, tree above) or a leaf (share of label 1,)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (a, b))
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(t), low
    if best is None:
        return (share,)
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    """For each row, whether the tree says 1."""
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    f, t, low, high = tree
    at = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[at], out[~at] = decide(low, x[at]), decide(high, x[~at])
    return out


def trained(pages: list = PAGES) -> tuple:
    return grow(*table(pages))


def main_text(page: str, tree: tuple) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, decide(tree, features(found)), strict=True) if keep)


def extractor(tree: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", tree) for h in batch.column(batch.schema.get_field_index("html"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def extract(pages: DataFrame, labelled: list = PAGES) -> DataFrame:
    """pages with the main text of their html."""
    pages = pages.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(lean(extractor(trained(labelled))), f"{fields}, text string")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
