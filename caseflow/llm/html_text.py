"""Main text of web pages: flat text blocks, features of a block and its neighbours, a small decision tree.

A page is cut into blocks at block-level tags; scripts, styles, templates, the page's title and comments in the markup never
become text. A block's features are its words, link density and words a line, those of the blocks before and after it,
and where it stands: outside the article or main element that the page has, in an element for page furniture (nav, aside, footer, form and the
like), in a heading or list item, whether the page has an article at all, and its group (the list of an item, the division of a line):
the unlinked words of the group, their share of the page, its link density, its blocks, and the words elsewhere. Names of classes are one feature: the
share of the page's words that the innermost element with a name of page furniture holds, 1 where there is none, so the
name of a wrapper of the whole page says nothing. A decision tree, grown by Gini impurity on the labelled pages of
html_pages, keeps or drops a block. Kept blocks are joined in page order by one line feed.

Edge cases: null html is an empty page; unclosed and stray tags, unclosed comments and pages that end inside a tag
are read as far as they go; white space, hard spaces included, becomes one space; hidden elements are text like others;
where the tree keeps nothing, all blocks are kept that are neither in furniture
nor whole links, so only pages of furniture have an empty text; pages of any length and depth are read in one pass; other columns are
ignored; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import short_batches
from .html_pages import PAGES, fill

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<(?=[a-zA-Z])[^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

RAW = frozenset("script style noscript template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu button select option textarea dialog fieldset legend head".split())
#: Names of page furniture, and first parts of names that say something else of it ("no-comments", "has-sidebar").
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted recommended related replies reply "
    "respond share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar topbar widget complementary contentinfo search discussion".split()
)
MODIFIERS = frozenset("no not non without has have with is".split())
TEXT_NAMES = frozenset("article body content entry main page post story text".split())
TEXT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What an open p ends at: its own kind and block-level tags; an li ends at the next li.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
ROWS = frozenset("li dt dd tr td th tbody thead tfoot".split())
LINE = 80  # characters of a line, for words a line

FEATURES = (
    "words", "link_density", "line_words", "words_before", "link_density_before", "line_words_before", "words_after", "link_density_after", "line_words_after",
    "outside_text", "furniture", "heading", "item", "named_share", "page_has_text",
    "group_words", "group_share", "group_links", "group_blocks", "rest_words",
)


def _named(attributes: str) -> bool:
    """Whether a class, id or role names page furniture."""
    for k, v in _ATTRIBUTE.findall(attributes):
        if k.lower() in ("class", "id", "role"):
            for name in v.strip("\"'").split():
                parts = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
                if parts[0] in MODIFIERS or not TEXT_NAMES.isdisjoint(parts) and "header" in parts:
                    continue
                if not FURNITURE_WORDS.isdisjoint(parts):
                    return True
    return False


class _Element:
    """What an open element passes on to those inside it."""

    __slots__ = ("tag", "up", "text", "furniture", "heading", "item", "link", "box", "main")

    def __init__(self, tag: str, parent: _Element | None):
        self.tag, self.up = tag, parent
        for k in self.__slots__[2:]:
            setattr(self, k, getattr(parent, k) if parent else (-1 if k == "box" else False))


class Block:
    """A text block; `main` is its label on a labelled page. `group` is the element around the one that holds it, rows and items
    skipped: the list of an item, the division of a paragraph or line."""

    __slots__ = ("text", "words", "linked", "within", "group")

    def __init__(self, text: str, linked: int, within: _Element):
        self.text, self.words, self.linked, self.within = text, text.count(" ") + 1, linked, within
        own = within
        while own.up is not None and own.tag not in BLOCKS:
            own = own.up
        group = own.up
        while group is not None and (group.tag in ROWS or group.tag not in BLOCKS):
            group = group.up
        self.group = group


class _Page:
    """Blocks of a page, gathered from its tokens."""

    def __init__(self):
        self.stack: list[_Element] = []
        self.open_tags: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.boxes: list[list[int]] = []  # of each element named as furniture: the one around it, and its words
        self.outside = _Element("", None)

    @property
    def top(self) -> _Element:
        return self.stack[-1] if self.stack else self.outside

    def say(self, part: str):
        self.parts.append(part)
        if self.top.link:
            self.linked.append(part)

    def end_block(self):
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            block = Block(text, len(html.unescape(" ".join(self.linked)).split()), self.top)
            self.blocks.append(block)
            if block.within.box >= 0:
                self.boxes[block.within.box][1] += block.words
        self.parts, self.linked = [], []

    def open(self, tag: str, attributes: str):
        e = _Element(tag, self.stack[-1] if self.stack else None)
        named = _named(attributes) if attributes.strip() else False
        if tag in TEXT_TAGS:
            e.text, e.furniture = True, False
        elif tag in FURNITURE_TAGS and not (tag == "header" and e.text and not e.furniture):  # the head of an article is its own
            e.furniture = True
        e.heading |= tag in HEADINGS
        e.item |= tag == "li"
        e.link |= tag == "a"
        e.main |= "data-main" in attributes
        if named and tag not in ("html", "body"):
            self.boxes.append([e.box, 0])
            e.box = len(self.boxes) - 1
        self.stack.append(e)
        self.open_tags[tag] += 1

    def pop(self):
        self.open_tags[self.stack.pop().tag] -= 1

    def close(self, tag: str):
        while self.open_tags[tag]:
            last = self.stack[-1].tag
            self.pop()
            if last == tag:
                return


def read(source: str) -> _Page:
    page, at, end = _Page(), 0, len(source)
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            page.say(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                page.end_block()
                page.close(tag)
            elif tag == "br":
                page.parts.append(" ")
            else:
                page.close(tag)
        elif tag in RAW:
            if not m[3].endswith("/"):
                # nothing inside counts, tags in scripts included
                found = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = found.end() if found else end
        else:
            if tag in BLOCKS:
                page.end_block()
                # inline elements do not reach over a block
                while page.stack and page.stack[-1].tag not in BLOCKS:
                    page.pop()
                if page.stack and (page.stack[-1].tag == "p" or page.stack[-1].tag in HEADINGS):
                    page.pop()
                if tag in IMPLIED and page.stack and page.stack[-1].tag in IMPLIED[tag]:
                    page.pop()
            if tag in VOID or m[3].endswith("/"):
                if tag == "br":
                    page.parts.append(" ")
            else:
                page.open(tag, m[3])
    if at < end:
        page.say(source[at:])
    page.end_block()
    for around, words in reversed(page.boxes):
        if around >= 0:
            page.boxes[around][1] += words
    return page


def features(page: _Page) -> list[tuple]:
    """FEATURES of each block of a page."""
    some = float(any(b.within.text and not b.within.furniture for b in page.blocks))
    total = sum(b.words for b in page.blocks)
    flat = [(b.words, b.linked / b.words, b.words / math.ceil(len(b.text) / LINE)) for b in page.blocks]
    none = (0, 0.0, 0.0)
    out = []
    groups: dict[int, list[int]] = {}  # of each group: unlinked words, all words, blocks
    plain = 0
    for b in page.blocks:
        if not b.within.furniture:
            g = groups.setdefault(id(b.group), [0, 0, 0])
            g[0], g[1], g[2] = g[0] + b.words - b.linked, g[1] + b.words, g[2] + 1
            plain += b.words - b.linked
    for k, b in enumerate(page.blocks):
        w = b.within
        share = page.boxes[w.box][1] / total if w.box >= 0 else 1.0
        g = groups.get(id(b.group), (0, 1, 0)) if not w.furniture else (0, 1, 0)
        group = (g[0], g[0] / plain if plain else 0.0, 1 - g[0] / g[1], g[2], plain - g[0])
        out.append((*flat[k], *(flat[k - 1] if k else none), *(flat[k + 1] if k + 1 < len(flat) else none), some and not w.text, w.furniture, w.heading, w.item, share, some, *group))
    return out


def grow(table: np.ndarray, depth: int = 8):
    """A tree of (feature, threshold, tree below, tree above) over rows with a label at their end; leaves are labels."""
    x, y = table[:, :-1], table[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < t
            p, q = y[low].mean(), y[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, low = best
    return f, t, grow(table[low], depth - 1), grow(table[~low], depth - 1)


def labelled(text: bool, pages=PAGES, turns: int = 3) -> np.ndarray:
    """Rows of features and label of all blocks of labelled pages, with several fillings, of those with an article or without."""
    rows = []
    for k, p in enumerate(pages):
        for turn in range(turns):
            page = read(fill(p, 10 * k + turn))
            rows += [(*x, b.within.main) for x, b in zip(features(page), page.blocks, strict=True)]
    table = np.array(rows, float)
    return table[table[:, HAS_TEXT] == text]


HAS_TEXT = FEATURES.index("page_has_text")
#: Pages with an article element and pages without have a tree each.
TREES = {text: grow(labelled(text)) for text in (True, False)}


def judge(x: tuple, trees=TREES) -> int:
    tree = trees[bool(x[HAS_TEXT])]
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if x[f] < t else high
    return tree


def main_text(source: str) -> str:
    page = read(source)
    kept = [b.text for x, b in zip(features(page), page.blocks, strict=True) if judge(x)]
    if not kept:  # a page says something unless all of it is furniture or links
        kept = [b.text for b in page.blocks if not b.within.furniture and b.within.box < 0 and b.linked < b.words]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    short_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")

    def run(batches):
        for b in batches:
            texts = [main_text(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
