"""Main text of HTML pages.

Events of the standard library's streaming parser build the lines (blocks) of a page. Each line has a
text-to-tag ratio; a Gaussian smooths the ratios, and a threshold clusters lines into content and rest. The clusters choose the region:
the article and main elements that hold one, as a whole, since short lines of an article belong to it; where a page has neither, the
innermost element that holds the clusters of a quarter of the largest one's text or more, or, if that is the page itself, the lines from the first to the last of
them, with the headings right before.

Navigation, headers, footers, asides, forms, scripts, styles and templates never take part, by their element or role. An element whose class or
id names such a part, an advert, a notice or reader comments as a whole ("site-footer", not "with-sidebar") is passed over too, unless the page's
only article or main lies inside it. A header within an article belongs to it. An end tag closes what is open inside its element; a part without an
end tag also ends where an article or main begins, and a menu or header at the first paragraph beside its list.

Defined cases: a null or empty page, or one without text, gives an empty text. Rows repeat as they came.
Null ids stay. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol"
    " optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_DROP = frozenset("script style template iframe select button textarea head nav footer aside form menu title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_REGION = frozenset("article main".split())
#: Elements of a line or a few, which hold no content as a whole.
_LINES = _HEADINGS | frozenset("p li dt dd pre tr td th caption figcaption summary".split())
#: Parts that end at a paragraph or heading beside their list if no end tag closes them.
_SHORT = frozenset("nav menu header".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus"
    " respond replies pagination pager skip copyright".split()
)
#: Words that may stand beside one of _NAMES in the name of such a part.
_BESIDE = frozenset(
    "site page main left right top bottom list lists box block area section wrapper wrap container bar widget widgets link links item items panel inner outer slot unit primary secondary global header form post"
    " user reader article blog entry thread policy message text image buttons button icons media posts stories tree trail body row col column".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def names_part(name: str, header: bool) -> bool:
    """Whether a class or id is, as a whole, the name of a part that is no content; header: whether one of a header counts."""
    words = [w.lower() for w in _WORDS.findall(name)]
    named = any(w in _NAMES or header and w == "header" for w in words)
    return named and all(w in _NAMES or w in _BESIDE for w in words)


class _Events(HTMLParser):
    """The events of a page, and which start tags have an end tag of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, list]] = []
        self.open: dict[str, list[int]] = {}
        self.closed: set[int] = set()

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK and tag not in _VOID:
            self.open.setdefault(tag, []).append(len(self.events))
        self.events.append(("start", tag, attrs))

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self.closed.add(self.open[tag].pop())
        self.events.append(("end", tag, []))

    def handle_data(self, data):
        self.events.append(("data", data, []))


class _Element:
    __slots__ = ("tag", "key", "dropped", "named", "region", "closed")

    def __init__(self, tag: str, key: int, dropped: bool, named: bool, region: int, closed: bool):
        self.tag, self.key, self.dropped, self.named, self.region, self.closed = tag, key, dropped, named, region, closed


class Block:
    """A line of a page: its text, the tags since the line before, the elements that hold it, its region (0: none), and whether a named part holds it."""

    __slots__ = ("text", "tags", "path", "region", "named", "heading")

    def __init__(self, text: str, tags: int, path: tuple, region: int, named: bool, heading: bool):
        self.text, self.tags, self.path, self.region, self.named, self.heading = text, tags, path, region, named, heading


class _Blocks:
    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.drop = self.named = self.region = self.regions = self.tags = 0
        self.heading = False
        self.buf: list[str] = []
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if self.buf:
            text = _SPACE.sub(" ", "".join(self.buf)).strip()
            if text:  # what stands in dropped elements never comes here
                self.blocks.append(Block(text, self.tags, tuple(x.key for x in self.stack if x.tag not in _LINES), self.region, self.named > 0, self.heading))
                self.tags = 0
            self.buf = []

    def push(self, tag: str, key: int, dropped: bool, named: bool, closed: bool) -> None:
        self.stack.append(_Element(tag, key, dropped, named, self.region, closed))
        self.drop += dropped
        self.named += named

    def cut(self, k: int) -> None:
        """Closes the elements from k on."""
        for x in reversed(self.stack[k:]):
            self.drop -= x.dropped
            self.named -= x.named
            self.region = x.region
        del self.stack[k:]

    def start(self, tag: str, attrs: list, key: int, closed: bool) -> None:
        self.tags += 1
        if tag not in _BLOCK:
            if tag in _DROP:
                self.push(tag, key, True, False, True)
            return
        self.flush()
        if tag in _VOID:
            return
        if self.stack and self.stack[-1].tag == "p":
            self.cut(len(self.stack) - 1)
        role = next((v.lower() for n, v in attrs if n == "role" and v), "")
        region = tag in _REGION or role in _REGION
        if region and (self.drop or self.named):  # an unclosed part does not hold the article
            k = next((k for k, x in enumerate(self.stack) if (x.dropped or x.named) and not x.closed and x.tag not in _REGION), None)
            if k is not None:
                self.cut(k)
        elif (tag == "p" or tag in _HEADINGS) and self.drop and not self.stack[-1].closed and self.stack[-1].tag in _SHORT and not (tag in _HEADINGS and self.stack[-1].tag == "header"):
            self.cut(len(self.stack) - 1)
        outside = not self.region
        dropped = tag in _DROP or role in _ROLES or (tag == "header" and outside)
        named = tag not in ("html", "body") and any(names_part(c, outside) for n, v in attrs if n in ("class", "id") and v for c in v.split())
        self.heading = tag in _HEADINGS
        if tag in _HEADINGS and not dropped and not named:
            return
        self.push(tag, key, dropped, named, closed)
        if region and not self.drop and (outside or self.stack[-2].region == 0 or tag == "article" and self.inside_main()):
            self.regions += 1
            self.region = self.regions

    def inside_main(self) -> bool:
        """Whether no article is open, but a main."""
        return not any(x.tag == "article" for x in self.stack[:-1])

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
            self.heading = False
        elif tag not in _DROP:
            return
        if tag in _VOID:
            return
        k = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag == tag), None)
        if k is not None:
            self.cut(k)


def blocks_of(html: str) -> list[Block]:
    """The lines of a page without those of dropped elements."""
    page, out = _Events(), _Blocks()
    page.feed(html)
    page.close()
    for k, (kind, x, attrs) in enumerate(page.events):
        if kind == "data":
            if not out.drop:
                out.buf.append(x)
        elif kind == "start":
            out.start(x, attrs, k, k in page.closed)
        else:
            out.end(x)
    out.flush()
    return out.blocks


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(math.ceil(2 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), "valid")


def content_lines(blocks: list[Block], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have a smoothed text-to-tag ratio over the page's threshold, and which also by themselves."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in blocks])
    smooth = _smooth(ratio, sigma)
    level = min(0.5 * float(smooth.std()) + 0.25 * float(smooth.mean()), float(smooth.max()))
    return smooth >= level, (smooth >= level) & (ratio >= level)


def clusters(blocks: list[Block], content: np.ndarray, dense: np.ndarray) -> list[tuple[int, int]]:
    """First and last line + 1 of the runs of content lines that have a quarter of the largest one's text or more, each from a dense line to one, as smoothing lifts what stands beside."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], content, [False]))))
    runs = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        own = s + np.flatnonzero(dense[s:e])
        if len(own):
            runs.append((int(own[0]), int(own[-1]) + 1))
    mass = [sum(len(x.text) for x in blocks[s:e]) for s, e in runs]
    return [r for r, m in zip(runs, mass, strict=True) if 4 * m >= max(mass)] or [(0, len(blocks))]


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page: its blocks in page order, joined by a newline."""
    if not html:
        return ""
    every = blocks_of(html)
    blocks = [x for x in every if not x.named]
    if not any(x.region for x in blocks) and any(x.region for x in every):
        blocks = [x for x in every if x.region or not x.named]  # the only article lies in a named part
    if not blocks:
        return ""
    content, dense = content_lines(blocks, sigma)
    regions = {x.region for x, c in zip(blocks, content.tolist(), strict=True) if x.region and c}
    if regions:
        return "\n".join(x.text for x in blocks if x.region in regions)
    runs = clusters(blocks, content, dense)
    first, last = runs[0][0], runs[-1][1]
    paths = [x.path for s, e in runs for x in blocks[s:e]]
    depth = 0
    while depth < min(map(len, paths)) and len({p[depth] for p in paths}) == 1:
        depth += 1
    holder = paths[0][:depth]
    inside = [x for x in blocks if x.path[:depth] == holder]
    if depth and len(inside) < len(blocks):
        return "\n".join(x.text for x in inside)
    while first and blocks[first - 1].heading:
        first -= 1
    return "\n".join(x.text for x in blocks[first:last])


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = 1.0) -> DataFrame:
    """keep columns, text (main text) and n_chars (its code points) for every row of pages."""
    common.bound_batches(pages.sparkSession)
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*named, F.col(html).alias("_html"))

    def run(batches):
        for batch in batches:
            text = [extract(h, sigma) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*batch.schema.names[:-1], "_text", "_n"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(common.lean(run), f"{types}, _text string, _n long")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
