"""Main text of HTML pages by ratios of their tag paths.

A page is read as blocks of text, each under the path of block elements from the
root to it. Per path, the text outside links and its punctuation are summed up
and divided by the number of its blocks. Both ratios are smoothed with those of
the containers above (the next two and the landmark), halving with each, and fused as
their product. A path is content where the fused ratio reaches THRESHOLD of the page's highest
one; text inside `article` or `main` counts LANDMARK times for that, and where a
page has such text, nothing outside it is content. Elements that are never
part of an article (menus, forms, scripts, what class, id or role names as
advert, notice, comment, sidebar and so on) are left out before.

Text follows HTML: character references are decoded, blocks that a start tag
closes are closed, an end tag without a start means nothing, raw text elements end
at their end tag only, and what is cut off at the end of the page still counts.
White space inside a block (line breaks too) becomes one space; blocks are
joined by one space.

Defined cases: null html is empty, and a page without content has an empty text; rows with
null or repeated ids are pages of their own; other columns are ignored. A task
holds a slice of pages or one page, some ten bytes per byte of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.text import slices

THRESHOLD, LANDMARK, LEVELS = 0.05, 100.0, 3
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|</?[a-zA-Z][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…؟،、。！，：；？]")

# Elements of HTML by kind, and names that pages give to what isn't content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var".split()
)
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog footer form head map menu nav object select svg template video math".split()
)
LEFT_OUT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright"
    " disqus disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification"
    " outbrain pagination pager popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
LANDMARKS = frozenset(("article", "main"))
#: Start tags that end open elements of these names, unless one of the others lies between.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset(("body",))),
}


class Open(NamedTuple):
    """An open element."""

    name: str
    path: int
    out: bool
    landmark: bool


@lru_cache(maxsize=4096)
def _kind(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is left out, and its step in a path."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    style = given.get("style", "").replace(" ", "").lower()
    out = name in LEFT_OUT or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style
    if name not in ("html", "body", "article", "main"):
        named = {w.lower() for w in _NAME_WORD.findall(f"{given.get('class', '')} {given.get('id', '')}")}
        out = out or bool(named & LEFT_OUT_NAMES)
    else:  # the landmark of one comment or advert
        own = {w.lower() for w in _NAME_WORD.findall(given.get("class", "").split(" ")[0])} if name == "article" else set()
        out = out or bool(own & LEFT_OUT_NAMES)
    out = out or given.get("role", "").lower() in LEFT_OUT_ROLES
    return out, f"{name}.{given.get('class', '')}" if name in ("div", "section", "span", "td") else name


class Page:
    """Blocks of a page: path, text and characters inside links.

    Of each path: the one above, the landmark it is inside of (or 0), and whether what
    it holds has nothing in common (root, html, body).
    """

    def __init__(self, html: str) -> None:
        self.parents, self.inside, self.alone = [-1], [0], [True]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []
        self.stack = [Open("", 0, False, False)]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.link, self.links = 0, 0  # depth of the open link, 0 for none; characters inside links
        at = 0
        while found := _MARKUP.search(html, at):
            self.text(html[at : found.start()])
            at = found.end()
            name = (found[2] or "").lower()
            if found[1]:
                self.end(name)
            elif name:
                self.start(name, found[3])
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
                    at = close.end() if close else len(html)
        self.text(html[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].out:
            raw = unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.link:
                self.links += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.stack[-1].path, text, min(self.links, len(text))))
            self.parts, self.links = [], 0

    def pop(self, to: int) -> None:
        """Close all elements from this depth on."""
        self.flush()
        for element in self.stack[to:]:
            self.open[element.name] -= 1
        del self.stack[to:]
        if self.link >= to:
            self.link = 0

    def start(self, name: str, attributes: str) -> None:
        if name in RAW:
            return
        if name == "br":
            self.text(" ")
            return
        out, step = _kind(name, attributes)
        if name == "a":
            self.link = len(self.stack)
        if name in VOID or (name in INLINE and not out):
            if name == "hr":
                self.flush()
            return
        # A header inside an article is part of it.
        top = self.stack[-1]
        out = out or (name == "header" and not top.landmark)
        self.flush()
        if name not in INLINE:
            depth = len(self.stack) - 1
            while self.stack[depth].name in INLINE:
                depth -= 1
            if self.stack[depth].name == "p":
                self.pop(depth)
        if name in ENDS:
            same, stop = ENDS[name]
            if any(self.open[s] for s in same):
                for depth in range(len(self.stack) - 1, 0, -1):
                    if self.stack[depth].name in same:
                        self.pop(depth)
                    if depth >= len(self.stack) or self.stack[depth].name in stop:
                        break
        top = self.stack[-1]
        path = self.paths.setdefault((top.path, step), len(self.parents))
        if path == len(self.parents):
            self.parents.append(top.path)
            self.inside.append(self.inside[top.path] or (path if name in LANDMARKS else 0))
            self.alone.append(name in ("html", "body"))
        self.open[name] += 1
        self.stack.append(Open(name, path, top.out or out, top.landmark or name in LANDMARKS))

    def end(self, name: str) -> None:
        if name == "a":
            self.link = 0
        if name == "br":
            self.text(" ")
        if self.open[name] <= 0:
            return
        depth = len(self.stack) - 1
        while self.stack[depth].name != name:
            depth -= 1
        self.pop(depth)

    def content(self) -> str:
        """The blocks of the paths whose fused ratio reaches the threshold."""
        marked = any(self.inside[path] for path, _, _ in self.blocks)
        blocks = [b for b in self.blocks if self.inside[b[0]]] if marked else self.blocks
        own: dict[int, list[int]] = {}
        for path, text, links in blocks:
            sums = own.setdefault(path, [0, 0, 0])
            sums[0] += len(text) - links
            sums[1] += len(_PUNCTUATION.findall(text)) if links < len(text) else 0
            sums[2] += 1
        below = [[0, 0, 0] for _ in self.parents]
        for path, sums in own.items():
            below[path] = sums.copy()
        for path in range(len(below) - 1, 0, -1):  # containers come before what they hold
            for i in range(3):
                below[self.parents[path]][i] += below[path][i]
        fused = {}
        for path, sums in own.items():
            text, marks, weight = sums[0] / sums[2], sums[1] / sums[2], 1.0
            above, total = self.parents[path], 1.0
            containers = []
            # The root, html and body say nothing about a path, nor does what holds the landmark.
            while len(containers) < LEVELS - 1 and not self.alone[above] and path != self.inside[path]:
                containers.append(above)
                if above == self.inside[path]:
                    break
                above = self.parents[above]
            if self.inside[path] and path != self.inside[path] and containers[-1] != self.inside[path]:
                containers.append(self.inside[path])
            for above in containers:
                weight /= 2
                text += weight * below[above][0] / below[above][2]
                marks += weight * below[above][1] / below[above][2]
                total += weight
            fused[path] = text / total * marks / total
        least = THRESHOLD * max(fused.values(), default=0.0) / (LANDMARK if marked else 1.0)
        kept = {path for path, value in fused.items() if value >= least and own[path][0]}
        return " ".join(text for path, text, _ in blocks if path in kept)


def main_text(html: str | None) -> str:
    return Page(html).content() if html else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "html"):
        text = [main_text(html) for html in piece.column("html").to_pylist()]
        yield pa.record_batch(
            {
                "page_id": piece.column("page_id"),
                "url": piece.column("url"),
                "text": pa.array(text, pa.string()),
                "n_chars": pa.array([len(t) for t in text], pa.int64()),
            }
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of each page."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long"
    )
