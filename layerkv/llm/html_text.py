"""The main text of web pages, by tag-path ratios.

A page is read into blocks of text, each with the tag path from the root to its element. Over all
blocks of a path, characters outside links and punctuation marks are added up and divided by the number
of blocks; every block gets its path's two ratios, both are smoothed along the page and fused by
multiplication. What tags, classes and ids say weighs in as a factor of the path: an element that
announces a menu, header, footer, sidebar, notice, advert, form or comments lowers it, ``article`` and
``main`` raise it. Paths at or above a threshold, a part of the page's mean, are content.

The innermost element that holds most of the content's weight (characters times score), and outside of
which no content has one of its paths, is the article's frame. An ``article`` element is a frame too where
others of its path hold content: those with a good part of its weight are frames beside it. A frame's
text is the content blocks in it, and what stands among them (a title, a list, a table cell): a block
whose nearest ancestor with content blocks of its own lies in the frame, with no lowering element between
and not a list of nothing but links.

Defined results
- A null or empty page has the empty text; a page of plain text is its own text. Repeated rows are read each for itself.
- Character references are decoded, white space inside a block becomes one space, blocks are trimmed
  and joined by a line feed, empty ones left out. A ``br`` is white space.
- Scripts, styles, titles and elements that are hidden or hold no text of a page are never text.
- Several articles that each hold a good part of the content are all returned; a teaser beside one isn't.
- Names count as whole tokens of a class or id whose parts all tell of the same kind (``cookie-notice``,
  ``ad-box``), so ``promotion-history`` lowers nothing.
- Unclosed and misplaced tags are closed where HTML closes them; an unclosed comment or script runs
  to the end of the page. Reading takes time in proportion to the page, however deep it is.
- Input columns ``text`` and ``n_chars`` are left out; an empty table gives an empty result.
- Nothing is cut off: whole pages are read and the whole article is returned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from layerkv.llm.common import col, map_arrow, others

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"]{0,4000}\"|'[^']{0,4000}'|[\"'])*+)>", re.DOTALL
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: Elements that hold no text of the page.
SILENT = frozenset("script style textarea title noscript iframe noframes template svg canvas object audio video datalist head".split())
#: Elements, and words of a class, id or role, that lower a path.
ASIDE = frozenset("nav footer aside form select button fieldset dialog menu".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup sidebar sidenav rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer comment comments "
    "disqus respond reply replies discussion share sharing social related recommended recommendations login search toolbar copyright disclaimer contentinfo complementary dialog form".split()
)
#: Words that say nothing beside one of those.
PLAIN = frozenset("box block list item items inner outer wrapper wrap container area section group row col left right top bottom site page global widget button buttons link links bar message text id".split())
#: Elements that a name of several parts never lowers, since it tells of something in them.
FRAME = frozenset("html body main article".split())
#: Start tags that close an open element of these names, up to the elements that shield it.
CLOSES = {
    **{n: ("p",) for n in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "option": ("option",), "body": ("head",),
}
SHIELDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "option": ("select",)}
KEEP_PARAGRAPH = frozenset("table td th button object caption body html article section div li blockquote figure main".split())

SMOOTH = (0.25, 0.5, 0.25)
#: Factors of a path that a lowering or a raising element is on.
LOWER, RAISE = 0.05, 3.0
#: Part of the mean score of a page's blocks from which on a path is content.
THRESHOLD = 0.4
#: Part of the content's weight that an element must hold to be the article's frame, and part of the frame's that its like holds.
MOST, ALIKE = 0.6, 0.1


def marks(token: str, frame: bool) -> bool:
    """Whether a token of a class, id or role announces what isn't the article."""
    parts = [p.lower() for p in PARTS.findall(token) if not p.isdigit()]
    return any(p in MARKS for p in parts) and all(p in MARKS or p in PLAIN for p in parts) and not (frame and len(parts) > 1)


class Page:
    """Elements in the order they open, and blocks of text."""

    def __init__(self, source: str):
        self.name, self.parent, self.last, self.dropped, self.factor, self.path = ["#"], [0], [0], [False], [1.0], [0]
        self.paths: dict[tuple[int, str, bool], int] = {}
        self.block_element: list[int] = []
        self.block_text: list[str] = []
        self.block_links: list[int] = []
        self._stack, self._open, self._parts, self._links, self._owner = [0], {}, [], 0, 0
        self._read(source)

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text and not self.dropped[self._owner]:
            self.block_element.append(self._owner)
            self.block_text.append(text)
            self.block_links.append(self._links)
        self._parts, self._links = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            if not self._parts:
                at = len(self._stack) - 1
                while at and self.name[self._stack[at]] in INLINE:
                    at -= 1
                self._owner = self._stack[at]
            self._parts.append(text)
            if self._open.get("a"):
                self._links += len(text.strip())

    def _push(self, name: str, rest: str) -> None:
        up = self._stack[-1]
        number = len(self.name)
        self.name.append(name), self.parent.append(up), self.last.append(number)
        silent, low = self._kind(name, rest)
        self.path.append(self.paths.setdefault((self.path[up], name, low), len(self.paths) + 1))
        self.dropped.append(self.dropped[up] or silent)
        raised = name in ("article", "main") and self.factor[up] == 1
        self.factor.append(self.factor[up] * (LOWER if low else RAISE if raised else 1))
        self._stack.append(number)
        self._open[name] = self._open.get(name, 0) + 1

    def _kind(self, name: str, rest: str) -> tuple[bool, bool]:
        """Whether an element is never text, and whether it lowers its paths."""
        low = name in ASIDE or name == "header" and not self._open.get("article") and not self._open.get("main")
        if name in SILENT:
            return True, low
        if "=" in rest or "hidden" in rest:
            for key, *values in ATTRIBUTE.findall(rest):
                key, value = key.lower(), "".join(values)
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                    if name not in FRAME:
                        return True, low
                elif key in ("class", "id", "role"):
                    low = low or any(marks(token, name in FRAME) for token in value.split())
        return False, low

    def _pop_to(self, at: int) -> None:
        """Close the elements from place ``at`` of the stack on."""
        while len(self._stack) > at:
            number = self._stack.pop()
            self.last[number] = len(self.name) - 1
            self._open[self.name[number]] -= 1

    def _close(self, names: tuple[str, ...], shields: tuple[str, ...] | frozenset) -> None:
        if not any(self._open.get(n) for n in names):
            return
        at, found = len(self._stack) - 1, None
        while at > 0 and self.name[self._stack[at]] not in shields:
            if self.name[self._stack[at]] in names:
                found = at
            at -= 1
        if found is not None:
            self._pop_to(found)

    def _read(self, source: str) -> None:
        at = 0
        while m := TAG.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if name not in INLINE:
                self._flush()
            if m["end"]:
                if self._open.get(name) and name not in ("html", "body"):
                    place = len(self._stack) - 1
                    while self.name[self._stack[place]] != name:
                        place -= 1
                    if name not in INLINE or all(self.name[e] in INLINE for e in self._stack[place:]):
                        self._pop_to(place)
                continue
            if name in ("br", "hr"):
                self._text(" ")
            if name in VOID:
                continue
            if name in CLOSES:
                self._close(CLOSES[name], SHIELDS.get(name, KEEP_PARAGRAPH))
            if self._open.get("head") and name not in RAW and name not in ("head", "template", "object"):
                self._close(("head",), ())
            self._push(name, m["rest"])
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = stop.end() if stop else len(source)
                self._pop_to(len(self._stack) - 1)
            elif m["rest"].endswith("/") and name in ("svg", "path", "use"):
                self._pop_to(len(self._stack) - 1)
        self._text(source[at:])
        self._flush()
        self._pop_to(1)
        self.last[0] = len(self.name) - 1


def scores(page: Page) -> np.ndarray:
    """Each block's fused ratio: its path's characters and marks for each block, smoothed along the page, times the path's factor."""
    path = np.array([page.path[e] for e in page.block_element])
    chars = np.array([len(t) - k if k < len(t) else 0 for t, k in zip(page.block_text, page.block_links, strict=True)], float)
    punctuation = np.array([len(PUNCTUATION.findall(t)) for t in page.block_text], float)
    _, path = np.unique(path, return_inverse=True)
    n = np.bincount(path)
    fused = np.ones(len(path))
    for amount in (chars, punctuation):
        ratio = (np.bincount(path, amount) / n)[path]
        padded = np.concatenate([ratio[:1], ratio, ratio[-1:]])
        fused *= 1 + np.convolve(padded, SMOOTH, "valid")
    return (fused - 1) * np.array([page.factor[e] for e in page.block_element])


def main_text(source: str | None) -> str:
    page = Page(source or "")
    if not page.block_text:
        return ""
    fused = scores(page)
    _, path = np.unique([page.path[e] for e in page.block_element], return_inverse=True)
    by_path = np.bincount(path, fused) / np.bincount(path)  # a path is content as a whole
    content = by_path[path] >= THRESHOLD * fused.mean()
    n = len(page.name)
    held, own = np.zeros(n), np.zeros(n, bool)
    first, last = [n] * n, [-1] * n  # where content of the paths that lie in an element begins and ends
    for k in np.flatnonzero(content):
        e = page.block_element[k]
        held[e] += len(page.block_text[k]) * fused[k]
        own[e if page.name[e] in FRAME or e == 0 else page.parent[e]] = True
    where: dict[int, list[int]] = {}
    for k in np.flatnonzero(content):
        where.setdefault(int(path[k]), []).append(page.block_element[k])
    for elements in where.values():
        low, high = min(elements), max(elements)
        for e in elements:
            first[e], last[e] = min(low, first[e]), max(high, last[e])
    children: dict[int, list[int]] = {}
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        held[up] += held[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
        if held[e] > 0 and page.name[e] not in INLINE:
            children.setdefault(up, []).append(e)
    root = 0
    while page.name[root] != "article" and (inner := max(children.get(root, []), key=lambda e: (held[e], -e), default=None)) is not None:
        alone = page.name[inner] == "article" or inner <= first[inner] and last[inner] <= page.last[inner]
        if held[inner] < MOST * held[root] or not alone or not children.get(inner):
            break
        root = inner
    alike = [e for e in range(1, n) if page.name[root] == "article" and page.path[e] == page.path[root] and held[e] >= ALIKE * held[root]]
    inside, among = [False] * n, [False] * n  # of a frame; among content blocks in it
    for r in {root, *alike}:
        for e in range(r, page.last[r] + 1):
            inside[e] = True
            among[e] = bool(own[e]) or e != r and among[page.parent[e]] and page.factor[e] >= page.factor[page.parent[e]]
    out = []
    for e, text, links, good in zip(page.block_element, page.block_text, page.block_links, content, strict=True):
        if inside[e] and (good or among[e] and not (page.name[e] in ("li", "dd", "td") and links >= 0.9 * len(text))):
            out.append(text)
    return "\n".join(out)


def extract(df: DataFrame, source: str = "html") -> DataFrame:
    """The columns of ``df`` with ``text`` and ``n_chars`` in place of the page's source."""
    rest = others(df, source, "text", "n_chars")
    schema = df.select(*map(col, rest)).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return map_arrow(df.select(*map(col, [*rest, source])), run, schema)
