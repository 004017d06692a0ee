"""Layout-aware text of web pages.

A tokenizer and a tree builder with implied tags (a list item ends an open one, a block ends an
open paragraph, cells end cells, ...) turn any markup into a tree of any depth; unmatched end tags
are ignored. Visibility rules then drop what a browser does not show: head, scripts, styles,
templates, elements that are hidden by attribute or inline style, closed details, options that are
not selected, definitions and descriptions inside drawings and formulas. The renderer emits all
other text, values of text inputs included: paragraphs and headings between blank lines, other
blocks on lines of their own, list items with bullets or numbers and indentation, preformatted
text as it stands, and tables with their cells padded to common column widths.

Defined cases: a null page gives null, an empty or invisible one the empty string; pages of any
length and depth are read whole, in time linear in their length (text inside nested tables is copied
once for each of them); rows that repeat give equal rows; other columns are ignored. Indentation
stops growing at ``MOST_INDENT`` columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, texts

#: Columns of indentation at most; deeper lists and quotations are shown at this one.
MOST_INDENT = 80
#: Cells wider than this do not widen their column.
WIDEST = 60

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style template noframes noembed iframe datalist object audio video canvas area param".split())
#: Parts of drawings and formulas that are not shown.
UNSEEN_INSIDE = {"svg": frozenset("defs desc metadata symbol clippath marker mask pattern".split()), "math": frozenset("annotation annotation-xml".split())}
#: Inputs that show no text of theirs.
TEXTLESS_INPUTS = frozenset("hidden checkbox radio password file color range image".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd dir div dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option section summary caption tr thead tbody tfoot".split())
#: What the start of an element ends, and the elements that such an ending does not go beyond.
ENDS_P = (BLOCKS - frozenset("li dd dt option optgroup tr thead tbody tfoot caption html body legend".split())) | {"li", "dd", "dt"}
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"td", "th", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
SCOPE = frozenset("td th caption table button".split())

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?P<self>/)?(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder:
    """The tree and its open elements; ``places`` holds the open places of each tag, so that no search walks the stack."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, place: int) -> None:
        """Ends the open elements from a place on."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def text(self, text: str) -> None:
        if text:
            if self.open[-1].tag == "head" and text.strip():
                self._cut(len(self.open) - 1)
            self.open[-1].children.append(text)

    def _close(self, tags: frozenset, until: frozenset) -> None:
        """Ends the open elements down to the outermost of ``tags`` inside the innermost of ``until``."""
        border, found = self._innermost(until), len(self.open)
        for tag in tags:
            held = self.places.get(tag)
            if held and held[-1] > border:
                found = min(found, held[bisect_right(held, border)])
        self._cut(found)

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._close(frozenset({"head"}), frozenset())
            self.root.attrs |= attrs
            return
        if tag == "select" and self.places.get("select"):
            self.end("select")  # a select inside a select only ends it
            return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._cut(len(self.open) - 1)
        if tag in ENDS_P:
            self._close(frozenset({"p"}), SCOPE)
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.open[-1].tag):
            self._cut(len(self.open) - 1)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if any(tag in unseen and self.places.get(outer) for outer, unseen in UNSEEN_INSIDE.items()):
            attrs = attrs | {"hidden": ""}
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID and not empty:
            self._push(node)

    def end(self, tag: str) -> None:
        place = self._innermost([tag])
        inside = tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th")
        if place and (inside or place > self._innermost(("table", "td", "th"))):
            self._cut(place)
        elif tag == "br" and not place:
            self.start("br", {}, False)


@lru_cache(maxsize=None)
def end_of(tag: str) -> re.Pattern:
    """The end tag of a raw element; letters of ASCII alone match in both cases."""
    return re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I | re.A)


def parse(page: str) -> Node:
    builder, at = Builder(), 0
    while True:
        found = TAG.search(page, at)
        if not found:
            builder.text(html.unescape(page[at:]))
            return builder.root
        builder.text(html.unescape(page[at : found.start()]))
        at = found.end()
        if not found["name"]:
            continue
        tag = found["name"].lower()
        if found["end"]:
            builder.end(tag)
            continue
        attrs = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTR.findall(found["attrs"])} if found["attrs"].strip() else {}
        builder.start(tag, attrs, bool(found["self"]) and tag not in BLOCKS and tag not in RAW)
        if tag in RAW:
            stop = end_of(tag).search(page, at)
            raw = page[at:] if stop is None else page[at : stop.start()]
            builder.open[-1].children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = len(page) if stop is None else stop.start()
        elif tag == "plaintext":
            builder.text(page[at:])
            return builder.root


def visible(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in UNSEEN or "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs):
        return False
    if node.tag == "title" or (node.tag == "input" and attrs.get("type", "").lower() in TEXTLESS_INPUTS):
        return False
    return not ("style" in attrs and HIDING.search(attrs["style"]))


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Renderer:
    """Lines of text with block spacing; ``gap`` is the number of line ends that are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap = "", False, 0
        self.indent, self.bullet = "", ""

    def words(self, text: str, kept: bool = False) -> None:
        if kept:
            first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in more:
                self._flush(force=True)
                self._put(line)
            return
        parts = SPACES.split(text)
        for k, part in enumerate(parts):
            if k:
                self.space = True
            if part:
                self._put((" " if self.space and self.line else "") + part)
                self.space = False

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.line and self.gap:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
        self.line += text

    def _flush(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append((self.bullet or self.indent) + self.line if self.line else "")
            if self.line and self.bullet:
                self.bullet = ""
            self.line = ""
        self.space = False

    def block(self, gap: int) -> None:
        self._flush()
        self.gap = max(self.gap, gap)

    def run(self, node: Node) -> None:
        """Renders an element's children. The steps below are generators that hand over the steps inside them, so depth needs no call stack."""
        steps = [self.children(node, False)]
        while steps:
            inner = next(steps[-1], None)
            if inner is None:
                steps.pop()
            else:
                steps.append(inner)

    def children(self, node: Node, kept: bool) -> Iterator:
        for child in node.children:
            if isinstance(child, str):
                self.words(child, kept)
            elif visible(child):
                yield self.node(child, kept)

    def node(self, node: Node, kept: bool) -> Iterator:
        tag = node.tag
        if tag == "br":
            self._flush(force=not self.line)
        elif tag == "input":
            self.words(" " + node.attrs.get("value", "") + " ")
        elif tag == "select":
            options = _options(node)
            shown = [c for c in options if "selected" in c.attrs] or options[:1]
            for option in shown:
                self.words(" ")
                yield self.children(option, kept)
                self.words(" ")
        elif tag in ("td", "th"):  # a cell outside a table
            self.words(" ")
            yield self.children(node, kept)
            self.words(" ")
        elif tag == "table":
            self.block(2)
            yield self.table(node)
            self.block(2)
        elif tag == "details" and "open" not in node.attrs:
            self.block(1)
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary" and visible(child):
                    yield self.children(child, kept)
            self.block(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            yield self.list(node, kept)
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            self.block(gap)
            held = self.indent
            if tag in ("blockquote", "dd"):
                self.indent = _at_most(self.indent + "  ")
            yield self.children(node, kept or tag in ("pre", "textarea", "listing"))
            self.block(gap)
            self.indent = held
        else:
            yield self.children(node, kept or tag == "textarea")

    def list(self, node: Node, kept: bool) -> Iterator:
        nested = self.indent != "" or self.bullet != ""
        self.block(1 if nested else 2)
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str):
                self.words(child, kept)
            elif child.tag != "li":
                if visible(child):
                    yield self.node(child, kept)
            elif visible(child):
                self.block(1)
                mark = f"{number}. " if node.tag == "ol" else "- "
                held = self.indent
                self.bullet, self.indent = held + mark, _at_most(held + " " * len(mark))
                yield self.children(child, kept)
                self.block(1)
                self.bullet, self.indent = "", held
                number += 1
        self.block(1 if nested else 2)

    def table(self, node: Node) -> Iterator:
        for caption in [c for c in node.children if isinstance(c, Node) and c.tag == "caption" and visible(c)]:
            yield self.children(caption, False)
            self.block(1)
        rows: list[list[str]] = []
        loose = Node("div")
        for row in _rows(node, loose):
            cells: list[str] = []
            for cell in row.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th"):
                    if visible(cell):
                        inner = Renderer()
                        yield inner.children(cell, False)
                        cells.append(" / ".join(x for x in (line.strip() for line in inner.finish().split("\n")) if x))
                        span = cell.attrs.get("colspan", "1")
                        cells += [""] * (min(int(span), 1000) - 1 if re.fullmatch(r"[1-9]\d{0,3}", span) else 0)
                else:
                    loose.children.append(cell)
            rows.append(cells)
        if loose.children:
            yield self.children(loose, False)
            self.block(1)
        columns = max(map(len, rows), default=0)
        widths = [max((w for r in rows if k < len(r) and (w := width(r[k])) <= WIDEST), default=0) for k in range(columns)]
        for row in rows:
            line = "  ".join(cell + " " * max(0, widths[k] - width(cell)) for k, cell in enumerate(row)).rstrip()
            if line:
                self._put(line)
                self.block(1)

    def finish(self) -> str:
        self._flush()
        lines = [line.rstrip() for line in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return "\n".join(lines)


def _at_most(indent: str) -> str:
    return indent[:MOST_INDENT]


def _options(node: Node) -> list[Node]:
    """The options below an element in their order, without what is hidden."""
    out, waiting = [], [node]
    while waiting:
        own = waiting.pop()
        if own.tag == "option":
            out.append(own)
        waiting += [c for c in reversed(own.children) if isinstance(c, Node) and visible(c)]
    return out


def _rows(node: Node, loose: Node) -> Iterator[Node]:
    """Rows of a table and its groups; what stands between them goes to ``loose``, which is shown before the table."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                loose.children.append(child)
        elif child.tag in ("caption", "colgroup", "col") or not visible(child):
            continue
        elif child.tag == "tr":
            yield child
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child, loose)
        elif child.tag in ("td", "th"):
            row = Node("tr")
            row.children.append(child)
            yield row
        else:
            loose.children.append(child)


def page_text(page: str | None) -> str | None:
    """The visible text of a page with its layout."""
    if page is None:
        return None
    renderer = Renderer()
    renderer.run(parse(page))
    return renderer.finish()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [page_text(p) for p in texts(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([None if t is None else len(t) for t in out], pa.int64())], ["page_id", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, text, n_chars)`` of every page."""
    small_batches(pages.sparkSession)
    items = pages.select("page_id", "html")
    return items.mapInArrow(_render, f"page_id {items.schema['page_id'].dataType.simpleString()}, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return extract(table(spark, sf_dir, "pages"))
