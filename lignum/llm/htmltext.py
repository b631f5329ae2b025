"""Layout-aware rendering of HTML: all visible text, laid out as a reader sees it.

A tokeniser feeds a tree builder that implies what markup leaves out (open
paragraphs, list items, table rows and cells end where the next one starts;
end tags close what is open inside them; stray ones are dropped). The renderer
walks the tree without recursion: white space collapses except in pre, blocks
start on lines of their own, paragraphs, headings, lists and tables have a
blank line around them, list items get bullets or numbers with indents, and
the cells of a table are padded so that its columns align. Spanning cells keep
the columns and rows that they cover free; text of a table outside its cells
comes before the table, as browsers have it.

Visibility follows the attributes and inline styles of a page and what browsers
do by default: display decides about whole subtrees, visibility is inherited and
a visible child of an invisible element is shown. Of a drawing (svg) its text
elements are text.

Defined cases: null html gives null text; empty html gives ''; unclosed tags,
comments and quotes run to the end; elements that browsers don't show (script,
style, template, noscript, head, hidden attributes, display:none and
visibility:hidden styles, hidden inputs, closed dialogs) give nothing; values of
form controls aren't text, the content of textareas is; unknown tags are
inline; any depth of nesting is allowed and costs no more than its length, but
lines are indented by `DEEPEST` columns at most; a cell longer than `ALIGNED`
characters is shown whole and doesn't widen its column; very long pages are
rendered whole; a null page_id and repeated rows are rendered like any other;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import subset

VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("script style template noscript head title iframe noembed noframes object audio video canvas datalist area rp annotation annotation-xml".split())
#: of a drawing
UNDRAWN = frozenset("defs symbol metadata desc clippath mask pattern marker lineargradient radialgradient filter".split())
FOREIGN = ("svg", "math")
KEPT = frozenset("pre xmp textarea plaintext listing".split())
DEEPEST, ALIGNED = 80, 400
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp plaintext listing blockquote figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div article section nav header footer aside main address form li dt dd tr caption thead tbody tfoot figcaption details summary dialog search legend center dir menu option optgroup".split())
_BLOCKS_END_P = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "legend"}
#: start tag -> (open tags that it ends, tags beyond which it doesn't look)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
} | {t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot")} | {t: ({"p"}, {"table", "td", "th", "caption", "button"}) for t in _BLOCKS_END_P}
#: an end tag doesn't close beyond these
_WALLS = {"table": set(), "td": {"table"}, "th": {"table"}, "tr": {"table"}, "li": {"ul", "ol"}}
#: a quote opens only after an equals sign, so an apostrophe in a bare value is part of it
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)?)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?)?")
_DECLARATION = re.compile(r"((?:[^;\"'(]|\"[^\"]*\"?|'[^']*'?|\([^)]*\)?)+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name, '' where there is none; of a name that is there twice the first counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _styles(text: str) -> dict[str, str]:
    """The declarations of a style attribute: of a property the last counts, important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _DECLARATION.findall(re.sub(r"/\*.*?(?:\*/|\Z)", " ", text, flags=re.S)):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        strong = value.endswith("!important")
        if value and strong >= found.get(name, (False, ""))[0]:
            found[name] = strong, value.removesuffix("!important").strip()
    return {k: v for k, (_, v) in found.items()}


def hidden(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element and all in it are out of the layout."""
    display = _styles(attrs["style"]).get("display", "") if "style" in attrs else ""
    if display:
        return display == "none"
    return "hidden" in attrs or (tag == "input" and attrs.get("type", "").strip().lower() == "hidden") or (tag == "dialog" and "open" not in attrs)


def _visible(attrs: dict[str, str], inherited: bool) -> bool:
    value = _styles(attrs["style"]).get("visibility", "") if "style" in attrs else ""
    return inherited if value not in ("visible", "hidden", "collapse") else value == "visible"


def _number(attrs: dict[str, str], name: str, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", attrs.get(name, ""))
    return int(m[1]) if m else default


class _Open:
    """The open elements. Each tag's places in the stack are at hand, so no search walks it."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], defaultdict[str, list[int]](list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags: Iterable[str], wall: int) -> int:
        return min((p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_left(p, wall + 1)) < len(p)), default=0)

    def cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]


def build(page: str) -> Node:
    root = Node("#root")
    open_, at = _Open(root), 0
    stack = open_.stack
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else len(page)]
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = open_.last((tag,))
            if place > open_.last(_WALLS.get(tag, ("td", "th", "table") if tag not in ("html", "body") else ())):
                open_.cut(place)
            elif tag in ("p", "br"):  # a stray one is an empty element
                stack[-1].kids.append(Node(tag))
            continue
        if tag in ENDS:
            gone, wall = ENDS[tag]
            limit = open_.last(wall)
            place = open_.first_after(gone, limit) if tag in ("tr", "thead", "tbody", "tfoot") else open_.last(gone)
            if place > limit:
                open_.cut(place)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].kids.append(row)
            open_.push(row)
        node = Node(tag, m[3] or "")
        stack[-1].kids.append(node)
        foreign = open_.last(FOREIGN) > open_.last(("foreignobject",))
        if tag in RAW and not foreign:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at) if tag != "plaintext" else None
            text = page[at : end.start() if end else len(page)]
            node.kids.append(html.unescape(text) if tag == "textarea" else text)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (foreign and node.attrs.endswith("/")):
            open_.push(node)
    return root


class _Out:
    """Lines of text with collapsed white space; a gap is the line breaks that are due before the next text."""

    __slots__ = ("parts", "gap", "space", "indent", "hang")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap = self.indent = 0
        self.space = False
        self.hang = ""

    def break_(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def put(self, text: str) -> None:
        if self.gap or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.gap)
            self.parts.append(" " * min(self.indent, DEEPEST) + self.hang)
            self.gap, self.hang = 0, ""
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)

    def text(self, raw: str) -> None:
        words = _SPACE.sub(" ", raw)
        if words[:1] == " ":
            self.space = bool(self.parts) and not self.gap
        if inner := words.strip(" "):
            self.put(inner)
            self.space = words[-1] == " "

    def line(self) -> None:
        self.gap += 1
        self.space = False

    def done(self) -> str:
        return "".join(self.parts)


class _Row:
    """Cells as (text, columns, rows); a caption takes no part in spans, a row that starts a group ends those above."""

    __slots__ = ("cells", "caption", "group")

    def __init__(self, caption: bool = False, group: bool = False) -> None:
        self.cells: list[tuple[str, int, int]] = []
        self.caption, self.group = caption, group


def _table(rows: list[_Row]) -> list[str]:
    placed: list[list[tuple[int, int, str]]] = []  # (first column, column after the last, text) of each row
    down: list[tuple[int, int, int]] = []  # (first column, column after the last, rows to go) of the cells from above, in order
    for row in rows:
        if row.group:
            down = []
        here, now, at, k = [], [], 0, 0
        for text, columns, deep in row.cells:
            while not row.caption and k < len(down) and down[k][0] <= at:
                at, k = max(at, down[k][1]), k + 1
            end = at + columns
            here.append((at, end, _SPACE.sub(" ", text).strip(" ")))
            if deep > 1:
                now.append((at, end, deep - 1))
            at = end
        if not row.caption:
            down = sorted([(a, b, n - 1) for a, b, n in down if n > 1] + now)
        if any(t.strip() for *_, t in here):
            placed.append(here)
    used = sorted({a for row in placed for a, _, _ in row})  # columns in which no cell starts have no width
    cells = [[(bisect_left(used, a), bisect_left(used, b), t) for a, b, t in row] for row in placed]
    width = [0] * len(used)
    for a, b, t in sorted((c for row in cells for c in row), key=lambda c: c[1] - c[0]):
        room = sum(width[a:b]) + 3 * (b - a - 1)
        if len(t) <= ALIGNED:  # a longer one runs over, else all rows would be padded to it
            width[b - 1] += max(0, len(t) - room)
    out = []
    for row in cells:
        parts, at = [], 0
        for a, b, t in row:
            parts += [" " * w for w in width[at:a]]
            parts.append(t.ljust(sum(width[a:b]) + 3 * (b - a - 1)))
            at = max(at, b)
        out.append(" | ".join(parts).rstrip())
    return out


def render(page: str | None) -> str | None:
    if page is None:
        return None
    out = _Out()
    tables: list[tuple[_Out, list[_Row]]] = []  # the outer output and the rows so far
    cells: list[tuple[_Out, _Row]] = []  # of each open cell, what gathers the text around it, and its row
    counters: list[int | None] = []  # next number of each open list, None for bullets
    pre = 0
    shown, drawn = True, True  # whether text is visible; within a drawing, whether it is in a text element
    around: list[tuple[bool, bool]] = []  # of the open elements' surroundings
    work: list[tuple[Node | str, bool]] = [(build(page), False)]
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            if not (shown and drawn):
                continue
            if pre:
                for k, line in enumerate(node.replace("\r\n", "\n").split("\n")):
                    if k:
                        out.line()
                    if line:
                        out.put(line)
            else:
                out.text(node)
            continue
        tag = node.tag
        if leaving:
            shown, drawn = around.pop()
            if tag in ("ul", "ol"):
                counters.pop()
                out.indent = max(0, out.indent - 2)
        gap = 2 if tag in SPACED and not counters else 1  # close together inside lists
        if leaving:
            if tag in ("td", "th", "caption") and tables:
                text = out.done().replace("\n", " ")
                out, row = cells.pop()
                attrs = attributes(node.attrs) if node.attrs else {}
                columns, deep = _number(attrs, "colspan", 1), _number(attrs, "rowspan", 1)
                row.cells.append((text, min(max(columns, 1), 1000), min(deep, 65534) if deep > 0 else 1 if deep else 65534))
                out.break_(1)
            elif tag == "table" and tables:
                stray = out.done()  # text outside the cells comes before the table
                out, rows = tables.pop()
                if stray:
                    out.put(stray)
                    out.break_(gap)
                for line in _table(rows):
                    out.break_(1)
                    out.put(line)
            elif tag in ("dd", "blockquote"):
                out.indent = max(0, out.indent - 2)
            elif tag in KEPT:
                pre -= 1
            elif tag == "li":
                out.hang = ""
            if tag in BLOCK:
                out.break_(gap)
            continue
        if tag in HIDDEN:
            continue
        attrs = attributes(node.attrs) if node.attrs else {}
        if hidden(tag, attrs) or (tag in UNDRAWN and not drawn):
            continue
        around.append((shown, drawn))
        shown = _visible(attrs, shown)
        if tag == "svg":
            drawn = False
        elif tag in ("text", "foreignobject"):
            drawn = True
        if tag == "br":
            out.line()
        elif tag == "img" and shown and drawn:
            out.text(attrs.get("alt", ""))
        if tag in BLOCK:
            out.break_(gap)
        if tag == "table":
            tables.append((out, []))
            out = _Out()
        elif tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1][1].append(_Row(group=True))
        elif tag == "tr" and tables:
            tables[-1][1].append(_Row())
        elif tag in ("td", "th", "caption") and tables:
            rows = tables[-1][1]
            if tag == "caption" or all(r.caption for r in rows):
                rows.append(_Row(tag == "caption"))
            cells.append((out, rows[-1] if tag == "caption" else next(r for r in reversed(rows) if not r.caption)))
            out = _Out()
        elif tag in ("ul", "ol"):
            counters.append(_number(attrs, "start", 1) if tag == "ol" else None)
            out.indent += 2
        elif tag in ("dd", "blockquote"):
            out.indent += 2
        elif tag in KEPT:
            pre += 1
            if node.kids and isinstance(node.kids[0], str):  # a line end right after the tag isn't shown
                node.kids[0] = re.sub(r"\A\r?\n", "", node.kids[0])
        elif tag == "li":
            mark = "- "
            if counters and counters[-1] is not None:
                mark, counters[-1] = f"{counters[-1]}. ", counters[-1] + 1
            if shown and drawn:
                out.hang = mark
        work.append((node, True))
        work.extend((k, False) for k in reversed(node.kids))
    return re.sub(r"\n{3,}", "\n\n", out.done()).strip("\n")


@F.arrow_udf(T.StringType())
def _rendered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([render(p) for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each page."""
    return subset(pages, "page_id", "url", "html").select("page_id", "url", _rendered("html").alias("text"))
