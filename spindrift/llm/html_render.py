"""Layout-aware rendering of HTML to text.

A tree builder reads tags in any order, closes elements that HTML closes by
implication (the head, paragraphs, list items, table parts, options, definitions)
and drops nothing but what is not shown: the head, comments, scripts, styles,
templates, elements hidden by attribute or inline ``display:none``, and what
drawings and formulas only define or describe. ``visibility`` is inherited and can be
taken back by an inner element. Only inline styles count; style sheets are not read.
The renderer emits all visible text. White space collapses outside ``pre``; blocks
start on lines of their own, paragraph-like ones behind a blank line; list items get
bullets or numbers and an indent; the cells of a table are padded to its columns,
with column and row spans, by the width that wide scripts take.

A page is processed whole, in time linear in its markup, at any nesting: open
elements are found by name, and rendering keeps its own stack. Lists and tables
inside of ``LEVELS`` others keep their text as plain blocks, because each level
would widen all lines in it. Unclosed tags end with the page; an unfinished tag at
the end is text.

Nulls and edge cases: null and empty markup give the empty text. Rows repeated
whole are rendered each. Other columns are ignored. An empty table gives an empty
table.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_parts import text_parts

LEVELS = 12
#: The most columns and rows that HTML lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A tag; only a value behind ``=`` is quoted. Nothing is tried twice, so a match is linear.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
WHITE = re.compile(r"[ \t\n\r\f\v]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas datalist".split())
#: Not shown inside of svg and math.
UNDRAWN = frozenset("desc metadata defs symbol clippath annotation annotation-xml".split())
#: These leave an open head open; any other start tag and any text close it.
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody thead tfoot tr td th caption ul option optgroup select".split())
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre table ul".split())
#: A start tag of the key closes an open element of the value, unless one of the walls lies between.
PARTS = {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th", "caption", "colgroup"}, "th": {"td", "th", "caption", "colgroup"},
          "tbody": PARTS, "thead": PARTS, "tfoot": PARTS, "caption": {"colgroup"}, "colgroup": {"caption", "colgroup"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"}}
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}


@dataclass(slots=True)
class Node:
    tag: str
    hidden: bool = False
    attrs: str = ""
    children: list = field(default_factory=list)
    apart: bool = False  # a text of a drawing
    seen: bool | None = None  # what the element's own style says of visibility


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
        out.setdefault(m[1].lower(), html.unescape(value[1:-1] if quoted else value))
    return out


def visibility_of(tag: str, raw: str) -> tuple[bool, bool | None]:
    """Whether the element is not displayed, and whether its style shows or hides its text."""
    if tag in UNSEEN:
        return True, None
    low = raw.lower()
    if "hidden" not in low and "style" not in low:
        return False, None
    found = attributes(raw)
    style = {}
    for rule in found.get("style", "").lower().split(";"):
        name, _, value = rule.partition(":")
        style[name.strip()] = value.replace("!important", "").strip()
    gone = "hidden" in found or style.get("display") == "none" or tag == "input" and found.get("type", "").lower() == "hidden"
    return gone, {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""))


class Tree:
    """Open elements, with the places of each name, so that no search walks over them."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside of it."""
        for node in self.open[place:]:
            self.places[node.tag].pop()
        del self.open[place:]

    def last(self, tags) -> int:
        """The place of the innermost open element of these names; 0 where there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def text(self, raw: str) -> None:
        if raw:
            if self.open[-1].tag == "head" and raw.strip(" \t\n\r\f"):
                self.cut(len(self.open) - 1)
            self.open[-1].children.append(raw)

    def end(self, tag: str) -> None:
        place = self.last([tag])
        # a stray end tag doesn't leave its cell
        if place and (tag in LEAVES_CELLS or place >= self.last(CELLS)):
            self.cut(place)

    def imply(self, tag: str) -> None:
        """Close what a start tag closes by implication."""
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.open) - 1)
        if tag in CLOSES_P and (place := self.last(["p"])) > self.last(P_WALLS):
            self.cut(place)
        closes = CLOSES.get(tag)
        if closes and (place := self.last(closes)) > self.last(WALLS.get(tag, {"table"})):
            while place > 1 and self.open[place - 1].tag in closes:
                place -= 1
            self.cut(place)

    @property
    def foreign(self) -> bool:
        return bool(self.places.get("svg") or self.places.get("math"))


CELLS = ("td", "th", "table")
LEAVES_CELLS = frozenset("table tr tbody thead tfoot body html".split())
P_WALLS = ("td", "th", "table", "li", "div", "section", "article", "dd", "dt", "button")


def build(markup: str) -> Node:
    """The tree of a page."""
    tree, at, size = Tree(), 0, len(markup)
    low = markup.lower() if markup.isascii() else "".join(c.lower() if c < "\x80" else c for c in markup)
    while at < size:
        sign = markup.find("<", at)
        if sign < 0 or sign + 1 == size:
            tree.text(markup[at:])
            break
        then = markup[sign + 1]
        if then in "!?":
            tree.text(markup[at:sign])
            comment = markup.startswith("<!--", sign)
            end = markup.find("-->", sign + 2) if comment else markup.find(">", sign)  # "<!-->" is a whole comment
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        if not (then.isascii() and then.isalpha() or then == "/" and markup[sign + 2:sign + 3].isalpha()):
            tree.text(markup[at:sign + 1])
            at = sign + 1
            continue
        m = TAG.match(markup, sign)
        if m is None:  # no tag ends any more
            tree.text(markup[at:])
            break
        tree.text(markup[at:sign])
        at, tag = m.end(), m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        if tag == "html":
            continue
        tree.imply(tag)
        foreign = tree.foreign
        gone, seen = visibility_of(tag, m[3])
        node = Node(tag, gone or foreign and tag in UNDRAWN, m[3], apart=foreign and tag == "text", seen=seen)
        tree.open[-1].children.append(node)
        if tag in VOID or foreign and m[3].endswith("/"):
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])").search(low, at)
            end = found.start() if found else -1
            node.children.append(markup[at:size if end < 0 else end])
            close = markup.find(">", end) if end >= 0 else -1
            at = size if close < 0 else close + 1
        else:
            tree.push(node)
    return tree.root


class Lines:
    """Output lines with collapsing white space and pending breaks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0  # blank lines wanted before the next text

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(raw.expandtabs(8).replace("\r\n", "\n").split("\n")):
                if k:
                    self.end(force=True)
                if part:
                    self._start()
                    self.line.append(part)
            return
        words = [w for w in WHITE.split(raw) if w]
        if not words:
            self.space = self.space or bool(raw) and bool(self.line)
            return
        if self.line and (self.space or raw[0] in " \t\n\r\f\v"):
            self.line.append(" ")
        self._start()
        self.line.append(" ".join(words))
        self.space = raw[-1] in " \t\n\r\f\v"

    def _start(self) -> None:
        if not self.line and self.gap:
            if self.done:
                self.done.extend([""] * self.gap)
            self.gap = 0

    def end(self, force: bool = False) -> None:
        if self.line or force:
            self.done.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, int(spaced))

    def put(self, lines: list[str]) -> None:
        if lines:
            self.end()
            self._start()
            self.gap = 0
            self.done.extend(lines)

    def result(self) -> list[str]:
        self.end()
        return self.done


def shown(node: Node) -> list:
    return [c for c in node.children if not (isinstance(c, Node) and c.hidden)]


def render_into(node: Node, out: Lines, pre: bool, level: int, seen: bool) -> None:
    """Emit what a node shows. The stack holds what is left of each open node and what its end does."""
    stack = [(iter(shown(node)), None, pre, seen, node.tag)]
    while stack:
        rest, spaced, pre, seen, parent = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if spaced is not None:
                out.block(spaced)
            continue
        if isinstance(child, str):
            if seen:
                out.text(html.unescape(child) if "&" in child else child, pre)
            continue
        tag, here = child.tag, seen if child.seen is None else child.seen
        if tag == "br":
            out.end(force=True)
        elif tag == "hr":
            out.block(True)
            if here:
                out.put(["---"])
            out.block(True)
        elif tag in ("img", "input"):
            found = attributes(child.attrs)
            label = found.get("alt", "") if tag == "img" else found.get("value", "") or found.get("placeholder", "")
            if label and here:
                out.text(f" {label} ", False)
        elif tag == "table" and level < LEVELS:
            out.block(True)
            out.put(table_lines(child, level + 1, here))
            out.block(True)
        elif tag in ("ul", "ol", "menu") and level < LEVELS:
            nested = parent not in ("li", "ul", "ol")  # a nested list follows its item's line directly
            out.block(nested)
            out.put(list_lines(child, tag == "ol", level + 1, here))
            out.block(nested)
        elif tag in BLOCK or child.apart:
            out.block(tag in SPACED)
            stack.append((iter(shown(child)), tag in SPACED, pre or tag == "pre", here, tag))
        else:
            stack.append((iter(shown(child)), None, pre or tag == "textarea", here, tag))


def lines_of(node: Node, level: int = 0, seen: bool = True) -> list[str]:
    out = Lines()
    render_into(node, out, False, level, seen if node.seen is None else node.seen)
    return out.result()


def list_lines(node: Node, ordered: bool, level: int, seen: bool) -> list[str]:
    start = attributes(node.attrs).get("start", "1") if ordered else "1"
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    out: list[str] = []
    loose = Node("div")
    for child in [*shown(node), Node("li")]:
        if isinstance(child, Node) and child.tag == "li":
            if loose.children:
                out.extend("  " + x if x else x for x in lines_of(loose, level, seen))
                loose = Node("div")
            lines = lines_of(child, level, seen)
            if lines:
                mark = f"{number}. " if ordered else "- "
                out.append(mark + lines[0])
                out.extend(" " * len(mark) + x if x else x for x in lines[1:])
            number += bool(child.children)
        else:
            loose.children.append(child)
    return out


def wide(line: str) -> int:
    """Columns that a line takes."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in line)


def span_of(node: Node, name: str, most: int) -> int:
    if name not in node.attrs.lower():
        return 1
    value = attributes(node.attrs).get(name, "").strip()
    digits = re.match(r"[0-9]+", value)
    if not digits or len(digits[0]) > 9:
        return most if digits else 1
    return min(int(digits[0]), most) or (most if name == "rowspan" else 1)


class Grid:
    """Cells at the columns that spans of earlier rows leave free."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.held: list[tuple[int, int, int]] = []  # (first column, column behind, last row) of cells that reach into later rows

    def add(self, cells: list[tuple[list[str], int, int]]) -> None:
        row, at, now = [], 0, len(self.rows)
        self.held = [h for h in self.held if h[2] >= now]
        new = []
        for lines, columns, rows in cells:
            k = max(bisect.bisect_right(self.held, (at, MOST_COLUMNS * len(self.held) + at + 1, 0)) - 1, 0)
            while k < len(self.held) and self.held[k][0] <= at:
                at = max(at, self.held[k][1])
                k += 1
            row.append((at, lines))
            if rows > 1:
                new.append((at, at + columns, now + rows - 1))
            at += columns
        self.held = sorted(self.held + new) if new else self.held
        self.rows.append(row)

    def lines(self) -> list[str]:
        width: dict[int, int] = defaultdict(int)
        for row in self.rows:
            for at, cell in row:
                width[at] = max(width[at], max(map(wide, cell), default=0))
        offset, place, before = {}, 0, -1
        for at in sorted(width):  # columns in which no cell starts leave one gap together
            place += 2 * (at > before + 1)
            offset[at] = place
            place += width[at] + 2
            before = at
        out = []
        for row in self.rows:
            for k in range(max((len(cell) for _, cell in row), default=0)):
                line, reach = [], 0
                for at, cell in row:
                    if k < len(cell) and cell[k]:
                        line.append(" " * (offset[at] - reach) + cell[k])
                        reach = offset[at] + wide(cell[k])
                out.append("".join(line).rstrip())
        return out


def table_lines(node: Node, level: int, seen: bool) -> list[str]:
    """Rows of padded cells; text outside of rows (captions, strays) comes first."""
    grid, before = Grid(), []

    def inner(child, seen: bool) -> list[str]:
        return lines_of(child if isinstance(child, Node) and child.tag in ("td", "th") else Node("div", children=[child]), level, seen)

    def row_of(children: list, seen: bool) -> None:
        cells = []
        for c in children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                cells.append((inner(c, seen), span_of(c, "colspan", MOST_COLUMNS), span_of(c, "rowspan", MOST_ROWS)))
            elif isinstance(c, Node) or c.strip():
                cells.append((inner(c, seen), 1, 1))
        if cells:
            grid.add(cells)

    stack = [(iter(shown(node)), seen, [])]
    while stack:
        rest, seen, loose = stack[-1]
        c = next(rest, None)
        if c is None:
            row_of(loose, seen)
            stack.pop()
            continue
        here = seen if isinstance(c, str) or c.seen is None else c.seen
        if isinstance(c, Node) and c.tag == "tr":
            row_of(shown(c), here)
        elif isinstance(c, Node) and c.tag in ("tbody", "thead", "tfoot", "colgroup"):
            stack.append((iter(shown(c)), here, []))
        elif isinstance(c, Node) and c.tag in ("td", "th"):
            loose.append(c)
        elif isinstance(c, Node) and c.tag != "col" or isinstance(c, str) and c.strip():
            before.extend(inner(c, seen))
    return before + grid.lines()


def render(markup: str | None) -> str:
    """All visible text of a page."""
    lines = lines_of(build(markup)) if markup else []
    first, last = 0, len(lines)
    while first < last and not lines[first]:
        first += 1
    while last > first and not lines[last - 1]:
        last -= 1
    return "\n".join(lines[first:last])


def _renderer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_parts(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: page_id, text, n_chars, n_lines, text_sha256."""
    two = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = two.schema["page_id"].dataType.simpleString()
    text = F.col("text")
    return two.mapInArrow(_renderer, f"page_id {kind}, text string").select(
        "page_id", "text", F.char_length(text).cast("long").alias("n_chars"),
        F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"), F.sha2(text, 256).alias("text_sha256"))
