"""Layout-aware text of HTML pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: element categories and implied end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist".split())
#: Elements of drawings and formulas, and those of their parts that aren't shown where they stand.
FOREIGN = frozenset(["svg", "math"])
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption colgroup thead tbody tfoot tr td th ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure hr".split())
CLOSES_P = BLOCK - frozenset("html body li dd dt option optgroup td th tr thead tbody tfoot caption colgroup legend summary".split())
#: What an opening tag ends, and the ancestors that stop the search for it.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
}
_TABLE_PARTS = frozenset("table thead tbody tfoot".split())
_SCOPE = frozenset("table td th caption button object".split())
#: A comment, a declaration, or a tag, which ends with the text if it isn't closed. Nothing is tried twice, so it takes linear time.
_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z))", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
#: How deep the tree may be; what is deeper stands in the element at this depth.
_DEPTH = 500
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
#: A table isn't aligned if that makes it longer than 4096 characters and than so many times its visible ones.
_PADDING = 32
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element with its children: nodes and strings.

    A hidden one isn't rendered at all; one without `seen` keeps its place, and its own text is left out.
    Of a closed one only the summary is shown.
    """

    __slots__ = ("name", "children", "hidden", "seen", "start", "spans", "closed")

    def __init__(self, name: str, hidden: bool = False, start: int = 1, seen: bool = True, spans: tuple[int, int] = (1, 1)):
        self.name, self.hidden, self.start, self.seen, self.spans, self.children, self.closed = name, hidden, start, seen, spans, [], False


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) if v else "" for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def build_tree(source: str) -> Node:
    """The element tree of a page; unclosed, misnested and unopened tags are accepted."""
    root = Node("html")
    stack, at = [root], 0
    count = Counter(["html"])

    def add(text: str) -> None:
        if stack[-1].seen:
            stack[-1].children.append(text)

    def push(node: Node) -> None:
        stack.append(node)
        count[node.name] += 1

    def cut(depth: int) -> None:
        gone = [n.name for n in stack[depth:]]
        count.subtract(gone)
        del stack[depth:]
        if depth >= _DEPTH and not BLOCK.isdisjoint(gone):
            stack[-1].children.append(Node("div"))  # ends the line

    def place(node: Node) -> None:
        """Put a node into the innermost element; one that is too deep shares its children, or if hidden leaves the tree."""
        if len(stack) < _DEPTH or node.name in VOID:
            stack[-1].children.append(node)
        elif not node.hidden:
            if node.name in BLOCK:
                stack[-1].children.append(Node("div"))
            node.children = stack[-1].children

    def close(names: frozenset[str], stops: frozenset[str]) -> None:
        if not any(count[n] for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in stops:
                return
            if stack[depth].name in names:
                cut(depth)
                if not any(count[n] for n in names if n != "p"):
                    return

    # Each search starts where the last tag or raw element ended: what looks like a tag inside a raw element is its text.
    while match := _TAG.search(source, at):
        if match.start() > at:
            add(source[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        name = match[2].lower()
        if match[1]:
            if name == "p" and not count["p"]:
                stack[-1].children.append(Node("p"))
            for depth in range(len(stack) - 1, 0, -1) if count[name] else ():
                if stack[depth].name == name:
                    cut(depth)
                    break
                if stack[depth].name in _SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if name in ("html", "body") and count[name]:
            continue
        if count["head"] and (name == "body" or name in BLOCK):
            cut(next(i for i, n in enumerate(stack) if n.name == "head"))
        if name in CLOSES_P:
            close(frozenset(["p"]), _SCOPE)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ("td", "th") and stack[-1].name in _TABLE_PARTS:
            row = Node("tr", seen=stack[-1].seen)
            place(row)
            push(row)
        attributes = _attributes(match[3])
        foreign = name in FOREIGN or count["svg"] > 0 or count["math"] > 0
        hidden = (
            name in HIDDEN
            or name in UNDRAWN and foreign
            or "hidden" in attributes
            or name == "dialog" and "open" not in attributes
            or name == "input" and attributes.get("type", "").lower() == "hidden"
            or bool(_UNSEEN.search(attributes.get("style", "")))
        )
        start = attributes.get("start", "1")
        shown = _VISIBILITY.findall(attributes.get("style", ""))
        spans = tuple(int(n) if re.fullmatch(r"[1-9]\d{0,3}", n) else 1 for n in (attributes.get("colspan", ""), attributes.get("rowspan", "")))
        node = Node(
            name, hidden, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, shown[-1].lower() == "visible" if shown else stack[-1].seen, spans
        )
        node.closed = name == "details" and "open" not in attributes
        place(node)
        if foreign and match[3].endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            if node.seen:
                node.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif name == "form" and (stack[-1].name == "tr" or stack[-1].name in _TABLE_PARTS):
            continue  # a form around rows or cells holds nothing
        elif name not in VOID:
            push(node)
    if at < len(source):
        add(source[at:])
    return root


class _Lines:
    """Collects inline text into lines with collapsed white space."""

    def __init__(self):
        self.lines: list[str] = []
        self._parts: list[str] = []
        self._blank = self._keep = False

    def text(self, words: str, keep: bool) -> None:
        if keep:
            for i, line in enumerate(words.split("\n")):
                if i:
                    self.end(True)
                self._parts.append(line)
                self._keep = True
        else:
            self._parts.append(_SPACE.sub(" ", words))

    def end(self, keep: bool = False) -> None:
        line = "".join(self._parts)
        line = line.rstrip() if self._keep else _SPACE.sub(" ", line).strip(" ")
        self._parts, self._keep = [], False
        if line or keep:
            if self._blank and self.lines:
                self.lines.append("")
            self._blank = False
            self.lines.append(line)

    def gap(self) -> None:
        self.end()
        self._blank = True

    def block(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.end()
        for i, line in enumerate(lines):
            if self._blank and self.lines:
                self.lines.append("")
            self._blank = False
            self.lines.append(((first if i == 0 else rest) + line).rstrip() if line or i == 0 else "")


def _rows(table: Node) -> Iterator[Node]:
    for child in table.children:
        if isinstance(child, Node) and not child.hidden:
            if child.name == "tr":
                yield child
            elif child.name in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _outside_rows(table: Node) -> Iterator[Node | str]:
    """What a table and its sections hold besides rows."""
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                yield child
        elif not child.hidden:
            if child.name in ("thead", "tbody", "tfoot", "colgroup"):
                yield from _outside_rows(child)
            elif child.name != "tr" or table.name == "colgroup":
                yield child


def _grid(table: Node) -> list[list[list[str]]]:
    """The cells' lines by row and column; what a cell spans besides its first place is empty."""
    grid: list[list[list[str]]] = []
    taken: dict[int, int] = {}  # column: how many further rows a cell above reaches into
    for row in _rows(table):
        own: list[list[str]] = []

        def skip() -> None:
            while taken.get(len(own), 0) > 0:
                taken[len(own)] -= 1
                own.append([])

        for cell in row.children:
            if isinstance(cell, Node) and cell.name in ("td", "th") and not cell.hidden:
                skip()
                across, down = cell.spans
                for i in range(min(across, 1000)):
                    if down > 1:
                        taken[len(own)] = down - 1
                    own.append(_render(cell.children) if i == 0 else [])
        for column in range(len(own), max(taken, default=-1) + 1):
            if taken.get(column, 0) > 0:
                taken[column] -= 1
        grid.append(own)
    return grid


def _table(node: Node, out: _Lines) -> None:
    """Cells of a row share lines, each column as wide as its widest cell. What is outside of rows comes before.

    Columns without any text take no room. A table that alignment would blow up (_PADDING) has its
    cells two spaces apart instead, so what comes out is bounded by a multiple of the text in it.
    """
    _render(list(_outside_rows(node)), out)
    out.end()
    grid = _grid(node)
    for row in _rows(node):
        stray = [c for c in row.children if not (isinstance(c, Node) and c.name in ("td", "th")) and not (isinstance(c, str) and not c.strip())]
        if stray:
            out.block(_render(stray))
    widths: dict[int, int] = {}
    height = visible = 0
    for row in grid:
        height += max(map(len, row), default=0)
        for i, cell in enumerate(row):
            if cell:
                widths[i] = max(widths.get(i, 0), *map(len, cell))
                visible += sum(len(line) - line.count(" ") for line in cell)
    columns = sorted(i for i, width in widths.items() if width)
    padded = height * sum(widths[i] + 2 for i in columns)
    aligned = padded <= max(4096, _PADDING * visible)
    for row in grid:
        cells = [(row[i] if i < len(row) else [], widths[i]) for i in columns] if aligned else [(cell, 0) for cell in row if cell]
        lines = range(max((len(cell) for cell, _ in cells), default=0))
        parts = ([(cell[i] if i < len(cell) else "", width) for cell, width in cells] for i in lines)
        out.block(["  ".join(text.ljust(width) for text, width in line if aligned or text).rstrip() for line in parts])


def _render(children: list, out: _Lines | None = None, keep: bool = False) -> list[str]:
    """The lines of some nodes."""
    own = out is None
    out = _Lines() if own else out
    for child in children:
        if isinstance(child, str):
            out.text(html.unescape(child), keep)
            continue
        if child.hidden:
            continue
        name = child.name
        if name == "br":
            out.end(True)
        elif name == "hr":
            out.gap()
        elif name == "table":
            out.gap()
            _table(child, out)
            out.gap()
        elif name in ("ul", "ol", "menu", "dir"):
            out.gap() if own or name in SPACED else out.end()
            number = child.start
            for item in child.children:
                if isinstance(item, Node) and item.name == "li" and not item.hidden:
                    mark = f"{number}. " if name == "ol" else "- "
                    number += 1
                    lines = [line for line in _render(item.children) if line]
                    out.block(lines or [""], mark, " " * len(mark))
                else:
                    _render([item], out, keep)
            out.gap()
        elif name == "dd":
            out.block(_render(child.children), "  ", "  ")
        elif name == "blockquote":
            out.gap()
            out.block(_render(child.children), "> ", "> ")
            out.gap()
        elif name == "mfrac":
            for i, part in enumerate(c for c in child.children if isinstance(c, Node)):
                out.text("/" if i else "", False)
                _render([part], out, keep)
        elif name in BLOCK or name in ("textarea", "text"):
            out.gap() if name in SPACED else out.end()
            shown = [c for c in child.children if isinstance(c, Node) and c.name == "summary"] if child.closed else child.children
            _render(shown, out, keep or name in ("pre", "textarea"))
            out.gap() if name in SPACED else out.end()
        else:
            _render(child.children, out, keep)
    if own:
        out.end()
        while out.lines and not out.lines[-1]:
            out.lines.pop()
        return out.lines
    return []


def page_text(source: str | None) -> str:
    """All visible text of a page; the empty text for null."""
    if not isinstance(source, str) or not source:
        return ""
    return "\n".join(_render(build_tree(source).children))


def extract_text(pages: DataFrame, column: str = "text") -> DataFrame:
    """`pages` (html and any other columns) with the page's visible text in `column`.

    Blocks are on lines of their own; paragraphs, headings, lists and tables are set off by an empty
    line; list items are marked and indented; table cells are aligned. Null and empty html give an
    empty text; whatever isn't HTML is text.
    """

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield sources.map(page_text, na_action=None).astype(object)

    return pages.withColumn(column, text_of(F.col("html")))


def op1_html_text(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of every page."""
    return extract_text(pages.select("page_id", "html")).select("page_id", "text")
