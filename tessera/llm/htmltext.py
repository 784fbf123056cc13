"""Visible text of HTML pages by layout-aware rendering.

A tree builder closes elements that the markup leaves open (implied tags), visibility rules
drop what a browser does not show, and a renderer lays out blocks with their spacing, lists with
markers and indents, and tables with aligned cells, whose blocks keep their lines. Neither the
builder nor the renderer recurs, so no depth of a page is too large.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas svg math datalist noembed noframes".split())
SPACED = frozenset("p ul ol dl pre blockquote table h1 h2 h3 h4 h5 h6 figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd figcaption legend details summary tr caption option optgroup hgroup search center menu dir dialog".split())
CLOSES_P = (BLOCK - frozenset("html body tr option optgroup caption li dt dd legend figcaption".split())) | {"li", "dt", "dd"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption button object template html".split())

# Each of these is matched at one place and never gives characters back, so a page is read in linear time.
NAME = re.compile(r"</?[A-Za-z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
KEY = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACES = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Node:
    tag: str
    attrs: list[tuple[str, str]] = field(default_factory=list)
    children: list = field(default_factory=list)

    def attr(self, name: str) -> str | None:
        return next((html.unescape(v) for k, v in self.attrs if k == name), None)


def markup(source: str, at: int) -> tuple[int, int]:
    """Where the next tag, comment or declaration begins, and how long its opening is (0: none is left)."""
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            return at, 4
        if source.startswith(("<!", "<?"), at):
            return at, 2
        if m := NAME.match(source, at):
            return at, m.end() - at
        at += 1
    return len(source), 0


def attributes(source: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """Attributes of a tag from behind its name, where it ends (-1: the page ends first), and whether it ends with a slash."""
    found = []
    while True:
        at = GAP.match(source, at).end()
        if at >= len(source):
            return found, -1, False
        if source[at] == ">":
            return found, at + 1, source[at - 1] == "/"
        key = KEY.match(source, at)
        at, value = key.end(), ""
        if m := EQUALS.match(source, at):
            at = m.end()
            quote = source[at : at + 1]
            if quote and quote in "\"'":
                end = source.find(quote, at + 1)
                if end < 0:
                    return found, -1, False
                value, at = source[at + 1 : end], end + 1
            else:
                bare = BARE.match(source, at)
                value, at = bare[0], bare.end()
        found.append((key[0].lower(), value))


def build(source: str) -> Node:
    """The tree of a page; end tags that match nothing are left out, and so is a tag or comment that the page's end cuts short."""
    root = Node("html")
    stack, at, n = [root], 0, len(source)
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack, without the root

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(html.unescape(part))

    def top(tags: frozenset | set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def close(tags: set[str], stop: frozenset | set[str]) -> None:
        while (i := top(tags)) and i >= top(stop):
            cut(i)

    while at < n:
        begin, size = markup(source, at)
        text(source[at:begin])
        if not size:
            break
        opening = source[begin : begin + size]
        at = begin + size
        if opening.startswith(("<!", "<?")):
            end = source.find("-->" if size == 4 else ">", at)
            at = end + (3 if size == 4 else 1) if end >= 0 else n
            continue
        attrs, at, slash = attributes(source, at)
        if at < 0:
            break
        tag = opening.lstrip("</").lower()
        if opening[1] == "/":
            if tag == "p" and not places["p"]:
                stack[-1].children.append(Node("p"))
            i = top({tag})
            if i and (tag in ("table", "tbody", "thead", "tfoot", "tr", "body", "html") or i >= top(SCOPE)):
                cut(i)
            continue
        if tag in ("html", "body"):
            stack[0].attrs += attrs if tag == "body" else []
            if places["head"]:
                cut(1)
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID or slash and tag not in BLOCK | UNSEEN:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            inner = source[at : end.start() if end else n]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else n
        else:
            places[tag].append(len(stack))
            stack.append(node)
    return root


def seen(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    if not node.attrs:
        return True
    if node.attr("hidden") is not None and (node.attr("hidden") or "").lower() != "until-found":
        return False
    style = node.attr("style")
    return not (style and HIDING.search(style))


class Page:
    """Lines of text with collapsed white space; ``gap`` is how many line ends come before the next text."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.blank, self.prefix = 0, False, []

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)
        self.blank = False

    def put(self, s: str) -> None:
        if self.gap or not self.out:
            if self.out:
                self.out.append("\n" * self.gap)
            self.out.append("".join(self.prefix))
            self.prefix = [" " * len(p) for p in self.prefix]
            self.gap = 0
        elif self.blank:
            self.out.append(" ")
        self.blank = False
        self.out.append(s)

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, line in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.gap += 1
                if line:
                    self.put(line)
            return
        words = SPACES.sub(" ", s)
        if words.startswith(" "):
            self.blank = not self.gap and bool(self.out)
        body = words.strip(" ")
        if body:
            self.put(body)
            self.blank = words.endswith(" ")

    def result(self) -> str:
        return "\n".join(x.rstrip() for x in "".join(self.out).split("\n")).strip("\n")


#: What is left of a step of rendering; it gives the steps that come in between.
Steps = Iterator["Steps"]


def done(steps: Steps) -> None:
    """Work off a step and all that it gives, with a stack of our own."""
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def render(node: Node, page: Page, pre: bool = False) -> Steps:
    for child in node.children:
        if isinstance(child, str):
            page.text(child, pre)
            continue
        if not seen(child):
            continue
        tag = child.tag
        if tag == "br":
            page.gap, page.blank = page.gap + 1, False
        elif tag == "hr":
            page.block(2)
        elif tag == "img":
            if child.attr("alt"):
                page.text(child.attr("alt"), False)
        elif tag == "input":
            if (child.attr("type") or "text").lower() in ("submit", "button", "reset", "text") and child.attr("value"):
                page.text(child.attr("value"), False)
        elif tag == "table":
            page.block(2)
            yield table(child, page)
            page.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if page.prefix else 2)
            yield items(child, page, pre)
            page.block(1 if page.prefix else 2)
        elif tag == "li":
            yield item(child, page, "- ", pre)
        elif tag == "dd":
            yield item(child, page, "    ", pre)
        elif tag == "blockquote":
            page.block(2)
            page.prefix.append("> ")
            yield render(child, page, pre)
            page.prefix.pop()
            page.block(2)
        elif tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            page.block(gap)
            yield render(child, page, pre or tag == "pre")
            page.block(gap)
        else:
            yield render(child, page, pre or tag == "textarea")


def item(node: Node, page: Page, mark: str, pre: bool) -> Steps:
    page.block(1)
    page.prefix.append(mark)
    yield render(node, page, pre)
    page.prefix.pop()
    page.block(1)


def items(node: Node, page: Page, pre: bool) -> Steps:
    start = node.attr("start") if node.tag == "ol" else None
    n = int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li" and seen(child):
            yield item(child, page, f"{n}. " if node.tag == "ol" else "- ", pre)
            n += 1
        else:
            yield render(Node("div", [], [child]), page, pre)


def cell(node: Node, lines: list[str]) -> Steps:
    page = Page()
    yield render(node, page)
    lines.extend(page.result().split("\n"))


def span(node: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan, up to the standard's largest; 1 where it is no number."""
    x = (node.attr(name) or "").strip()
    return min(int(x), most) if re.fullmatch("[0-9]{1,9}", x) else 1


class Grid:
    """Cells by row and column. Columns that a cell of an earlier row reaches down into are skipped."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.taken: list[tuple[int, int, int]] = []  # from, to and last row of cells that reach down
        self.fresh: list[tuple[int, int, int]] = []

    def section(self) -> None:
        self.taken, self.fresh = [], []

    def row(self) -> None:
        self.rows.append([])
        now = len(self.rows) - 1
        if self.fresh:
            kept: list[tuple[int, int, int]] = []
            for a, b, last in sorted([x for x in self.taken if x[2] >= now] + self.fresh):
                if kept and kept[-1][1] == a and kept[-1][2] == last:
                    a = kept.pop()[0]
                kept.append((a, b, last))
            self.taken, self.fresh = kept, []
        self.column = self.next = 0

    def cell(self, cols: int, rows: int) -> list[str]:
        if not self.rows:
            self.row()
        now = len(self.rows) - 1
        while self.next < len(self.taken) and self.taken[self.next][0] <= self.column:
            if self.taken[self.next][2] >= now:
                self.column = max(self.column, self.taken[self.next][1])
            self.next += 1
        lines: list[str] = []
        self.rows[-1].append((self.column, lines))
        if rows != 1:
            self.fresh.append((self.column, self.column + cols, now + rows - 1 if rows else 1 << 30))
        self.column += cols
        return lines

    def lines(self) -> Iterator[str]:
        """Padded lines. Columns in which no cell begins take no room."""
        at = {c: i for i, c in enumerate(sorted({c for r in self.rows for c, _ in r}))}
        widths = [0] * len(at)
        for c, own in (x for r in self.rows for x in r):
            widths[at[c]] = max(widths[at[c]], *map(len, own))
        for r in self.rows:
            if any(any(own) for _, own in r):
                for i in range(max(len(own) for _, own in r)):
                    parts = [""] * (at[r[-1][0]] + 1)
                    for c, own in r:
                        parts[at[c]] = own[i] if i < len(own) else ""
                    yield " | ".join(x.ljust(w) for x, w in zip(parts, widths)).rstrip()


def table(node: Node, page: Page) -> Steps:
    """Rows of cells, padded to the width of their column, a line for each line of the longest cell; what stands in a
    table outside of cells comes before it. A cell stands in the first of the rows and columns that it spans."""
    grid = Grid()
    todo = list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip():
                page.text(child, False)
                page.block(1)
        elif not seen(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            grid.section()
            todo.extend(reversed(child.children))
        elif child.tag == "tr":
            grid.row()
            todo.extend(reversed(child.children))
        elif child.tag in ("td", "th"):
            yield cell(child, grid.cell(max(1, span(child, "colspan", 1000)), span(child, "rowspan", 65534)))
        else:
            yield render(Node("div", [], [child]), page)
            page.block(1)
    for line in grid.lines():
        page.block(1)
        page.put(line)


def visible_text(source: str) -> str:
    page = Page()
    done(render(build(source), page))
    return page.result()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars, n_lines) for every page. Null, empty and invisible pages give an empty text of no lines;
    repeated rows give a row each; other columns are ignored."""

    def work(batches):
        for b in batches:
            got = [visible_text(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in got], pa.int64())], names=list("abcd"))

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(work, f"`{id_col}` {kind}, text string, n_chars bigint, n_lines bigint")
