"""HTML to text by layout: a tree with implied tags, visibility rules, and rendering of blocks, lists and tables.

The tree builder closes what HTML lets authors leave open (paragraphs, list items, cells, rows, options,
terms) and keeps elements at a depth of ``DEPTH`` at most, as browsers do; what lies deeper becomes a sibling.
Text or a tag that has no place in the head ends it. Hidden are the head, scripts, styles, templates, what stands for audio,
video and canvas where they cannot be shown, the annotations of formulas (the same in another notation), the titles,
descriptions and metadata of drawings, and the like, the ``hidden`` attribute, inline
``display:none`` and ``visibility:hidden``, dialogs and details that are not open (their summary shows).
All other text is emitted: blocks on lines of their own, paragraphs, headings, lists and tables set off by
an empty line, list items with a dash or their number and indented by depth, preformatted text as it is,
table cells padded to the width of their column and parted by two spaces (cells with several lines keep them; those that
span rows or columns take their places in all of them). Cells of over ``WIDE`` characters do not widen their column, and a table that
padding would make over ``MOST_PADDED`` times as long as what it says is not padded: the text of a page is bounded by the page.

Cases: null and empty pages give empty text; broken markup never fails: an unclosed comment or raw element
runs to the end, a lone ``<`` is text; equal pages of one batch are rendered once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 256
WIDE = 100
MOST_PADDED = 8
#: Columns from which on cells reach into no further row.
COLUMNS = 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes title textarea xmp".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title meta link base datalist audio video canvas area param source track".split())
#: What the head may hold; any other tag ends it.
IN_HEAD = frozenset("script style template noscript noframes title meta link base basefont bgsound head html".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul xmp".split())
#: Tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html li dd dt caption option optgroup legend summary".split()) | {"li", "dd", "dt", "summary"}
TABLE = frozenset("table caption colgroup col thead tbody tfoot tr td th".split())
#: What a start tag closes, and the elements at which the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
#: Tags that are hidden in drawings or formulas only.
UNSEEN = {"desc": "svg", "metadata": "svg", "annotation": "math", "annotation-xml": "math"}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(said: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if said.strip("/ \n\t\r\f"):
        for m in _ATTR.finditer(said):
            out.setdefault(m[1].lower(), unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


def tree(html: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    at, n = 0, len(html)
    unended: set[str] = set()  # ends that are known not to follow

    def find(what: str, start: int) -> int:
        if what in unended:
            return -1
        found = html.find(what, start)
        if found < 0:
            unended.add(what)
        return found

    def text(said: str) -> None:
        if said:
            while stack[-1].tag == "head" and said.strip(" \t\n\r\f"):
                stack.pop()  # text begins the body
            stack[-1].children.append(unescape(said) if "&" in said else said)

    def foreign() -> str:
        """svg or math where the next tag is one of theirs, else empty."""
        tag = next((x.tag for x in reversed(stack) if x.tag in ("svg", "math", "foreignobject")), "")
        return "" if tag == "foreignobject" else tag

    def close(names, stops) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return close(names, stops)
            if stack[i].tag in stops or stack[i].tag in TABLE and not (names & TABLE):
                return None
        return None

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        if html.startswith("<!--", lt):
            end = find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(html, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        gt = find(">", m.end())
        if gt < 0:
            break  # an unfinished tag at the end shows nothing
        said = html[m.end() : gt]
        if '"' in said or "'" in said:
            full = _REST.match(html, m.end())
            if full:
                gt = full.end() - 1
                said = html[m.end() : gt]
        tag, at = m[1].lower(), gt + 1
        if html[lt + 1] == "/":
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in TABLE:
                    break
            continue
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if re.fullmatch("h[1-6]", tag):
            close({f"h{i}" for i in range(1, 7)} & {stack[-1].tag}, set())
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        while stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(row := Node("tr", {}))
            stack.append(row)
        node = Node(tag, attributes(said))
        if tag in UNSEEN and foreign() == UNSEEN[tag]:
            node.attrs["hidden"] = ""
        stack[-1].children.append(node)
        if tag in RAW:
            low = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at) if f"</{tag}" not in unended else None
            if low is None:
                unended.add(f"</{tag}")
            end = low.start() if low else n
            if tag in ("textarea", "xmp"):
                node.children.append(unescape(html[at:end]) if tag == "textarea" else html[at:end])
            at = find(">", end) + 1 if low else n
            at = at or n
        elif tag not in VOID and not (said.endswith("/") and (tag in ("svg", "math") or foreign())) and len(stack) < DEPTH:
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "input":
        return node.attrs.get("type", "").lower() in ("submit", "button", "reset")
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    style = node.attrs.get("style")
    return not (style and _STYLE.search(style))


class Lines:
    """Lines of output under way: words flow, blocks start new lines, gaps become one empty line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def flow(self, said: str) -> None:
        words = _SPACE.split(said)
        if len(words) == 1 and words[0]:
            self.put(words[0])
            return
        if not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            self.put(body)
            self.space = not words[-1]

    def put(self, said: str) -> None:
        if self.gap and not self.now:
            if self.lines:
                self.lines.append("")
            self.gap = False
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        self.now.append(said)

    def end(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False

    def block(self, lines: list[str]) -> None:
        self.end()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines


def render(node: Node, out: Lines, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if pre:
                parts = child.replace("\r\n", "\n").split("\n")
                for i, part in enumerate(parts):
                    if i:
                        out.lines.append("".join(out.now)) if out.now or out.lines else None
                        out.now = []
                    if part:
                        out.put(part)
            else:
                out.flow(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            if out.now:
                out.end()
            elif out.lines:
                out.gap = True
        elif tag == "hr":
            out.end()
            out.gap = True
            out.block(["---"])
            out.gap = True
        elif tag == "input":
            out.flow(f" {child.attrs.get('value', '')} ")
        elif tag == "table":
            out.end()
            out.gap = True
            out.block(table(child))
            out.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            out.end()
            nested = node.tag in ("li", "ul", "ol")
            out.gap |= not nested
            out.block(listing(child))
            out.gap |= not nested
        elif tag == "details" and "open" not in child.attrs:
            out.end()
            shut = Node("div", {})
            shut.children = [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]
            render(shut, out)
            out.end()
        elif tag in BLOCK:
            out.end()
            out.gap |= tag in SPACED
            inner = Lines()
            render(child, inner, pre or tag in ("pre", "xmp", "textarea"))
            inner.end()
            indent = "  " if tag in ("blockquote", "dd") else ""
            out.block([indent + x if x else x for x in inner.lines])
            out.gap |= tag in SPACED
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):  # parts of a table without one
            out.flow(" ")
            render(child, out, pre)
            out.flow(" ")
            if tag == "tr":
                out.end()
        elif tag in ("text", "mtr", "mtd") or node.tag == "mfrac":  # apart in drawings and formulas
            out.flow(" ")
            render(child, out, pre)
            out.flow(" ")
        else:
            render(child, out, pre or tag == "textarea")


def rendered(node: Node) -> list[str]:
    out = Lines()
    render(node, out)
    out.end()
    return out.lines


def listing(node: Node) -> list[str]:
    lines: list[str] = []
    number = node.attrs.get("start", "1")
    number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    loose = Node("div", {})
    for child in [*node.children, None]:
        item = isinstance(child, Node) and child.tag == "li"
        if (item or child is None) and loose.children:
            lines += rendered(loose)
            loose = Node("div", {})
        if item:
            if not visible(child):
                continue
            value = child.attrs.get("value", "")
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            own = [x for x in rendered(child) if x] or [""]
            lines += [(mark + own[0]).rstrip(), *(" " * len(mark) + x for x in own[1:])]
        elif child is not None:
            loose.children.append(child)
    return lines


def spanned(cell: Node, name: str) -> int:
    """colspan, or rowspan (0 is to the end of the rows), as far as HTML lets them go."""
    said = cell.attrs.get(name, "1")
    n = int(said) if said.isdecimal() and len(said) < 9 else 1
    return min(n, 65534) if n or name == "rowspan" else 1


def table(node: Node) -> list[str]:
    rows: list[list[tuple[list[str], int, int]]] = []
    lines: list[str] = []
    after: list[str] = []

    def gather(part: Node) -> None:
        loose = Node("div", {})
        for child in part.children:
            if isinstance(child, str) or child.tag not in TABLE:
                loose.children.append(child)
            elif not visible(child):
                continue
            elif child.tag == "caption":
                lines.extend(rendered(child))
            elif child.tag in ("tbody", "thead", "tfoot", "colgroup"):
                gather(child)
            elif child.tag != "tr":  # a table or cell that markup has put here
                loose.children.append(child)
            else:
                row, extra = [], Node("div", {})
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        if visible(cell):
                            row.append((rendered(cell) or [""], min(1000, spanned(cell, "colspan")), spanned(cell, "rowspan") or 65534))
                    else:
                        extra.children.append(cell)
                rows.append(row)
                after.extend(rendered(extra))
        lines.extend(rendered(loose))  # text between rows is shown before the table

    gather(node)
    return lines + grid(rows) + after


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of rows of cells (lines, columns, rows that they span)."""
    placed: list[list[tuple[int, list[str], int]]] = []  # (first column, lines, columns) of each row
    taken: list[tuple[int, int, int]] = []  # first column, columns and rows left of cells that reach into the next row
    for row in rows:
        own, at, k = [], 0, 0
        for said, wide, high in row:
            while k < len(taken) and taken[k][0] < at + 1:
                at = max(at, taken[k][0] + taken[k][1])
                k += 1
            own.append((at, said, wide, high))
            at += wide
        placed.append([x[:3] for x in own])
        taken = sorted([(c, n, left - 1) for c, n, left in taken if left > 1] + [(c, n, high - 1) for c, _, n, high in own if high > 1 and c < COLUMNS])
    width: dict[int, int] = {}
    for own in placed:
        for at, said, wide in own:
            if wide == 1:
                width[at] = max(width.get(at, 0), *(len(x) if len(x) <= WIDE else 0 for x in said))
    first = dict(zip(sorted(width), [0, *_sums(width[c] + 2 for c in sorted(width))], strict=False))  # where a column begins
    left = lambda c: first.get(c, 0)
    words = sum(len(x) for own in placed for _, said, _ in own for x in said)
    padded = sum(max((left(at) for at, _, _ in own), default=0) * max((len(said) for _, said, _ in own), default=0) for own in placed)
    aligned = padded <= MOST_PADDED * words + 1000
    lines = []
    for own in placed:
        for i in range(max((len(said) for _, said, _ in own), default=0)):
            line = ""
            for at, said, _ in own:
                cell = said[i] if i < len(said) else ""
                if aligned and cell:
                    line = line.ljust(left(at))
                if cell:
                    line += ("" if not line or line.endswith("  ") else " " if line.endswith(" ") else "  ") + cell
            lines.append(line.rstrip())
    return lines


def _sums(values: Iterable[int]) -> Iterator[int]:
    total = 0
    for v in values:
        total += v
        yield total


def text(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    if sys.getrecursionlimit() < 20 * DEPTH:
        sys.setrecursionlimit(20 * DEPTH)
    return "\n".join(x.rstrip() for x in rendered(tree(html)))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of each row."""

    def run(batches):
        for batch in batches:
            ids, said, seen, size = [], [], {}, 0
            for i, html in zip(batch.column(0), batch.column(1), strict=True):
                html = html.as_py()
                if html not in seen:
                    seen[html] = text(html)
                ids.append(i)
                said.append(seen[html])
                size += len(seen[html])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], batch.column(0).type), pa.array(said, pa.string())], names=["page_id", "text"])
                    ids, said, seen, size = [], [], {}, 0
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], batch.column(0).type), pa.array(said, pa.string())], names=["page_id", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
