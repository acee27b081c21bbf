"""HTML extraction: build a tree with implied tags, drop what is not visible, lay out the rest as text."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from . import common

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object canvas audio video datalist".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section".split())
#: An opening tag -> the open tags it ends, and the tags beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "caption", "legend", "summary"}
UNDISPLAYED = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Kinds of input whose value is shown.
VALUED = frozenset(("", "text", "search", "email", "tel", "url", "number", "submit", "button", "reset"))
SPACES = re.compile(r"[ \t\n\r\f]+")
#: What may be inside head; any other tag, and text, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Parts of drawings and formulas that are not drawn, by the tag they are in.
UNDRAWN = dict.fromkeys("defs desc metadata symbol clippath mask marker pattern".split(), "svg") | dict.fromkeys(("annotation", "annotation-xml"), "math")
#: Texts that stand beside each other without a space of their own.
APART = frozenset("option optgroup text".split())
#: Parts of a table that hold rows.
GROUPS = frozenset("tbody thead tfoot colgroup form".split())
# The columns and rows that a cell may take at most, as HTML has it.
COLUMNS, ROWS = 1000, 65534
#: Width of a line beyond which it does not widen its column, and how much longer than its text a table may become by aligning.
WIDE, STRETCH = 60, 4


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class TreeBuilder(HTMLParser):
    """Tags and text -> tree; start and end tags that HTML lets authors omit are implied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # places of open tags, so that deep pages are not searched for them

    def _last(self, names) -> int:
        """Place of the innermost open tag of these, 0 for none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.at[node.tag].pop()
        del self.open[i:]

    def _close_until(self, names, fence) -> None:
        while (i := self._last(names)) > self._last(fence):
            self._cut(i)
            if len(names) == 1:
                return

    def handle_starttag(self, tag, attrs):
        if self.open[-1].tag == "head" and tag not in HEAD:
            self._cut(len(self.open) - 1)
        if tag in ENDS_P:
            self._close_until({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if tag in ENDS:
            self._close_until(*ENDS[tag])
        parent = self.open[-1].tag
        if tag in ("td", "th") and parent in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        attrs = {k: v or "" for k, v in attrs}
        if tag in UNDRAWN and self._last((UNDRAWN[tag],)):
            attrs["hidden"] = ""
        if tag in VOID:
            self.open[-1].children.append(Node(tag, attrs))
        else:
            self._push(tag, attrs)

    def _push(self, tag, attrs):
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._last(("svg", "math")):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        i, fence = self._last((tag,)), 0 if tag in BLOCK else self._last(("table", "td", "th"))
        if i and i >= fence:
            self._cut(i)
        elif tag == "br" and not fence:
            self.open[-1].children.append(Node("br"))

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    """The node takes part in the layout."""
    a = node.attrs
    return not (node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() not in VALUED) or UNDISPLAYED.search(a.get("style", "")))


def prune(root: Node) -> None:
    """Leave what is seen: no text where visibility is hidden, which what is inside may turn back on, and of closed details the summary alone."""
    stack = [(root, True)]
    while stack:
        node, seen = stack.pop()
        if node.tag == "details" and "open" not in node.attrs:
            node.children = next(([c] for c in node.children if isinstance(c, Node) and c.tag == "summary"), [])
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if seen:
                    kept.append(c)
            elif visible(c):
                set_ = VISIBILITY.findall(c.attrs.get("style", ""))
                own = set_[-1].lower() == "visible" if set_ else seen
                if own or c.tag not in ("img", "input"):
                    kept.append(c)
                    stack.append((c, own))
        node.children = kept


def cell_width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Layout:
    """Lines of visible text; blocks start lines, spaced blocks leave one empty line around them."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if not self.line or self.line.endswith(" "):
            s = s.lstrip(" ")
        self.line += s

    def end_line(self) -> None:
        s, self.line = self.line.rstrip(" "), ""
        if s:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(s)

    def space(self) -> None:
        self.end_line()
        self.gap = True

    def raw(self, lines: list[str]) -> None:
        for s in lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(s)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def run(task) -> None:
    """Run a generator and those it yields, innermost first, so that depth costs no stack."""
    stack = [task]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def render(children: list, out: Layout, nested: bool = False):
    for child in children:
        if isinstance(child, str):
            out.text(child)
        elif not visible(child):
            continue
        elif child.tag == "br":
            if out.line:
                out.end_line()
            else:
                out.gap = out.gap or bool(out.lines)
        elif child.tag == "hr":
            out.space()
        elif child.tag == "img":
            if child.attrs.get("alt"):
                out.text(child.attrs["alt"])
        elif child.tag == "input":
            out.text(f" {child.attrs.get('value', '')} ")
        elif child.tag == "pre":
            out.space()
            parts: list[str] = []
            yield plain(child, parts)
            out.raw([x.rstrip() for x in "".join(parts).strip("\n").split("\n")])
            out.space()
        elif child.tag == "table":
            out.space()
            yield render_table(child, out)
            out.space()
        elif child.tag in ("ul", "ol"):
            yield render_list(child, out, nested)
        elif child.tag in BLOCK:
            (out.space if child.tag in SPACED else out.end_line)()
            yield render(child.children, out, nested)
            (out.space if child.tag in SPACED else out.end_line)()
        elif child.tag in APART:
            out.text(f" {child.attrs.get('label', '')} " if child.tag == "optgroup" else " ")
            yield render(child.children, out, nested)
            out.text(" ")
        else:
            yield render(child.children, out, nested)


def plain(node: Node, parts: list[str]):
    for c in node.children:
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append("\n")
        elif visible(c):
            yield plain(c, parts)


def render_list(node: Node, out: Layout, nested: bool):
    (out.end_line if nested else out.space)()
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            yield render([child], out, nested)
            continue
        if not visible(child):
            continue
        inner = Layout()
        yield render(child.children, inner, True)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        out.end_line()
        out.raw([(mark if i == 0 else " " * len(mark)) + s if s else s for i, s in enumerate(inner.done() or [""])])
    (out.end_line if nested else out.space)()


def table_parts(table: Node) -> tuple[list, list[tuple[Node, Node]]]:
    """What is in a table but not in its rows, and its rows with their groups."""
    loose, rows, stack = [], [], [(table, table, iter(table.children))]
    while stack:
        holder, group, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            loose.append(child)
        elif not visible(child):
            continue
        elif child.tag == "tr":
            rows.append((group, child))
        elif child.tag in GROUPS:
            stack.append((child, group if child.tag in ("form", "colgroup") else child, iter(child.children)))
        elif child.tag != "col":
            loose.append(child)
    return loose, rows


def render_table(node: Node, out: Layout):
    """Cells of a column start at the same column of text; a cell of several lines takes several rows.

    A cell that spans rows keeps its columns empty in the rows below, to the end of their group.
    A line of over WIDE characters pushes what follows it aside and does not widen its column. A
    table that would become over STRETCH times as long as its text is not aligned.
    """
    loose, found = table_parts(node)
    for child in loose:
        yield render([child], out)
    out.end_line()
    rows: list[dict[int, list[str]]] = []  # column -> lines of the cell that starts there
    left = [0] * len(found)  # rows of a row's group from it on
    for i in range(len(found) - 1, -1, -1):
        left[i] = 1 + (left[i + 1] if i + 1 < len(found) and found[i + 1][0] is found[i][0] else 0)
    held: list[tuple[int, int, int]] = []  # columns from, to, and the row before which they are free, in order
    for i, (_, tr) in enumerate(found):
        cells: dict[int, list[str]] = {}
        held = [h for h in held if h[2] > i]
        new, at, k = [], 0, 0
        for c in tr.children:
            inner = Layout()
            if isinstance(c, str) or (c.tag not in ("td", "th") and visible(c)):
                yield render([c], inner)
                if not (lines := inner.done()):
                    continue
                width = height = 1
            elif visible(c):
                yield render(c.children, inner)
                lines = inner.done()
                span, down = c.attrs.get("colspan", "1"), c.attrs.get("rowspan", "1")
                width = max(1, min(COLUMNS, int(span))) if re.fullmatch(r"[0-9]{1,9}", span) else 1
                height = min(ROWS, int(down) or ROWS) if re.fullmatch(r"[0-9]{1,9}", down) else 1
            else:
                continue
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            if height > 1:
                new.append((at, at + width, i + min(height, left[i])))
            cells[at] = lines
            at += width
        if new:
            held = joined(sorted(held + new))
        if any(cells.values()):
            rows.append(cells)
    # A column in which no cell starts is only spanned, and takes no room.
    starts = sorted({k for r in rows for k in r})
    widths = dict.fromkeys(starts, 0)
    for r in rows:
        for k, lines in r.items():
            widths[k] = max([widths[k], *(w for w in map(cell_width, lines) if w <= WIDE)])
    place, at = {}, 0
    for k in starts:
        place[k] = at
        at += widths[k] + 2
    text = sum(len(s) for r in rows for lines in r.values() for s in lines)
    aligned = sum(max((place[k] for k, lines in r.items() if i < len(lines)), default=0) for r in rows for i in range(max(map(len, r.values()))))
    for r in rows:
        for i in range(max(map(len, r.values()))):
            parts = [(k, lines[i]) for k, lines in sorted(r.items()) if i < len(lines) and lines[i]]
            line, used = [], 0
            for k, s in parts:
                gap = max(place[k] - used, 2 if line else 0) if aligned <= STRETCH * text + 1000 else 2 if line else 0
                line += [" " * gap, s]
                used += gap + cell_width(s)
            out.raw(["".join(line).rstrip()])


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order, neighbours that end in the same row as one."""
    out = [spans[0]]
    for a, b, row in spans[1:]:
        if a <= out[-1][1] and row == out[-1][2]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), row)
        else:
            out.append((a, b, row))
    return out


def html_to_text(html: str | None) -> str:
    """All visible text of a page; null and pages without visible text give the empty string."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    prune(builder.root)
    out = Layout()
    run(render(builder.root.children, out))
    return "\n".join(out.done())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars) of every whole page.

    Null pages, empty ones and those without visible text give the empty string; very long pages
    are read whole, in time that grows with their tags and cells. Repeated rows stay repeated, ids
    may be null, an empty table gives no rows, and other columns are never read.
    """

    def f(rows):
        texts = [html_to_text(h) for h in rows[html_col]]
        return {"page_id": rows[id_col], "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_rows(pages, [id_col, html_col], "page_id long, text string, n_chars long", lambda: f)
