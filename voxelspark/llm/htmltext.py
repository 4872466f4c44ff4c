"""Layout-aware text of HTML pages.

A tree builder applies the usual implied tags (a paragraph ends where a block begins; list items, table rows
and cells, definition terms and options end where the next one begins; end tags without a start are dropped,
open elements are closed at the end). Elements that a browser with scripts does not show give no text: head, scripts, styles, templates, noscript,
frames and media, ``hidden``, ``display:none``, closed details but for their summary, closed dialogs, and in
drawings and formulas what is not drawn. ``visibility`` is inherited and may be switched on again inside. Form
fields show the values that a reader sees (texts and captions of buttons, not boxes, passwords or hidden ones).
The renderer collapses white space as browsers do, keeps ``pre``, puts a blank line around paragraphs,
headings, lists and tables and a line break around other blocks, marks list items with their indent, and
aligns table cells in columns, with row and column spans.

Everything is one pass with explicit stacks, and open elements are found by tag, so neither depth nor bad
nesting costs more than a constant for each tag. A table is aligned only where that makes at most ``STRETCH``
characters for each that is no space and ``ROOM`` for each cell; otherwise (a layout table, say) its cells follow
one another, those of one line each in a row parted by tabs. Tables nested deeper than ``DEPTH`` are laid out as
blocks. Spans are at most 1,000 columns and 65,534 rows, as in browsers.
"""

from __future__ import annotations

import bisect
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowconf import bound_batches

DEPTH = 8
STRETCH, ROOM = 4, 64
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GONE = frozenset("head script style template noscript title iframe canvas audio video datalist annotation annotation-xml".split())
#: Inside a drawing these hold what is not drawn, or not there.
_UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
#: Types of input whose value is shown.
_FIELDS = frozenset(["", "text", "search", "url", "tel", "email", "number", "date", "month", "week", "time", "datetime-local", "submit", "reset", "button"])
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
_BLOCKS = _SPACED | frozenset("html body div section article aside nav header footer main address form details summary li dt dd tr caption figcaption legend center tbody thead tfoot td th option".split())
#: A start tag of the key ends an open element of the value, looked for up to an element of the third set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "caption"}, {"table"}),
}
#: A block ends an open paragraph, but not one outside of these.
_FENCE = frozenset("td th table button body caption".split())
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "block", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.block, self.children = tag, attrs, tag in _BLOCKS, []


class TreeBuilder(HTMLParser):
    """Elements and strings under ``root``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # where the open elements of a tag stand

    def _pop_to(self, at: int) -> None:
        for n in self.open[at:]:
            self.at[n.tag].pop()
        del self.open[at:]

    def _last(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def _close(self, tags, fence) -> None:
        """Ends the innermost open element of ``tags`` unless one of ``fence`` is nearer."""
        if (at := self._last(tags)) and at >= self._last(fence):
            self._pop_to(at)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            tags, fence = _ENDS[tag]
            if tag in ("tr", "tbody", "thead", "tfoot"):
                self._close({"td", "th"}, {"table"})
                self._close({"tr", "caption"}, {"table"})
                if tag != "tr":
                    self._close({"tbody", "thead", "tfoot"}, {"table"})
            else:
                self._close(tags, fence)
        if tag == "body":
            self._close({"head"}, set())
        elif tag in _BLOCKS and self.at.get("head") and tag not in ("html",):
            self._close({"head"}, {"body"})
        if tag in _BLOCKS:
            self._close({"p"}, _FENCE)
        if tag in ("td", "th") and self.at.get("table") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        node = self._push(tag, dict(attrs))
        if tag in _VOID:
            self._pop_to(len(self.open) - 1)
        return node

    def _push(self, tag, attrs):
        node = Node(tag, attrs)
        if self.at.get("svg"):
            node.block |= tag == "text"
            if tag in _UNDRAWN:
                attrs["hidden"] = ""
        self.open[-1].children.append(node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)
        return node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as in HTML, a slash closes nothing

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in _VOID and self.at.get(tag):
            fence = {"table"} if tag not in ("table", "body", "html", "div", "article", "section") else set()
            self._close({tag}, fence)

    def handle_data(self, data):
        if self.at.get("head") and self.open[-1].tag == "head" and data.strip():
            self._close({"head"}, set())
        self.open[-1].children.append(data)


def shown(node: Node, seen: bool) -> bool | None:
    """Whether an element's own text is seen, given whether its parent's is; None where nothing inside can be."""
    a = node.attrs
    style = {k.lower(): v.lower() for k, v in _STYLE.findall(a.get("style") or "")}
    if node.tag in _GONE or style.get("display") == "none" or ("hidden" in a and "display" not in style):
        return None
    if node.tag == "dialog" and "open" not in a and "display" not in style:
        return None
    how = style.get("visibility")
    return seen if how in (None, "inherit") else how not in ("hidden", "collapse")


class _Lines:
    """Lines of a box: inline text gathers in the current line; breaks ask for line ends and blank lines."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.want, self.space, self.mark = 0, False, ""

    def text(self, s: str, indent: str) -> None:
        for k, word in enumerate(_SPACE.split(s)):
            self.space |= k > 0
            if word:
                self._put(word, indent)

    def _put(self, word, indent):
        if not self.line:
            if self.want > 1 and self.out and self.out[-1]:
                self.out.append("")
            lead = (indent[: len(indent) - len(self.mark)] + self.mark) if self.mark else indent
            self.line.append(lead)
            self.mark, self.want, self.space = "", 0, False
        elif self.space:
            self.line.append(" ")
        self.line.append(word)
        self.space = False

    def end(self, want: int) -> None:
        if self.line:
            self.out.append("".join(self.line).rstrip())
            self.line = []
        self.want, self.space = max(self.want, want), False

    def whole(self, lines: list[str], indent: str) -> None:
        self.end(2)
        if lines:
            if self.out and self.out[-1]:
                self.out.append("")
            lead = (indent[: len(indent) - len(self.mark)] + self.mark) if self.mark else indent
            self.out += [((lead if k == 0 else indent) + x).rstrip() for k, x in enumerate(lines)]
            self.mark, self.want = "", 2


def _number(text: str | None, most: int) -> int:
    try:
        return max(1, min(most, int(text or 1)))
    except ValueError:
        return 1


class _Grid:
    """Cells of a table at their places: each takes the first free column of its row, also below cells of several rows."""

    def __init__(self):
        self.rows: list[list] = []  # (column, columns, lines of the cell)
        self.busy: list[list[int]] = []  # runs of columns that cells of earlier rows reach into, by column
        self.until: dict[int, list] = {}  # what is free again from a row on

    def row(self) -> None:
        for first, end in self.until.pop(len(self.rows), ()):
            k = bisect.bisect_right(self.busy, [first, first + 65535 * 1000]) - 1
            a, b = self.busy[k]
            self.busy[k : k + 1] = [x for x in ([a, first], [end, b]) if x[0] < x[1]]
        self.rows.append([])
        self.column, self.ahead, self.fresh = 0, 0, []

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        while self.ahead < len(self.busy) and self.busy[self.ahead][0] <= self.column:
            self.column, self.ahead = max(self.column, self.busy[self.ahead][1]), self.ahead + 1
        self.rows[-1].append((self.column, columns, lines))
        if rows > 1:
            # a wide cell may lie over one from above: only free columns are taken
            at, k = self.column, self.ahead
            while at < self.column + columns:
                stop = min(self.column + columns, self.busy[k][0]) if k < len(self.busy) else self.column + columns
                if at < stop:
                    self.fresh.append((at, stop, len(self.rows) - 1 + rows))
                at, k = (max(stop, self.busy[k][1]), k + 1) if k < len(self.busy) and stop == self.busy[k][0] else (stop, k)
        self.column += columns

    def end(self) -> None:
        for first, end, row in self.fresh:
            self.until.setdefault(row, []).append((first, end))
            k = bisect.bisect_left(self.busy, [first, end])
            if k < len(self.busy) and self.busy[k][0] == end:
                end = self.busy.pop(k)[1]
            if k and self.busy[k - 1][1] == first:
                self.busy[k - 1][1] = end
            else:
                self.busy.insert(k, [first, end])

    def lines(self) -> list[str]:
        wide: dict[int, int] = {}
        for row in self.rows:
            for at, columns, box in row:
                if columns == 1 and box:
                    wide[at] = max(wide.get(at, 0), *map(len, box))
                else:
                    wide.setdefault(at, 0)
        used = sorted(wide)
        for at, columns, box in sorted((c for row in self.rows for c in row if c[1] > 1 and c[2]), key=lambda c: c[1]):
            own = used[bisect.bisect_left(used, at) : bisect.bisect_left(used, at + columns)]
            # what does not fit widens the last column that it reaches
            wide[own[-1]] += max(0, max(map(len, box)) - sum(wide[k] for k in own) - 2 * (len(own) - 1))
        start, total = {}, 0
        for at in used:
            start[at] = total
            total += wide[at] + 2
        size = room = 0
        for row in self.rows:
            ends: dict[int, int] = {}
            for at, _, box in row:
                room += ROOM
                for y, x in enumerate(box):
                    ends[y] = max(ends.get(y, 0), start[at] + len(x))
                    room += STRETCH * (len(x) - x.count(" "))
            size += sum(ends.values())
        return self._aligned(start) if size <= room else self._loose()

    def _aligned(self, start: dict[int, int]) -> list[str]:
        out = []
        for row in self.rows:
            lines: list[str] = []
            for at, _, box in row:
                lines += [""] * (len(box) - len(lines))
                for y, x in enumerate(box):
                    # a cell that reached into this column is parted from it all the same
                    lines[y] = lines[y].ljust(start[at]) if len(lines[y]) + 2 <= start[at] or not lines[y] else lines[y] + "  "
                    lines[y] += x
            out += lines
        return out

    def _loose(self) -> list[str]:
        out = []
        for row in self.rows:
            if all(len(box) <= 1 for _, _, box in row):
                out.append("\t".join(box[0] if box else "" for _, _, box in row).rstrip())
            else:
                out += [x for _, _, box in row for x in box]
        return out


def _table(node: Node, depth: int, seen: bool) -> list[str]:
    """Rows of a table with their cells aligned in columns; captions above."""
    top, grid, todo = [], _Grid(), [(c, False, seen) for c in reversed(node.children)]
    while todo:
        c, in_row, seen = todo.pop()
        if c is None:
            grid.end()
        elif isinstance(c, str):
            if c.strip() and seen:
                top.append(_SPACE.sub(" ", c).strip())
        elif (own := shown(c, seen)) is None:
            continue
        elif c.tag in ("td", "th"):
            if not in_row:
                grid.row()
            grid.cell([x for x in render(c, depth + 1, own) if x], _number(c.attrs.get("colspan"), 1000), _number(c.attrs.get("rowspan"), 65534))
            if not in_row:
                grid.end()
        elif c.tag == "tr":
            grid.row()
            todo.append((None, False, own))
            todo.extend((x, True, own) for x in reversed(c.children))
        elif c.tag in ("tbody", "thead", "tfoot", "colgroup"):
            todo.extend((x, False, own) for x in reversed(c.children))
        else:
            top += [x for x in render(c, depth + 1, own) if x]
    return top + grid.lines()


def render(node: Node, depth: int = 0, seen: bool = True) -> list[str]:
    """The lines of an element's visible text."""
    lines = _Lines()
    # (node, entering, indent, list counter or None, in pre, seen)
    todo: list = [(c, True, "", None, False, seen) for c in reversed(node.children)]
    while todo:
        n, entering, indent, counter, pre, seen = todo.pop()
        if isinstance(n, str):
            if not seen:
                continue
            if pre:
                for k, part in enumerate(n.split("\n")):
                    if k:
                        lines.end(1)
                        lines.out.append("") if lines.out and not part and k < n.count("\n") else None
                    if part.strip("\r"):
                        lines._put(part.rstrip("\r"), indent)
            else:
                lines.text(n, indent)
            continue
        if not entering:
            lines.end(2 if n.tag in _SPACED else 1)
            if n.tag == "li":
                lines.mark = ""
            continue
        if (own_seen := shown(n, seen)) is None:
            continue
        tag, seen = n.tag, own_seen
        if tag == "br":
            if not lines.line:
                lines.want = max(lines.want, 2)
            lines.end(1)
            continue
        if tag == "table" and depth < DEPTH:
            lines.whole(_table(n, depth, seen), indent)
            continue
        if tag == "input":
            if seen and n.attrs.get("value") and (n.attrs.get("type") or "").lower().strip() in _FIELDS:
                lines.text(n.attrs["value"], indent)
            continue
        if n.block:
            nested = tag in ("ul", "ol", "dl") and counter is not None
            lines.end(1 if nested else 2 if tag in _SPACED else 1)
            todo.append((n, False, indent, counter, pre, seen))
        inner, count = indent, counter
        if tag in ("ul", "ol", "menu"):
            count = [0, tag == "ol"]
            if tag == "ol":
                try:
                    count[0] = int(n.attrs.get("start") or 1) - 1
                except ValueError:
                    count[0] = 0
        elif tag == "li":
            own = counter or [0, False]
            own[0] += 1
            mark = f"{own[0]}. " if own[1] else "- "
            lines.mark, inner = mark, indent + " " * len(mark)
        elif tag in ("dd", "blockquote"):
            inner = indent + "  "
        children = n.children
        if tag == "details" and "open" not in n.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        todo.extend((c, True, inner, count, pre or tag in ("pre", "textarea"), seen) for c in reversed(children))
    lines.end(0)
    out = lines.out
    while out and not out[-1]:
        out.pop()
    while out and not out[0]:
        out.pop(0)
    return out


def page_text(html: str | None) -> str:
    """The visible text of a page; empty for null."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return "\n".join(render(builder.root))


def _run(batches):
    for batch in batches:
        texts = [page_text(x) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, html): page_id, text, n_chars, n_lines. Null pages give empty text. Other columns are not read."""
    bound_batches(pages.sparkSession)
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_run, "page_id long, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))
