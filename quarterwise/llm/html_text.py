"""Visible text of web pages, laid out: block spacing, lists, aligned table cells.

A tokenizer finds tags, comments and text. The builder keeps the stack of open elements: void
elements, implied end tags (paragraphs, list items, table parts), implied rows, and end tags
that match nothing. Closing an element hands its lines to what encloses it, so no tree
outlives its elements and nothing recurses. Visibility: head, script, style, template,
noscript, embedded content and anything `hidden`, `display:none` or `visibility:hidden` adds no text.
Formulas show their text without annotations; of a drawing, `text` and `foreignObject` show theirs.

Layout: white space collapses except in `pre` and `textarea`; paragraphs, headings, lists,
tables, quotations and preformatted text are set off by a blank line, other blocks by a line end;
list items have "- " or their number and are indented by their depth; table cells are padded to
the width of their column, with two spaces between columns. A cell with others to its right is
wrapped into lines of at most `WRAP` characters, so padding is bounded and no text is lost.

Defined results: NULL and empty pages give an empty text; unclosed tags, comments and quotes
run to the end or are taken as text. Elements nested deeper than 512 are kept track of, hide
what they hide and end lines, but nest no further layout. Extra columns are left alone.
"""

from __future__ import annotations

import heapq
import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterwise.llm.frames import rows_of

# Element names by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head title script style template noscript iframe object video audio canvas datalist noframes".split()
)
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
# in formulas and drawings: what is not shown, what shows in a drawing, what stands apart from its neighbours
UNDRAWN = frozenset("annotation annotation-xml mphantom defs symbol clippath mask marker pattern desc metadata".split())
DRAWN = frozenset("text foreignobject".split())
APART = frozenset("text foreignobject mtd".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre xmp blockquote figure hr".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer nav main address li dt dd form fieldset legend figcaption "
    "details summary caption tr td th thead tbody tfoot option optgroup select center search hgroup dialog".split()
)
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"td", "th", "tr", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
FENCES = frozenset("table td th caption html".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^=>]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
#: The end of a tag that closes itself: a slash that is no part of a value without quotes.
_CLOSED = re.compile(r"(?<![^\s\"'])/\Z|\A[^=]*/\Z|[\s\"'][^\s=\"']+/\Z")
# How far a cell may span in HTML.
SPAN_LIMITS = (("colspan", 1000), ("rowspan", 65534))
DEEPEST = 512
WRAP = 80


def wrapped(line: str) -> list[str]:
    """The line in parts of at most `WRAP` characters, cut at blanks where there are any."""
    parts, at = [], 0
    lead = len(line) - len(line.lstrip(" "))
    while len(line) - at > WRAP:
        cut = line.rfind(" ", max(at, lead) + 1, at + WRAP + 1)
        while cut > 0 and line.startswith("- ", cut + 1):  # would look like a list item
            cut = line.rfind(" ", max(at, lead) + 1, cut)
        parts.append(line[at : cut if cut > 0 else at + WRAP].rstrip(" "))
        at = cut + 1 if cut > 0 else at + WRAP
    return [*parts, line[at:]]


class Flow:
    """Lines of one column of text: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        #: Places of lines that a table has aligned.
        self.aligned: set[int] = set()
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def text(self, text: str) -> None:
        """Inline text; runs of white space become one space, none at the edges of a line."""
        words = _SPACE.sub(" ", text)
        body = words.strip(" ")
        if not body:
            self.space = self.space or bool(words)
            return
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(body)
        self.space = words[-1] == " "

    def raw(self, text: str) -> None:
        """Text whose line ends and blanks count."""
        first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for part in more:
            self.feed()
            if part:
                self.line.append(part)

    def feed(self) -> None:
        """End the line even if it is empty."""
        self._put("".join(self.line))
        self.line, self.space = [], False

    def rest(self, blank: bool = False) -> None:
        """End the line if it has text; `blank` asks for an empty line before what follows."""
        if self.line:
            self.feed()
        self.space = False
        self.gap = max(self.gap, int(blank))

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        if self.marker:
            line = self.indent[: len(self.indent) - len(self.marker)] + self.marker + line
            self.marker = ""
        elif line:
            line = self.indent + line
        self.lines.append(line.rstrip())

    def put(self, lines: list[str]) -> None:
        """Finished lines of a table."""
        for line in lines:
            self._put(line)
            self.aligned.add(len(self.lines) - 1)

    def narrow(self) -> list[str]:
        """The lines, those that are too long wrapped; lines of a table within stay, as wrapping would move its columns."""
        lines = []
        for at in self._visible():
            line = self.lines[at]
            lines += [line] if at in self.aligned or len(line) <= WRAP else wrapped(line)
        return lines

    def done(self) -> list[str]:
        return [self.lines[at] for at in self._visible()]

    def _visible(self) -> range:
        """Places of the lines without empty ones at either end."""
        self.rest()
        lo, hi = 0, len(self.lines)
        while lo < hi and not self.lines[lo].strip():
            lo += 1
        while hi > lo and not self.lines[hi - 1].strip():
            hi -= 1
        return range(lo, hi)


class Spans:
    """Columns that cells of earlier rows reach down into, as runs in rising order that do not touch."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # a heap of (first row that is free again, start, end)

    def reach(self, row: int) -> None:
        """Free what ends before this row."""
        while self.until and self.until[0][0] <= row:
            _, start, end = heapq.heappop(self.until)
            at = bisect_right(self.starts, start) - 1
            whole = (self.starts[at], self.ends[at])
            left = [(a, b) for a, b in ((whole[0], start), (end, whole[1])) if a < b]
            self.starts[at : at + 1], self.ends[at : at + 1] = [a for a, _ in left], [b for _, b in left]

    def free(self, column: int) -> tuple[int, int | None]:
        """The first free column from here on, and where the next run starts."""
        at = bisect_right(self.starts, column) - 1
        if at >= 0 and self.ends[at] > column:
            column = self.ends[at]
        after = bisect_right(self.starts, column)
        return column, self.starts[after] if after < len(self.starts) else None

    def add(self, start: int, end: int, row: int) -> None:
        """Take free columns until `row`; runs that touch become one."""
        heapq.heappush(self.until, (row, start, end))
        at = bisect_left(self.starts, start)
        if at and self.ends[at - 1] == start:
            at -= 1
            start = self.starts[at]
            del self.starts[at], self.ends[at]
        if at < len(self.starts) and self.starts[at] == end:
            end = self.ends[at]
            del self.starts[at], self.ends[at]
        self.starts.insert(at, start)
        self.ends.insert(at, end)


class Table:
    """Cells of an open table, row by row."""

    def __init__(self, outer: Flow) -> None:
        self.outer = outer
        self.rows: list[list[tuple[Flow, int, int]]] = []
        self.caption: Flow | None = None

    def cell(self, across: int, down: int) -> Flow:
        if not self.rows:
            self.rows.append([])
        flow = Flow()
        self.rows[-1].append((flow, across, down))
        return flow

    def laid_out(self) -> list[str]:
        """Lines with cells in columns; spanned places stay empty.

        A column starts where every cell that ends before it has ended. The cost follows the number of cells, whatever they span.
        """
        grid: list[list[tuple[int, int, Flow]]] = []
        spans = Spans()
        for number, row in enumerate(self.rows):
            spans.reach(number)
            column, placed, below = 0, [], []
            for flow, across, down in row:
                column, bound = spans.free(column)
                placed.append((column, across, flow))
                if down > 1:
                    # a cell that runs into one from above reaches down beside it only
                    below.append((column, column + across if bound is None else min(column + across, bound), number + down))
                column += across
            for start, end, until in below:
                spans.add(start, end, until)
            grid.append(placed)
        last = max((c for row in grid for c, _, _ in row), default=0)
        columns = sorted({c for row in grid for c, _, _ in row})
        widths: dict[int, dict[int, int]] = {}
        drawn: list[list[tuple[int, list[str]]]] = []
        for row in grid:
            drawn.append([])
            for column, across, flow in row:
                lines = flow.narrow() if column + across <= last else flow.done()
                drawn[-1].append((column, lines))
                cells = widths.setdefault(column, {})
                cells[across] = max(cells.get(across, 0), *map(len, lines), 0)
        start: dict[int, int] = {}
        at, due = 0, {}
        for c in columns:
            at = start[c] = max(at, due.get(c, 0))
            for across, width in widths[c].items():
                after = bisect_left(columns, c + across)
                if width and after < len(columns):
                    due[columns[after]] = max(due.get(columns[after], 0), at + width + 2)
        out = self.caption.done() if self.caption else []
        for cells in drawn:
            for k in range(max((len(lines) for _, lines in cells), default=0)):
                line = ""
                cells = [x for x in cells if k < len(x[1])]
                for column, lines in cells:
                    if lines[k]:
                        line = line.ljust(start[column]) if len(line) <= start[column] else line + "  "
                        line += lines[k]
                out.append(line)
        return out


#: What an element too deep for layout restores when it closes.
_FLAT = object()


class Page:
    """Builds and lays out one page."""

    def __init__(self) -> None:
        self.flow = Flow()
        #: (tag, how much it adds to `unseen` and to `undrawn`, what to restore when it closes)
        self.open: list[tuple[str, int, int, object]] = []
        #: Places of the open elements by tag, and of the blocks among them, in rising order.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.unseen = 0
        #: Drawings open around here without a part that shows text; formulas and drawings open around here.
        self.undrawn = self.foreign = 0
        self.tables: list[Table] = []
        self.lists: list[list[int | None]] = []
        self.kept = 0
        self.n_tables = self.n_items = 0

    def text(self, text: str, plain: bool = False) -> None:
        if self.unseen or not text:
            return
        text = text if plain or "&" not in text else html.unescape(text)
        if self.kept:
            self.flow.raw(text)
        else:
            self.flow.text(text)

    def _in_foreign(self) -> bool:
        """Whether the innermost of drawing, formula and HTML in a drawing is not HTML."""
        if not self.foreign:
            return False
        return max(self._last("svg"), self._last("math")) > self._last("foreignobject")

    def _last(self, *tags: str) -> int:
        """The place of the innermost open element of these kinds, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def start(self, tag: str, written: str) -> None:
        if tag in ENDS:
            self._imply(*ENDS[tag])
        if tag in BLOCKS:
            self._imply(frozenset({"p"}), FENCES)
        named = written.rstrip("/")
        attributes = _attributes(named) if named and not named.isspace() else {}
        unseen = int(tag in HIDDEN or "hidden" in attributes or bool(_UNSEEN.search(attributes.get("style", ""))))
        undrawn = 0
        if self.foreign or tag in ("svg", "math"):
            if _CLOSED.search(written) and (tag in ("svg", "math") or self._in_foreign()):
                return
            undrawn = int(tag == "svg") - int(tag in DRAWN and self.undrawn > 0)
            unseen += undrawn + (tag in UNDRAWN)
        if tag in VOID:
            if not self.unseen and not unseen:
                if tag == "br":
                    self.flow.feed()
                elif tag == "hr":
                    self.flow.rest(True)
            return
        before: object = None
        self.unseen += unseen
        self.undrawn += undrawn
        self.foreign += tag in ("svg", "math")
        if not self.unseen:
            if len(self.open) < DEEPEST:
                before = self._enter(tag, attributes)
            else:
                before = self._pass(tag)
                self.n_tables += tag == "table"
                self.n_items += tag == "li"
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, unseen, undrawn, before))

    def _pass(self, tag: str) -> object:
        """Enter or leave an element without layout of its own."""
        if tag in BLOCKS:
            self.flow.rest()
        elif tag in APART and self.foreign:
            self.text(" ")
        return _FLAT

    def _enter(self, tag: str, attributes: dict[str, str]) -> object:
        flow = self.flow
        if tag in APART and self.foreign:
            self.text(" ")
        if tag in ("td", "th") and self.tables:
            across, down = (min(most, max(1, _number(attributes.get(x), 1))) for x, most in SPAN_LIMITS)
            self.flow = self.tables[-1].cell(across, down)
            return flow
        if tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
            return None
        if tag == "caption" and self.tables:
            self.flow = self.tables[-1].caption = Flow()
            return flow
        if tag in BLOCKS:
            flow.rest(tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists))
        if tag == "table":
            self.tables.append(Table(flow))
            self.n_tables += 1
        elif tag in ("ul", "ol", "menu"):
            self.lists.append([_number(attributes.get("start"), 1) if tag == "ol" else None])
        elif tag == "li":
            own = self.lists[-1] if self.lists else [None]
            own[0] = _number(attributes.get("value"), own[0]) if own[0] is not None else None
            marker = "- " if own[0] is None else f"{own[0]}. "
            if own[0] is not None:
                own[0] += 1
            before = (flow, flow.indent)
            flow.indent += " " * len(marker)
            flow.marker = marker
            self.n_items += 1
            return before
        elif tag in ("dd", "blockquote"):
            before = (flow, flow.indent)
            flow.indent += "  "
            return before
        elif tag in ("pre", "textarea", "xmp"):
            self.kept += 1
        return flow

    def _leave(self, tag: str, before: object) -> None:
        if tag in APART and self.foreign:
            self.text(" ")
        if tag in ("td", "th", "caption"):
            if before is not None and before is not self.flow:
                self.flow.rest()
                self.flow = before
            return
        if tag == "table":
            table = self.tables.pop()
            self.flow = table.outer
            self.flow.rest(True)
            self.flow.put(table.laid_out())
            self.flow.rest(True)
            return
        if tag in ("pre", "textarea", "xmp"):
            self.kept -= 1
        if tag in BLOCKS and tag != "tr":
            self.flow.rest(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(self.lists) > 1))
        if tag in ("ul", "ol", "menu"):
            self.lists.pop()
        if isinstance(before, tuple):
            flow, indent = before
            if tag == "li" and flow.marker:
                flow.marker = ""
            flow.indent = indent

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        if tag in VOID:
            return
        at, inline = self._last(tag), tag not in BLOCKS
        if at < 0:
            return
        if at == len(self.open) - 1:
            self._pop(at)
            return
        if inline or tag not in ("table", "tr", "thead", "tbody", "tfoot", "html", "body"):
            fences = FENCES
        else:
            fences = frozenset({"table"})
        if self._last(*fences - {tag}) > at:
            return
        if inline and self.blocks and self.blocks[-1] > at:
            # blocks within go on without it
            self._forget(*self.open[at][:3])
            self.open[at] = ("", 0, 0, None)
        else:
            self._pop(at)

    def _imply(self, closed: frozenset[str], fence: frozenset[str]) -> None:
        """Close the open elements of these kinds, and all within, up to the fence."""
        if not any(self.places.get(t) for t in closed):
            return
        edge = self._last(*fence - closed)
        found = [p[k] for t in closed if (p := self.places.get(t)) and (k := bisect_right(p, edge)) < len(p)]
        if found:
            self._pop(min(found))

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, unseen, undrawn, before = self.open.pop()
            if before is _FLAT:
                self._pass(tag)
            elif before is not None:
                self._leave(tag, before)
            if tag:
                self._forget(tag, unseen, undrawn)

    def _forget(self, tag: str, unseen: int, undrawn: int) -> None:
        self.places[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.unseen -= unseen
        self.undrawn -= undrawn
        self.foreign -= tag in ("svg", "math")

    def result(self) -> str:
        self._pop(0)
        return "\n".join(self.flow.done())


def _number(written: str | None, default: int | None) -> int | None:
    found = re.match(r"\s*(-?[0-9]{1,9})", written or "")
    return int(found[1]) if found else default


def _attributes(written: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(written):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


def render(source: str | None) -> Page:
    """The laid-out page; `result()` gives its text."""
    page, source = Page(), source or ""
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        page.text(source[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, m[3] or "")
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            stop = close.start() if close else n
            if tag in ("textarea", "xmp"):
                page.text(source[at:stop], plain=tag == "xmp")
            at = stop
    return page


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_lines, n_tables, n_items."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_lines long, n_tables long, n_items long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, ["page_id", "url", "html"], text="html"):
            rows = []
            for source in batch.column("html").to_pylist():
                page = render(source)
                text = page.result()
                rows.append((text, len(text), text.count("\n") + 1 if text else 0, page.n_tables, page.n_items))
            columns = zip(*rows) if rows else [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["page_id", "url", "text", "n_chars", "n_lines", "n_tables", "n_items"]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *arrays], names=names)

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
