import html
import random
import re
import time
from html.parser import HTMLParser

import pandas as pd
import pytest

from quarterwise.llm import html_text as ht


def shown(source):
    return ht.render(source).result()


CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<p>a <b> b</b> c\n d</p>tail", "a b c d\n\ntail"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<li><p>x</p><p>y</p></li>", "- x\n\n  y"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>1<td>2<td>3</table>", "wide cell  z\n1  2       3"),
    ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        y\n\nin  ner"),
    ("<table>stray<tr><td>a</table>", "stray\n\na"),
    ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
    ("x<div hidden>no<p>no</p></div>y", "xy"),
    ("a<span style='Display : None'>no</span>b", "ab"),
    ("<title>no</title><script>if(a</b>)</script><style>p{}</style>yes", "yes"),
    ("<script>never closed <p>x", ""),
    ("<!-- a --><!doctype html><?pi?>t<!-- open", "t"),
    ("<p title=\"a>b\">x</p><p title=it's>y</p>", "x\n\ny"),
    ("a &amp; b &lt;c&gt; &nosuch; &#233;&nbsp;z", "a & b <c> &nosuch; é\xa0z"),
    ("</div></p>text</b>", "text"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<h1>H</h1><blockquote>q</blockquote>z", "H\n\n  q\n\nz"),
    ("<b><p>x</b>y", "xy"),
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
    ("<math><semantics><mi>y</mi><annotation>no</annotation><annotation-xml>no</annotation-xml></semantics></math>z", "yz"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>0</mtd></mtr></mtable><mspace/>.</math>", "1 0 ."),
    ("a<svg><title>no</title><g>no<path d='M0'/><text x=1>Sales <tspan>2020</tspan></text><text/>no<text>Costs</text></g></svg>b", "a Sales 2020 Costs b"),
    ("<svg><defs><text>no</text></defs><text hidden>no</text><g style='display:none'><text>no</text></g></svg>x", "x"),
    ("<svg><rect/><foreignObject><p>html</p></foreignObject>no</svg>x<text>y</text>", "html\n\nx" + "y"),
    ("<svg/>a<div hidden><svg><text>no</text></svg></div>", "a"),
    ("a<xmp><b>&amp;\n  c</b></xmp>d", "a\n\n<b>&amp;\n  c</b>\n\nd"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("source, want", CASES)
def test_layout(source, want):
    assert shown(source) == want


class Plain(HTMLParser):
    """Visible words without any layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("title", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("title", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def squeezed(text):
    return re.sub(r"[ \t\n\f\r]+", "", text)


def test_all_visible_text_of_pages():
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    for source in pages.html:
        plain = Plain()
        plain.feed(source)
        plain.close()
        # no characters are lost or made up, but for list markers
        got = "\n".join(re.sub(r"^\s*- ", "", line) for line in shown(source).split("\n"))
        want = "".join(plain.words)
        assert squeezed(re.sub(r"(?m)^\s*- ", "", got)) == squeezed(re.sub(r"(?m)^\s*- ", "", want))


def test_deep_nesting_and_long_input():
    deep = "<div><ul><li>" * 20_000 + "end" + "</li></ul></div>" * 20_000
    assert shown(deep).endswith("end")
    assert shown("<p " + "a=1 " * 100_000 + ">x") == "x"
    assert shown("<a " * 20_000 + "'>x") in ("", "x", "'>x")
    wide = "<table>" + f"<tr><td>{'w' * 5000}<td>v" * 300 + "</table>"
    assert len(shown(wide)) < 5100 * 300


def test_columns_beside_long_cells_are_aligned():
    prose = " ".join(["some words - of a description"] * 7)
    rows = [("a", prose, "10"), ("bbb", "short", "200"), ("c", "x" * 60, "3"), ("d", "y" * 200, "4")]
    got = shown("<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in rows) + "</table>")
    lines = got.split("\n")
    prices = [re.search(r"  (\d+)$", line) for line in lines]
    assert [m[1] for m in prices if m] == ["10", "200", "3", "4"] and len({m.start(1) for m in prices if m}) == 1
    assert max(map(len, lines)) <= 5 + ht.WRAP + 5
    assert "y" * 200 in squeezed(got).replace("4", "") and not any(x.lstrip().startswith("- ") for x in lines)
    middle = " ".join(x[5 : 5 + ht.WRAP].strip() for x in lines)
    assert prose in middle
    # nothing stands to the right of it, so nothing is wrapped
    assert shown(f"<table><tr><td>a<td>{prose}</table>") == f"a  {prose}"


@pytest.mark.parametrize("depth", [3, 700, 50_000])
def test_visibility_and_end_tags_hold_at_any_depth(depth):
    inner = "<p>seen</p><div hidden>no<div>no</div>no</div><span style='display:none'>no</span><b>bold</b>"
    got = shown("<div>" * depth + inner + "</div>" * depth + "after")
    assert got.split() == ["seen", "bold", "after"]
    hidden = "<div hidden>" + "<div>" * depth + "no" + "</div>" * depth + "no</div>yes"
    assert shown(hidden) == "yes"


def test_many_items_below_deep_elements_take_linear_time():
    assert shown("<ul>" + "<div>" * 30_000 + "<li>x" * 30_000).count("x") == 30_000


def test_frame(spark):
    schema = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", "mine"), (2, None, None, None), (2, None, None, None)], schema)
    got = sorted(tuple(r) for r in ht.extract_text(pages).collect())
    assert got[0] == (1, "u", "a\n\nb", 4, 3, 0, 0) and got[1:] == [(2, None, "", 0, 0, 0, 0)] * 2
    assert ht.extract_text(pages.limit(0)).count() == 0
    assert html.unescape("&copy;") == shown("&copy;")


def drawn_plainly(table):
    """Lines of a table of (text, colspan, rowspan) cells, by a set of taken places and repeated relaxation of column starts."""
    taken, placed = set(), []
    for r, row in enumerate(table):
        column = 0
        for text, across, down in row:
            while (r, column) in taken:
                column += 1
            free = next((k for k in range(across) if (r, column + k) in taken), across)
            taken |= {(r + i, column + k) for i in range(1, down) for k in range(free)}
            placed.append((r, column, across, text))
            column += across
    columns = sorted({c for _, c, _, _ in placed})
    start = dict.fromkeys(columns, 0)
    for _ in columns:
        for a, b in zip(columns, columns[1:]):
            start[b] = max(start[b], start[a])
        for _, c, across, text in placed:
            after = [x for x in columns if x >= c + across]
            if after and text:
                start[after[0]] = max(start[after[0]], start[c] + len(text) + 2)
    lines = []
    for r in range(len(table)):
        line = ""
        for row, c, _, text in placed:
            if row == r and text:
                line = line.ljust(start[c]) if len(line) <= start[c] else line + "  "
                line += text
        if any(row == r and text for row, _, _, text in placed):
            lines.append(line)
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return lines


def test_tables_against_a_plain_layout():
    pick = random.Random(4)
    for _ in range(300):
        table = []
        for _ in range(pick.randint(1, 6)):
            cell = lambda: ("x" * pick.choice([0, 1, 3, 9, 20]), pick.choice([1, 1, 1, 2, 3]), pick.choice([1, 1, 1, 2, 4]))
            table.append([cell() for _ in range(pick.randint(1, 5))])
        rows = "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in table)
        assert shown(f"<table>{rows}</table>").split("\n") == (drawn_plainly(table) or [""]), table


def test_cells_that_span_columns_hold_them_apart():
    source = "<table><tr><td colspan=2>long spanning heading cell<td>C<tr><td>a<td>b<td>c</table>"
    head, row = shown(source).split("\n")
    assert head.index("C") == row.index("c")


def test_a_nested_table_keeps_its_columns():
    inner = "<table>" + "".join(f"<tr><td>{c * 60}<td>{c.upper() * 60}" for c in "ab") + "</table>"
    lines = shown(f"<table><tr><td>{inner}<td>side</table>").split("\n")
    assert lines == ["a" * 60 + "  " + "A" * 60 + "  side", "b" * 60 + "  " + "B" * 60]


@pytest.mark.parametrize("rows, cells", [(1, 3000), (3000, 1), (60, 50)])
def test_thousands_of_spanning_cells_take_no_time(rows, cells):
    source = "<table>" + ("<tr>" + "<td colspan=1000 rowspan=65534>x" * cells) * rows + "</table>"
    begun = time.process_time()
    text = shown(source)
    assert time.process_time() - begun < 1 and text.count("x") == 3000
