import random
import time
from html.parser import HTMLParser

import duckdb
import pytest

from omniframe.llm.html_text import Table, extract, texts

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><h1>Hi  there</h1><p>One<p>Two <b>bold</b>, x<ul><li>a<li>b<ul><li>c</ul></ul>
<ol start=3><li>q<li>r</ol><table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>pear pear<td>12</table>tail<br>next
<pre>  a
   b</pre><p hidden>no</p><div style="display: none">no</div><script>var a = "</p>";</script><!-- no -->end &amp; <i>it</i>"""


def test_layout():
    assert extract(PAGE) == "Hi there\n\nOne\n\nTwo bold, x\n\n- a\n- b\n  - c\n\n3. q\n4. r\n\nName       Qty\napple      3\npear pear  12\n\ntail\nnext\n\n  a\n   b\n\nend & it"


def test_odd_pages():
    assert extract(None) is None and extract("") == "" and extract("plain  text") == "plain text"
    assert extract("<p>a</b></i><div>b") == "a\n\nb"
    assert extract("<td>x</td>") == "x"
    assert extract("<a href='x>y'>z</a> < 5") == "z < 5"
    assert extract("<script>never closed <p>no") == ""
    assert extract("<div>" * 20000 + "deep") == "deep"
    assert extract("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>").split() == ["a", "d", "b", "c"]
    assert extract("x" * 200_000) == "x" * 200_000


def test_visible_text_of_controls_and_foreign_content():
    assert extract("See <textarea>typed\nin</textarea> <select><option>a<option selected>b</select> <svg><title>no</title><text>in svg</text><path d='x'/></svg> Go").split() == "See typed in a b in svg Go".split()
    assert extract("<input type=submit value=Send><input value=x><input type=hidden value=no><input type=password value=no><input placeholder=here>") == "Send x here"
    assert extract("<span aria-hidden=true>x</span><math><mi>y</mi><mo>=</mo><annotation>no</annotation></math>") == "xy="
    assert extract("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>end") == "yes\nend"
    assert extract("<div style='display:none'><b style='visibility:visible'>no</b></div><dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert extract("<xmp><b>raw</b></xmp>") == "<b>raw</b>" and extract("a<plaintext><b>") == "a\n\n<b>"
    assert extract("<svg><text><![CDATA[a <b]]></text></svg>c") == "a <b c"


def test_broken_markup():
    assert extract('<a title="5" tall">shown</a> after') == "shown after"
    assert extract("<!-->a<!--->b<!-- no --!>c<!doctype x><?php no ?>d</ no>e</>") == "abcde"
    assert extract("a < b <3 c<") == "a < b <3 c<"
    assert extract("<p>a<b title='never ends>b</p>") == "a"
    assert extract("<script>a</scriptx>b</script >c") == "c"


def test_spans_and_wide_letters():
    page = "<table><tr><td colspan=2>ab<td>c<tr><td>dddd<td>e<td>f<tr><td rowspan=2>g<td>h<td>i<tr><td>j<td>k</table>"
    assert extract(page) == "ab       c\ndddd  e  f\ng     h  i\n      j  k"
    assert extract("<table><tr><td>日本<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>") == "日本  x\nabcd  y\ne\u0301     z"
    assert extract("<table><tr><td colspan=0>a<td rowspan=x>b<tr><td colspan=99999>c</table>") == "a  b\nc"


def brute_table(rows):
    """Lines of a table of one-line cells: each column as wide as its widest cell."""
    n = max(map(len, rows))
    wide = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(n)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows)


def test_tables_against_plain_padding():
    rnd = random.Random(5)
    for _ in range(200):
        rows = [["x" * rnd.randrange(1, 12) for _ in range(rnd.randrange(1, 6))] for _ in range(rnd.randrange(1, 7))]
        page = "<table>" + "".join("<tr>" + "".join(f"<t{rnd.choice('dh')}>{c}" for c in r) for r in rows) + "</table>"
        assert extract(page) == brute_table(rows)


def plain_grid(rows):
    """Each cell's first column and one past its last, on a grid that is filled slot by slot."""
    full, out = set(), []
    for k, row in enumerate(rows):
        at = 0
        out.append([])
        for _, cols, down in row:
            while (k, at) in full:
                at += 1
            out[-1].append((at, at + cols))
            full |= {(k + i, j) for i in range(1, down) for j in range(at, at + cols)}
            at += cols
    number = {a: i for i, a in enumerate(sorted({a for r in out for a, _ in r}))}
    return [[(number[a], sum(x < z for x in number)) for a, z in r] for r in out]


def test_spans_against_a_plain_grid():
    rnd = random.Random(11)
    for _ in range(2000):
        t = Table()
        t.rows = [[("c", rnd.choice([1, 1, 2, 3, 9]), rnd.choice([1, 1, 2, 3, 8])) for _ in range(rnd.randrange(1, 6))] for _ in range(rnd.randrange(1, 12))]
        assert [[x[:2] for x in r] for r in t.placed()] == plain_grid(t.rows)


@pytest.mark.parametrize(
    "head,row",
    [
        ("<tr>" + "<td rowspan=9000>a" * 300, "<tr><td>" + "b" * 200), ("<tr>" + "<td>a" * 100, "<tr>" + "<td>" * 20 + "<td>b"), ("<tr><td>a<td>b<td>c", "<tr><td colspan=2>wide cell<td>x"),
        ("<tr>" + "".join(f"<td rowspan={k}>a" for k in range(9000, 8700, -1)), "<tr><td colspan=7 rowspan=5>b<td>c"),
    ],
)
def test_rows_stand_alike_however_many_follow(head, row):
    few, many = (extract("<table>" + head + row * n + "</table>").split("\n") for n in (10, 5000))
    assert many[:11] == few and len(many) == 5001
    if "rowspan=5>" not in row:
        assert {*many[1:]} == {few[1]}


@pytest.mark.parametrize(
    "page,size",
    [
        ("<a " * 350_000, 0), ("<div>" * 100_000 + "deep", 4), ("<b>" * 100_000 + "x" + "</i>" * 100_000, 1), ("<blockquote>" * 50_000 + "x" * 10, 200),
        ("<table><tr><td>" + "w" * 1_000_000 + "<td>b" + "<tr><td>a<td>b" * 20_000 + "</table>", 2_800_000), ("<ul><li>" * 30_000 + "x", 500_000),
        ("<table>" + "<tr>" + "<td rowspan=60000>a" * 1000 + "<tr><td>b" * 30_000, 3_000_000), ("<table><tr>" + "<td>a" * 1500 + "<tr><td colspan=1000>a<td>b" * 20_000, 2_000_000),
        ("<!--" * 300_000, 0), ("</script" * 100_000, 0), ("<script>" + "</scriptx" * 100_000, 0), ("&" * 1_000_000, 1_000_000), ("<p>" * 200_000 + "x", 1), ("<table><tr><td>" * 5_000 + "x", 100_000),
    ],
)
def test_hostile_pages_take_linear_time(page, size):
    began = time.time()
    assert len(extract(page)) <= size and time.time() - began < 20


class Words(HTMLParser):
    """All visible words of pages without tables or hidden parts, the plain way."""

    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.off:
            self.out += data.split()


def test_words_of_real_pages():
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        w = Words()
        w.feed(page)
        got = extract(page).split()
        assert "".join(x for x in got if x != "-") == "".join(x for x in w.out if x != "-")


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, "y")], "page_id long, html string, text string")
    assert sorted(map(str, map(tuple, texts(df).collect()))) == ["(1, 'a')", "(1, 'a')", "(None, None)"]
    assert texts(df.limit(0)).count() == 0
