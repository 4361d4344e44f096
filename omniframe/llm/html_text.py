"""Operator 1: layout-aware text of HTML pages.

A scanner cuts a page into tags, text and raw-text elements, reading every
character once (a quote opens a value only right after ``=``; what is still
open at the page's end is closed). A tree builder supplies the tags that HTML
implies: a new paragraph, item, cell or row closes the one before, rows get a
table body, stray end tags are ignored. Open elements are indexed by name, so
a tag costs the same however deep it stands. Elements that are never shown (head, script, style,
template, ``hidden``, ``display:none``, a closed dialog and the like) give
nothing; ``visibility`` is inherited and may be turned on again further in.

The renderer emits all visible text, form controls, SVG and MathML included:
blocks stand on lines of their own, with an empty line around paragraphs,
headings, lists and tables; items are marked and indented by depth; cells are
padded to their column's width on screen (wide letters count twice), also across
``colspan`` and ``rowspan``; ``pre`` keeps its white space; elsewhere runs of white space are one blank.

Layout is bounded, text never is: indents end at ``MOST_INDENT`` columns, a cell
widens its columns to ``MOST_PAD`` at most, and as many blanks (and the two between
columns) stand between two cells at most, so padding is in proportion to the cells.
These rules look at a line alone; all spans count, and no table is laid
out in another way because of its size.
Pages are rendered one by one in Arrow batches, without recursion, so depth and
length of a page are bounded by memory alone. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omniframe.llm import words

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown.
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object datalist audio video canvas rp defs symbol metadata desc annotation annotation-xml".split())
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp listing plaintext table figure".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main form fieldset address li dt dd figcaption details summary center hgroup legend menu dir search dialog tr caption thead tbody tfoot".split())
LISTS = frozenset("ul ol menu dir".split())
KEPT = frozenset("pre xmp listing plaintext textarea".split())
#: Inputs that show their value or, where it is empty, their placeholder.
TYPED = frozenset(" text search url tel email number date time month week datetime-local".split(" "))
ROWS = {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}
#: A start tag of the key closes the open elements of the first set, unless one of the second stands between.
CLOSES = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": (ROWS, {"table"}),
    "tbody": (ROWS, {"table"}),
    "tfoot": (ROWS, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: What stops the search for an open paragraph.
SCOPE = frozenset("table td th caption button object template html".split())
#: A stray end tag of another kind does not reach beyond these.
WALLS = frozenset("table td th".split())
OVER_WALLS = frozenset("table tr tbody thead tfoot body html".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SKIP = re.compile(r"[\s/]*")
ATTR = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]+")
COMMENT_END = re.compile(r"--!?>")
SPACES = re.compile(r"[ \t\n\r\f]+")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
MOST_INDENT = 64
MOST_PAD = 80


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class Open:
    """The open elements, and for each name the places in the stack where it stands."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at = [root], {root.tag: [0]}

    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Close everything from place k on."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()

    def last(self, tags) -> int:  # noqa: ANN001
        """The innermost place of any of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=-1)

    def first_after(self, tags, k: int) -> int:  # noqa: ANN001
        """The outermost place beyond k of any of the tags, or -1."""
        best = -1
        for t in tags:
            p = self.at.get(t)
            if p and p[-1] > k:
                low, high = 0, len(p) - 1
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if p[mid] > k else (mid + 1, high)
                best = p[low] if best < 0 else min(best, p[low])
        return best


def attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes that begin at a place, whether the tag closes itself, and where the page goes on; -1 if the tag never ends."""
    out: dict[str, str] = {}
    n = len(page)
    while True:
        begin, at = at, SKIP.match(page, at).end()
        if at >= n:
            return out, False, -1
        if page[at] == ">":
            return out, at > begin and page[at - 1] == "/", at + 1
        m = ATTR.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        eq = EQUALS.match(page, at)
        if eq:
            at = eq.end()
            mark = page[at] if at < n else ""
            if mark in ('"', "'") and mark:
                end = page.find(mark, at + 1)
                if end < 0:
                    return out, False, -1
                value, at = page[at + 1 : end], end + 1
            elif mark and mark != ">":
                b = BARE.match(page, at)
                value, at = b[0], b.end()
        if name not in out:
            out[name] = html.unescape(value) if "&" in value else value


def raw_end(page: str, low: str, tag: str, at: int) -> tuple[int, int]:
    """Where a raw-text element's content ends and where the page goes on."""
    n = len(page)
    while True:
        end = low.find("</" + tag, at)
        if end < 0:
            return n, n
        after = end + 2 + len(tag)
        if after >= n or page[after] in " \t\n\r\f/>":
            close = page.find(">", after)
            return end, n if close < 0 else close + 1
        at = after


def parse(page: str) -> Node:
    """The page's tree; text is str among a node's kids."""
    root = Node("html")
    open_ = Open(root)
    low = None
    at, n = 0, len(page)
    pending: list[str] = []

    def text() -> None:
        if pending:
            s = "".join(pending)
            pending.clear()
            if s:
                open_.top().kids.append(html.unescape(s) if "&" in s else s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            pending.append(page[at:])
            break
        if lt > at:
            pending.append(page[at:lt])
        mark = page[lt + 1] if lt + 1 < n else ""
        if mark in ("!", "?"):
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    at = page.index(">", lt + 4) + 1
                    continue
                m = COMMENT_END.search(page, lt + 4)
                at = m.end() if m else n
            elif page.startswith("<![CDATA[", lt) and open_.last(("svg", "math")) >= 0:
                end = page.find("]]>", lt)
                text()
                open_.top().kids.append(page[lt + 9 : end if end >= 0 else n])
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = mark == "/"
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            if closing and lt + 2 < n:  # </ and no letter: up to the next >
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                pending.append("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        attrs, alone, at = attributes(page, m.end())
        if at < 0:
            break  # a tag that never ends is not shown
        text()
        if closing:
            if tag == "p" and open_.last(("p",)) < 0:
                open_.top().kids.append(Node("p"))
            elif tag == "br":
                open_.top().kids.append(Node("br"))
            else:
                k = open_.last((tag,))
                # an inline end tag does not close a cell or a table around it
                if k > 0 and (tag in OVER_WALLS or k >= open_.last(WALLS)):
                    open_.cut(k)
            continue
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if tag == "image":
            tag = "img"
        if tag in BLOCK and tag not in ("tr", "thead", "tbody", "tfoot", "caption"):
            k = open_.last(("p",))
            if k > 0 and k > open_.last(SCOPE):
                open_.cut(k)
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            k = open_.first_after(shut, max(open_.last(stop), 0))
            if k > 0:
                open_.cut(k)
        if open_.top().tag == "head" and tag in BLOCK:
            open_.cut(len(open_.stack) - 1)
        if tag in ("tr", "td", "th"):
            if open_.top().tag == "table":
                body = Node("tbody")
                open_.top().kids.append(body)
                open_.push(body)
            if tag != "tr" and open_.top().tag in ("tbody", "thead", "tfoot"):
                row = Node("tr")
                open_.top().kids.append(row)
                open_.push(row)
        node = Node(tag, attrs)
        open_.top().kids.append(node)
        if tag in VOID or alone and open_.last(("svg", "math")) >= 0 or alone and tag in ("svg", "math"):
            continue
        if tag == "plaintext":
            node.kids.append(page[at:])
            break
        if tag in RAW:
            if low is None:
                low = page.lower()
                if len(low) != n:  # a letter whose lower case is longer
                    low = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end, on = raw_end(page, low, tag, at)
            if tag in ("textarea", "xmp"):
                node.kids.append(html.unescape(page[at:end]) if tag == "textarea" else page[at:end])
            at = on
            continue
        open_.push(node)
    text()
    return root


def shown(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and DISPLAY.search(a["style"]))


def width(s: str) -> int:
    """Columns that a line takes: wide letters take two, marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines under construction: pending blanks and empty lines are settled when text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.lead = ""  # indent and mark of the line that is begun
        self.gap = 0  # 1: a new line is due, 2: with an empty line before it
        self.blank = False
        self.indent = ""
        self.mark = ""

    def feed(self, n: int) -> None:
        self.gap = max(self.gap, n)

    def deeper(self, n: int) -> None:
        self.indent = self.indent[:MOST_INDENT] if len(self.indent) + n > MOST_INDENT else self.indent + " " * n

    def settle(self) -> None:
        if self.gap:
            self.flush()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def flush(self) -> None:
        if self.now:
            self.lines.append(self.lead + "".join(self.now))
            self.now = []
        self.blank = False

    def start(self) -> None:
        if not self.now:
            self.lead = self.indent + self.mark
            if self.mark:
                self.deeper(len(self.mark))
                self.mark = ""

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s == " ":
            self.blank = bool(self.now) and not self.gap
            return
        if not s:
            return
        if self.gap:
            self.settle()
        self.start()
        if self.now and (self.blank or s[0] == " "):
            self.now.append(" ")
        self.now.append(s.strip(" "))
        self.blank = s[-1] == " "

    def apart(self, s: str) -> None:
        """Text of a control: blanks on both sides."""
        if s.strip():
            self.text(" " + s + " ")

    def raw(self, s: str) -> None:
        """Preformatted text."""
        first = True
        for line in s.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            if not first:
                self.flush()
            if line:
                self.settle()
                self.start()
                self.now.append(line.rstrip())
            elif not first:
                self.settle()
                self.lines.append("")
            first = False

    def line_break(self) -> None:
        if self.now and not self.gap:
            self.flush()
        elif self.lines and self.lines[-1]:
            self.settle()
            self.lines.append("")

    def end(self) -> str:
        self.flush()
        out = [x.rstrip() for x in self.lines]
        while out and not out[-1]:
            out.pop()
        return "\n".join(out)


def span(node: Node, name: str, most: int) -> int:
    v = node.attrs.get(name, "").strip()[:6]
    return min(int(v), most) if v.isascii() and v.isdigit() and int(v) > 0 else 1


class Covered:
    """The columns that cells of rows above still cover.

    They are kept as pieces that don't overlap, each up to a row, and as the runs that touching
    pieces make, so a row costs by its own cells, however many reach down into it.
    """

    def __init__(self) -> None:
        self.begin: list[int] = []  # of the runs
        self.end: list[int] = []
        self.pieces: list[int] = []  # first columns
        self.piece: dict[int, tuple[int, int]] = {}  # first column: (one past the last, row where it's over)
        self.due: list[tuple[int, int, int]] = []  # (row, first column, one past the last)

    def free(self, at: int) -> int:
        """The first column from ``at`` on that isn't covered."""
        i = bisect_right(self.begin, at) - 1
        return max(at, self.end[i]) if i >= 0 else at

    def upto(self, row: int) -> None:
        """Drop the pieces that are over at a row."""
        while self.due and self.due[0][0] <= row:
            over, a, z = heapq.heappop(self.due)
            if self.piece.get(a) != (z, over):
                continue  # a longer one took its place
            del self.piece[a], self.pieces[bisect_left(self.pieces, a)]
            i = bisect_right(self.begin, a) - 1
            left = [x for x in ((self.begin[i], a), (z, self.end[i])) if x[0] < x[1]]
            self.begin[i : i + 1], self.end[i : i + 1] = [x for x, _ in left], [x for _, x in left]

    def add(self, a: int, z: int, over: int) -> None:
        """Cover columns a to z up to a row; a column that is covered for longer stays so."""
        i = bisect_right(self.pieces, a)
        if i and self.piece[self.pieces[i - 1]][0] > a:
            i -= 1
        j, at, new = bisect_left(self.pieces, z), a, []
        for p in self.pieces[i:j]:
            q, other = self.piece.pop(p)
            if other >= over:
                new += [(at, p, over), (p, q, other)]
                at = q
            else:
                new += [(p, a, other)] + ([(at, z, over), (z, q, other)] if q > z else [])
                at = max(at, q if q > z else at)
        new = [x for x in (*new, (at, z, over)) if x[0] < x[1]]
        self.pieces[i:j] = [x[0] for x in new]
        for first, past, until in new:
            self.piece[first] = past, until
            heapq.heappush(self.due, (until, first, past))
        i, j = bisect_left(self.end, a), bisect_right(self.begin, z)
        low, high = (min(a, self.begin[i]), max(z, self.end[j - 1])) if i < j else (a, z)
        self.begin[i:j], self.end[i:j] = [low], [high]


class Table:
    """Rows of (cell's text, columns, rows) while a table is open."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []

    def placed(self) -> list[list[tuple[int, int, str]]]:
        """Each row's (first column, one past the last, text), columns counted as if there were no others than those where a cell begins."""
        out, covered = [], Covered()
        for k, row in enumerate(self.rows):
            covered.upto(k)
            taken, at = [], 0
            for text, cols, down in row:
                at = covered.free(at)
                taken.append((at, at + cols, text, down))
                at += cols
            out.append([(a, z, t) for a, z, t, _ in taken])
            for a, z, _, down in taken:
                if down > 1:
                    covered.add(a, z, k + down)
        starts = sorted({a for r in out for a, _, _ in r})
        number = {a: k for k, a in enumerate(starts)}
        return [[(number[a], bisect_left(starts, z), t) for a, z, t in r] for r in out]

    def lines(self) -> list[str]:
        """Each column as wide as its widest line, two blanks between; columns under a wider cell are moved apart just enough."""
        rows = [[(a, z, [(x, width(x)) for x in t.split("\n")]) for a, z, t in r] for r in self.placed()]
        wide = [0] * max((z for r in rows for _, z, _ in r), default=0)
        over: dict[int, dict[int, int]] = {}
        for r in rows:
            for a, z, own in r:
                w = min(max(w for _, w in own), MOST_PAD)
                if z - a == 1:
                    wide[a] = max(wide[a], w)
                elif z < len(wide):
                    spans = over.setdefault(z, {})
                    spans[a] = max(spans.get(a, 0), w)
        begin = [0]
        for w in wide:
            begin.append(max(begin[k] + x + 2 for k, x in (*over.get(len(begin), {}).items(), (len(begin) - 1, w))))
        out = []
        for r in rows:
            laid = [[] for _ in range(max((len(own) for _, _, own in r), default=0))]
            for a, _, own in r:
                for line, (x, w) in zip(laid, own):
                    if x:
                        line.append((begin[a], x, w))
            for cells in laid:
                line, at = [], 0
                for a, x, w in cells:
                    first = max(a, at + 2 if at else 0)
                    line.append(" " * min(first - at, MOST_PAD + 2) + x)
                    at = first + w
                out.append("".join(line).rstrip())
        return out


def control(node: Node) -> str:
    """The text that an input shows."""
    a = node.attrs
    kind = a.get("type", "").strip().lower()
    if kind in ("submit", "reset", "button"):
        return a.get("value", "")
    if kind == "image":
        return a.get("alt", "")
    if kind in TYPED or kind not in ("hidden", "checkbox", "radio", "file", "password", "range", "color"):
        return a.get("value") or a.get("placeholder", "")
    return ""


def render(root: Node) -> str:
    """All visible text of the tree, laid out."""
    flow = Flow()
    # what is left to do: (step, node, extra), last first
    todo: list[tuple] = [("open", root, None)]
    flows: list[Flow] = []
    tables: list[Table] = []
    lists: list[list] = []
    pre, visible = 0, True
    while todo:
        step, node, extra = todo.pop()
        if step == "text":
            if visible:
                flow.raw(node) if pre else flow.text(node)
            continue
        tag = node.tag
        if step == "open":
            if not shown(node):
                continue
            saved = (flow.indent, flow.mark, visible)
            if "style" in node.attrs and (m := VISIBILITY.search(node.attrs["style"])) and m[1].lower() != "inherit":
                visible = m[1].lower() not in ("hidden", "collapse")
            if tag == "br":
                flow.line_break()
            elif tag == "hr":
                flow.feed(2)
            elif tag == "wbr":
                pass
            elif tag == "img":
                if visible and node.attrs.get("alt"):
                    flow.text(node.attrs["alt"])
            elif tag == "input":
                if visible:
                    flow.apart(control(node))
            if tag in VOID:
                visible = saved[2]
                continue
            if tag in ("td", "th") and tables:
                flows.append(flow)
                flow = Flow()
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in BLOCK or tag == "textarea" and "\n" in "".join(k for k in node.kids if isinstance(k, str)).strip("\n"):
                flow.feed(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
            if tag == "table":
                tables.append(Table())
            elif tag in LISTS:
                lists.append([tag, int(node.attrs["start"]) - 1 if tag == "ol" and re.fullmatch(r"\d{1,9}", node.attrs.get("start", "")) else 0])
            elif tag == "li":
                own = lists[-1] if lists else ["ul", 0]
                own[1] += 1
                flow.deeper(len(flow.mark))
                flow.mark = f"{own[1]}. " if own[0] == "ol" else "- "
            elif tag in ("blockquote", "dd"):
                flow.deeper(2)
            elif tag in KEPT:
                pre += 1
                if node.kids and isinstance(node.kids[0], str) and tag != "plaintext":
                    node.kids[0] = node.kids[0].removeprefix("\r").removeprefix("\n")
            if tag in ("textarea", "select", "option", "optgroup", "text", "button", "mtd"):
                flow.text(" ")
            if visible and tag in ("optgroup", "option") and node.attrs.get("label"):
                flow.apart(node.attrs["label"])
                if tag == "option":
                    node.kids = []
            elif visible and tag == "textarea" and not "".join(k for k in node.kids if isinstance(k, str)) and node.attrs.get("placeholder"):
                flow.apart(node.attrs["placeholder"])
            todo.append(("close", node, saved))
            for kid in reversed(node.kids):
                todo.append(("text", kid, None) if isinstance(kid, str) else ("open", kid, None))
            continue
        visible = extra[2]
        if tag in ("td", "th") and flows and tables:
            cell = flow.end()
            flow = flows.pop()
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append((cell, span(node, "colspan", 1000), span(node, "rowspan", 65534)))
            continue
        if tag == "table":
            made = tables.pop()
            made.rows = [r for r in made.rows if r]
            lines = made.lines()
            if any(lines):
                flow.settle()
                flow.flush()
                flow.start()
                flow.lines += [flow.lead + x for x in lines]
        elif tag in LISTS:
            lists.pop()
        elif tag in KEPT:
            pre -= 1
        if tag in ("textarea", "select", "option", "optgroup", "text", "button", "mtd"):
            flow.blank = flow.blank or bool(flow.now) and not flow.gap
        if tag in BLOCK and not (tag == "tr" and tables):
            flow.feed(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
            flow.indent, flow.mark = extra[:2]
    return flow.end()


def extract(page: str | None) -> str | None:
    """Visible text of one page; null stays null, an empty page gives an empty text."""
    return None if page is None else render(parse(page))


def texts(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, text) of every row, in no order.

    A null page gives a null text, an empty one an empty text; null keys stay;
    repeated rows give equal texts, an empty table gives no row, other columns are ignored.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(p) for p in b.column("text").to_pylist()], pa.string())], names=["key", "text"])

    return pages.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and text of every page; odd rows as in ``texts``."""
    return texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
