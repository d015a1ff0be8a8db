"""HTML extraction by layout-aware rendering: a tree builder with implied tags, visibility rules, and a text layout."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Element classes of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes datalist meta link base object audio video canvas svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table ul tr caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre hr figure fieldset".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt tr caption option optgroup".split()) | {"hr"}
TABLE_PARTS = frozenset("thead tbody tfoot tr td th caption colgroup col".split())
#: Start tag: open elements that it ends, and elements at which the search for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)\Z")
_SPACES = re.compile(r"[ \t\n\r\f]+")
#: Cells are padded to the widest of their column, up to this width.
PAD = 60
#: Tables are aligned while that makes at most so many fields for each cell and line of theirs; others are listed, each cell after its place.
ALIGNED = 64
#: Tables in so many others that have columns are listed as well.
NESTED = 8
#: Indents up to this are written as blanks, deeper ones as their number.
INDENT = 400
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        return attributes(self.attrs).get(name) if self.attrs else None


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree of a document (root: body; unseen parts are left out) and its style sheets."""
    root = Node("body")
    stack, styles, pos = Open(root), [], 0
    while True:
        m = _TOKEN.search(html, pos)
        if html[pos : m.start() if m else len(html)]:
            stack.put(unescape(html[pos : m.start() if m else len(html)]))
        if not m:
            return root, styles
        pos = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            close(stack, tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            text, pos = html[pos : end.start() if end else len(html)], end.end() if end else len(html)
            if tag == "style":
                styles.append(text)
            elif tag not in UNSEEN:
                node = Node(tag, attrs)
                node.children.append(unescape(text) if tag == "textarea" else text)
                stack.put(node)
            continue
        if tag in ("html", "head", "body"):
            if attrs and tag != "head":
                root.attrs += " " + attrs
            continue
        open_tag(stack, tag)
        node = Node(tag, attrs)
        stack.put(node)
        if tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "math")):
            stack.push(node)


class Open:
    """The open elements, with the places of each tag, so that no look-up walks the stack."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = [root]
        self.at: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        """The place of the innermost element of these tags; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Ends the elements from place k on."""
        while len(self.nodes) > max(k, 1):
            self.at[self.nodes.pop().tag].pop()

    def put(self, child: Node | str) -> None:
        """Adds to the innermost element."""
        self.nodes[-1].children.append(child)


def open_tag(stack: Open, tag: str) -> None:
    """Ends what the start tag implies ended, and opens the row or cell it implies."""
    if tag in CLOSES_P:
        end_within(stack, {"p"}, {"table", "td", "th", "button", "caption"})
    if tag in HEADINGS and stack.nodes[-1].tag in HEADINGS:
        stack.cut(len(stack.nodes) - 1)
    if tag in IMPLIED:
        ends, stops = IMPLIED[tag]
        if tag in TABLE_PARTS:
            outer = {"tr": {"td", "th"}, "thead": {"td", "th", "tr"}, "tbody": {"td", "th", "tr"}, "tfoot": {"td", "th", "tr"}}.get(tag, set())
            if outer:
                end_within(stack, outer, {"table"}, outermost=True)
        end_within(stack, ends, stops)
    if tag in ("td", "th") and stack.last("tr") < stack.last("table"):
        row = Node("tr")
        stack.put(row)
        stack.push(row)


def end_within(stack: Open, ends: set[str], stops: set[str], outermost: bool = False) -> None:
    """Closes the innermost (or outermost) open element in ``ends`` inside the innermost in ``stops``."""
    stop, at = stack.last(*stops), stack.last(*ends)
    if at <= stop:
        return
    if outermost:
        at = min(places[k] for t in ends if (places := stack.at.get(t)) and (k := bisect_right(places, stop)) < len(places))
    stack.cut(at)


def close(stack: Open, tag: str) -> None:
    """An end tag closes the nearest element of its name, but not across a table cell; </p> without <p> is an empty one."""
    if tag in ("body", "html", "head"):
        return
    if tag == "br":
        stack.put(Node("br"))
        return
    at, edge = stack.last(tag), 0 if tag in TABLE_PARTS or tag == "table" else stack.last("td", "th", "caption")
    if at and at >= edge:
        stack.cut(at)
    elif tag == "p":
        stack.put(Node("p"))


def uncommented(sheet: str) -> str:
    """The sheet without comments; one that isn't closed takes the rest."""
    out, at = [], 0
    while (begin := sheet.find("/*", at)) >= 0:
        out.append(sheet[at:begin])
        end = sheet.find("*/", begin + 2)
        if end < 0:
            return "".join(out)
        at = end + 2
    return "".join([*out, sheet[at:]])


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the innermost blocks, in one pass."""
    sheet, at, begin, selectors = uncommented(sheet), 0, -1, ""
    for m in re.finditer(r"[{}]", sheet):
        if m[0] == "{":
            selectors, begin = sheet[at : m.start()], m.end()
        elif begin >= 0:
            yield selectors, sheet[begin : m.start()]
            begin = -1
        at = m.end()


class Hidden:
    """Elements that inline style, attributes or simple style rules hide."""

    def __init__(self, styles: list[str]):
        #: simple selectors that hide, under one thing that an element must have: "#id", ".class" or a tag
        self.rules: dict[str, set[tuple[str, frozenset, str]]] = {}
        for sheet in styles:
            for selectors, declarations in style_rules(sheet):
                if _HIDING.search(declarations):
                    for sel in selectors.split(","):
                        if (s := _SIMPLE.match(sel.strip())) and sel.strip():
                            parts = re.findall(r"[.#][\w-]+", s[2])
                            ids, classes = [p for p in parts if p[0] == "#"], sorted(p for p in parts if p[0] == ".")
                            tag = (s[1] or "").lower()
                            self.rules.setdefault((ids or classes or [tag])[0], set()).add((tag, frozenset(p[1:] for p in classes), ids[0][1:] if ids else ""))

    def __call__(self, node: Node) -> bool:
        if node.tag in UNSEEN:
            return True
        if not node.attrs:
            return node.tag == "dialog" or any(not need and not own for _, need, own in self.rules.get(node.tag, ()))
        a = attributes(node.attrs)
        if "hidden" in a and a["hidden"].lower() != "until-found" or _HIDING.search(a.get("style", "")) or node.tag == "dialog" and "open" not in a:
            return True
        if node.tag == "input" and a.get("type", "").lower() == "hidden":
            return True
        classes, own_id = frozenset(a.get("class", "").split()), a.get("id", "")
        keys = [node.tag, *(f".{c}" for c in classes), f"#{own_id}"] if self.rules else ()
        return any((not tag or tag == node.tag) and need <= classes and (not own or own == own_id) for k in keys for tag, need, own in self.rules.get(k, ()))


class Text:
    """Lines of output: collapses blanks, and keeps one blank line between spaced blocks.

    A text within another (``up``) writes its lines into the same list, as (indent, line), so that
    none is copied at each level. Its first line stands after ``mark``, the others are indented by as much.
    """

    __slots__ = ("up", "mark", "lead", "drop", "lines", "any", "passed", "line", "gap", "space")

    def __init__(self, up: Text | None = None, mark: str = "", drop: bool = False):
        self.up, self.mark, self.drop = up, mark, drop  # drop: a blank first line goes
        self.lead: int = (up.lead if up else 0) + len(mark)
        self.lines: list[tuple[int, str]] = up.lines if up else []
        self.any, self.passed = False, False  # whether it has lines, and whether one of them was written
        self.line, self.gap, self.space = [], 0, False

    def add(self, text: str) -> None:
        first, self.any = not self.any, True
        if self.drop and first and not text:
            return
        fresh, at = [], self
        while at.up and not at.passed:
            fresh.append(at)
            at = at.up
        lead, marks = at.lead, []
        while fresh:
            one = fresh.pop()
            if one.up.any and one.up.gap:
                self.lines.append((0, ""))
                lead, marks = one.up.lead, []
            one.up.gap, one.up.any, one.passed = 0, True, True
            marks.append(one.mark)
        whole = "".join(marks) + text if text else ""
        bare = whole.lstrip(" ")
        self.lines.append((lead + len(whole) - len(bare) if bare else 0, bare))

    def words(self, s: str) -> None:
        flat = _SPACES.sub(" ", s)
        if flat == " " or not flat:
            self.space = self.space or bool(flat) and bool(self.line)
            return
        if (self.space or flat[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def raw(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for r in rest:
            self.end(keep=True)
            self.line.append(r)

    def end(self, keep: bool = False) -> None:
        text = "".join(self.line)
        if keep or text.strip():
            if self.any and self.gap:
                self.add("")
            self.gap = 0
            self.add(text.rstrip(" "))
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = max(self.gap, int(spaced))

    def done(self) -> list[str]:
        self.end()
        return [" " * lead + text if lead <= INDENT else f"[{lead}] {text}" for lead, text in self.lines]


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Level:
    """An element whose children are being laid out; when they are done, ``after`` follows in ``over``: a block's end (spaced or not), a blank or nothing."""

    __slots__ = ("rest", "tag", "count", "out", "pre", "over", "after")

    def __init__(self, node: Node, out: Text, pre: bool, over: Text, after: bool | str | None):
        self.rest, self.tag, self.out, self.pre, self.over, self.after = iter(node.children), node.tag, out, pre, over, after
        self.count = None
        if node.tag == "ol":
            start = node.get("start") or ""
            self.count = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1

    def done(self) -> None:
        if self.out is not self.over:
            self.out.end()
        if self.after == " ":
            self.over.words(" ")
        elif self.after is not None:
            self.over.block(self.after)


def layout(node: Node, hidden: Hidden, nested: int = 0) -> list[str]:
    """The lines of an element's content; ``nested``: how many tables with columns it is in."""
    out = Text()
    work = [Level(node, out, False, out, None)]
    while work:
        at = work[-1]
        for child in at.rest:
            if isinstance(child, str):
                at.out.raw(child) if at.pre else at.out.words(child)
            elif child.tag == "br":
                at.out.end(keep=True)
            elif child.tag == "#line":
                at.out.add(child.attrs)
            elif child.tag[0] == "#" or not hidden(child):
                work.append(enter(at, child, hidden, nested))
                break
        else:
            work.pop().done()
    return out.done()


def enter(at: Level, child: Node, hidden: Hidden, nested: int) -> Level:
    """Begins an element inside of ``at``."""
    tag, out = child.tag, at.out

    def inner(mark: str, spaced: bool, pre: bool = False, node: Node = child) -> Level:
        out.block(spaced)
        return Level(node, Text(out, mark, pre), pre, out, spaced)

    if tag == "#part":
        return inner(child.attrs, False)
    if tag == "table":
        return inner("", True, node=table(child, hidden, nested))
    if tag == "li":
        value = child.get("value") or ""
        if at.count is not None and re.fullmatch(r"-?\d{1,9}", value):
            at.count = int(value)
        mark = f"{at.count}. " if at.count is not None else "- "
        at.count = None if at.count is None else at.count + 1
        return inner(mark, False)
    if tag in ("blockquote", "dd"):
        return inner("  ", tag == "blockquote")
    if tag in ("ul", "ol", "menu", "dir"):
        return inner("", at.tag != "li")
    if tag == "hr":
        rule = Node("#rule")
        rule.children.append("-" * 20)
        return inner("", True, node=rule)
    if tag == "details" and child.get("open") is None:
        out.block(False)
        shown = next((c for c in child.children if isinstance(c, Node) and c.tag == "summary" and not hidden(c)), Node("summary"))
        return Level(shown, out, at.pre, out, False)
    if tag in ("td", "th"):
        return Level(child, out, at.pre, out, " ")
    if tag in ("pre", "textarea", "xmp"):
        return inner("", tag == "pre", pre=True)
    if tag in BLOCK:
        out.block(tag in SPACED)
        return Level(child, out, at.pre, out, tag in SPACED)
    return Level(child, out, at.pre, out, None)


class Taken:
    """Columns that cells of earlier rows reach into, as sorted ranges that don't meet."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def gap(self, col: int) -> tuple[float, float]:
        """The first free column from ``col`` on, and where the free ones end."""
        k = bisect_right(self.begins, col)
        if k and self.ends[k - 1] > col:
            col = self.ends[k - 1]
        return col, self.begins[k] if k < len(self.begins) else math.inf

    def hold(self, begin: int, end: int) -> None:
        k = bisect_right(self.begins, begin)
        joins_left, joins_right = k > 0 and self.ends[k - 1] == begin, k < len(self.begins) and self.begins[k] == end
        low, high = (self.begins[k - 1] if joins_left else begin), (self.ends[k] if joins_right else end)
        at = slice(k - joins_left, k + joins_right)
        self.begins[at], self.ends[at] = [low], [high]

    def free(self, begin: int, end: int) -> None:
        k = bisect_right(self.begins, begin) - 1
        low, high = self.begins[k], self.ends[k]
        left = [(a, b) for a, b in ((low, begin), (end, high)) if a < b]
        self.begins[k : k + 1], self.ends[k : k + 1] = [a for a, _ in left], [b for _, b in left]


def part(children: list[Node | str], mark: str = "") -> Node:
    """Content that is laid out by itself."""
    out = Node("#part", mark)
    out.children = children
    return out


def span(cell: Node, name: str, most: int) -> int:
    found = re.match(r"[ \t\n\r\f]*\+?(\d+)", cell.get(name) or "")
    digits = found[1].lstrip("0") if found else ""
    return (min(int(digits), most) if len(digits) < 10 else most) if digits else 1


def table(node: Node, hidden: Hidden, nested: int) -> Node:
    """Rows of aligned cells; a cell with several lines makes a row of several; spans keep their columns.

    Where few of the fields have a cell (ALIGNED) or tables lie in many others (NESTED), each cell is
    listed by itself after its row and column, as in "[2,5] text", so that its place isn't lost.
    """
    whole, rows = Node("#table"), []
    todo = [iter(node.children)]
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
        elif isinstance(c, str):
            if c.strip():
                whole.children.append(part([_SPACES.sub(" ", c).strip()]))
        elif hidden(c) or c.tag in ("colgroup", "col"):
            continue
        elif c.tag == "caption":
            whole.children.append(part(c.children))
        elif c.tag == "tr":
            rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and not hidden(x)])
            stray = [x for x in c.children if isinstance(x, str) and x.strip() or isinstance(x, Node) and x.tag not in ("td", "th")]
            whole.children += [part(stray)] if stray else []
        elif c.tag in ("thead", "tbody", "tfoot"):
            todo.append(iter(c.children))
        else:
            whole.children.append(part([c]))
    grid = places(rows)
    columns = sorted({col for row in grid for col in row})
    if len(columns) < 2:
        whole.children += [part(cell.children) for row in grid for cell in row.values()]
        return whole
    if nested >= NESTED:
        whole.children += [part(cell.children, f"[{r},{col + 1}] ") for r, row in enumerate(grid, 1) for col, cell in row.items()]
        return whole
    texts = [{col: layout(cell, hidden, nested + 1) for col, cell in row.items()} for row in grid]
    high = [max([len(v) for v in row.values()], default=0) for row in texts]
    if sum(high) * len(columns) > ALIGNED * sum(1 + len(v) for row in texts for v in row.values()):
        whole.children += [part([Node("#line", s) for s in lines], f"[{r},{col + 1}] ") for r, row in enumerate(texts, 1) for col, lines in row.items()]
        return whole
    pads = dict.fromkeys(columns, 0)
    for row in texts:
        for col, lines in row.items():
            pads[col] = min(PAD, max([pads[col], *map(width, lines)]))
    for row, n in zip(texts, high):
        for k in range(n):
            fields = []
            for col in columns:
                s = row[col][k] if col in row and k < len(row[col]) else ""
                fields.append(s + " " * max(0, pads[col] - width(s)))
            whole.children.append(Node("#line", "  ".join(fields).rstrip(" ")))
    return whole


def places(rows: list[list[Node]]) -> list[dict[int, Node]]:
    """The cells of each row by their column; spans are held to 1,000 columns and 65,534 rows, as the HTML standard says."""
    grid: list[dict[int, Node]] = []
    taken, ends = Taken(), {}
    for r, cells in enumerate(rows):
        row, col, later = {}, 0, []
        for begin, end in ends.pop(r, ()):
            taken.free(begin, end)
        for cell in cells:
            col, limit = taken.gap(col)
            row[col] = cell
            wide, deep = span(cell, "colspan", 1000), span(cell, "rowspan", 65534)
            if deep > 1 and r + 1 < len(rows):
                later.append((col, min(col + wide, limit), r + deep))
            col += wide
        for begin, end, until in later:
            taken.hold(begin, end)
            ends.setdefault(until, []).append((begin, end))
        grid.append(row)
    return grid


def render(html: str | None) -> str:
    """All visible text of a document, laid out; empty for null or blank input."""
    if not html or not html.strip():
        return ""
    root, styles = parse(html)
    hidden = Hidden(styles)
    if hidden(root):
        return ""
    lines = layout(root, hidden)
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with a column ``rendered``: the visible text of each document.

    Null and blank documents give an empty text; malformed ones are repaired as tree builders do;
    whole documents are read. Elements nest to any depth; indents beyond 400 columns are written as their
    number ("[402] text"), and cells of very sparse or deeply nested tables after their row and column. Rows,
    repeated ones too, and other columns stay, but that a column ``rendered`` of ``pages`` is replaced; no shuffle.
    """
    small_batches(pages.sparkSession, 200)

    def run(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in documents:
            yield pd.Series([render(x if isinstance(x, str) else None) for x in some], dtype="object")

    return pages.withColumn("rendered", F.pandas_udf(run, "string")(F.col(html_col)))
