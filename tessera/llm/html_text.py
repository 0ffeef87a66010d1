"""HTML extraction: a tree with implied tags, visibility rules, and a rendering that keeps the layout.

``parse`` builds a tree the way browsers do where it matters for text: raw-text elements, void elements, end tags that
are implied (p, li, dt/dd, option, table parts), a table's missing body, and end tags without a start. ``render`` gives
the visible text: nothing from head, script, style, template or elements that are not displayed (the hidden attribute, or
display:none in a style attribute or for a plain selector of a style sheet; aria-hidden does not hide), no text where
visibility is hidden by the same means and not made visible again further in, block spacing, list markers with nesting,
preformatted text as it is, and tables with cells aligned by column over column and row spans. Text that stands in a
table outside of its cells comes before the table, as browsers place it.

Nulls: a null page gives a null text, an empty one an empty text. Pages are handled row by row, whatever their length and
depth: nothing here calls itself. Repeated rows give repeated rows, an empty table an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noembed noframes iframe object audio video canvas datalist param source track map meta link title base".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp caption colgroup".split()
)
#: Blocks set off by an empty line, by the default style of browsers.
SPACED = frozenset("p blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol ul menu dir pre listing table hr".split())
#: Start tags that end an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul listing xmp plaintext".split())
#: start tag -> (open elements that it ends, elements beyond which it does not look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: End tags do not close what lies beyond these.
SCOPE = frozenset("table td th caption html template object".split())

TAG = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>|<(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: The most that the standard lets a cell span, and the numbers that lists can count to.
MOST_COLUMNS, MOST_ROWS, MOST_COUNT = 1000, 65534, (1 << 31) - 1


class Node:
    __slots__ = ("tag", "attrs", "kids", "shown", "lines")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.shown = True  # whether its own text is visible
        self.lines: list[str] | None = None  # of a table, once it is laid out


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value))
    return out


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack = [root]
    gone: set[str] = set()
    unseen: set[str] = set()
    opened: Counter[str] = Counter()  # of the stack, so that what is not open is not looked for
    at, n = 0, len(html)

    def push(node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        opened[node.tag] += 1

    def cut_at(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def close_implied(ends: set[str] | frozenset, stop: set[str] | frozenset) -> None:
        """Close the outermost of the open ``ends`` on this side of ``stop``, and all inside it."""
        cut = None
        if not any(opened[tag] for tag in ends):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in ends:
                cut = i
        if cut is not None:
            cut_at(cut)

    while at < n:
        m = TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if stack[-1].tag == "head" and text.strip():
                cut_at(len(stack) - 1)  # bare text ends a head
            stack[-1].kids.append(unescape(text))
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].kids.append(m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
                continue
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i].tag == tag:
                    cut_at(i)
                    break
                if stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
                if stack[i].tag == "table" and tag != "table":
                    break
            else:
                if tag == "p":
                    stack[-1].kids.append(Node("p", {}))  # an end without a start is an empty paragraph
        elif m["start"]:
            tag = m["start"].lower()
            attrs = m["attrs"] or ""
            if tag == "html":
                continue
            if tag in ENDS_P:
                close_implied({"p"}, SCOPE | {"button"})
            if tag in IMPLIED:
                close_implied(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr", {}))
            if tag == "body" or (tag not in ("head", "title", "meta", "link", "base", "script", "style", "template", "noscript") and stack[-1].tag == "head"):
                if stack[-1].tag == "head":
                    cut_at(len(stack) - 1)
            node = Node(tag, attributes(attrs) if attrs.strip(" /\t\n\r\f") else {})
            if tag in VOID:
                stack[-1].kids.append(node)
                continue
            if tag in RAW or tag in ESCAPABLE:
                stack[-1].kids.append(node)
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                body = html[at : end.start()] if end else html[at:]
                node.kids.append(unescape(body) if tag in ESCAPABLE else body)
                at = end.end() if end else n
                if tag == "style":
                    for found, rule in ((gone, NOT_DISPLAYED), (unseen, VISIBILITY)):
                        found |= hiding_selectors(body, rule)
                continue
            push(node)
    todo = [root] if gone or unseen or "visibility" in html.lower() else []
    while todo:  # parents come before their children, which take over what they do not set
        node = todo.pop()
        names = {node.tag, f"#{node.attrs.get('id')}", *(f".{c}" for c in node.attrs.get("class", "").split())}
        names |= {f"{node.tag}{x}" for x in names}
        if gone & names:
            node.attrs["hidden"] = ""
        said = VISIBILITY.findall(node.attrs.get("style", ""))
        if said:
            node.shown = said[-1].lower() == "visible"
        elif unseen & names:
            node.shown = False
        for kid in node.kids:
            if not isinstance(kid, str):
                kid.shown = node.shown
                todo.append(kid)
    return root


def hiding_selectors(css: str, rule: re.Pattern) -> set[str]:
    """The plain selectors (tag, .class, #id, tag.class, tag#id) that a style sheet hides by ``rule`` outside of @-rules."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
    css = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^{};]*;", "", css)
    found: set[str] = set()
    for names, body in re.findall(r"([^{}]+)\{([^{}]*)\}", css):
        hit = rule.search(body)
        if hit and not (hit.groups() and hit[1].lower() == "visible"):
            found |= {x for x in (y.strip() for y in names.split(",")) if re.fullmatch(r"[A-Za-z][\w-]*|(?:[A-Za-z][\w-]*)?[.#][\w-]+", x)}
    return {x if x[0] in ".#" else re.sub(r"^[^.#]+", lambda m: m[0].lower(), x) for x in found}


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    if node.attrs:
        if "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found":
            return True
        if "style" in node.attrs and NOT_DISPLAYED.search(node.attrs["style"]):
            return True
        if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
            return True
        if node.tag == "dialog" and "open" not in node.attrs:
            return True
    return node.tag == "dialog" and not node.attrs


class Writer:
    """Lines of text with collapsed spaces, pending breaks and an indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # line breaks owed before the next text
        self.blank = False  # a collapsed space is owed
        self.indent = ""
        self.mark = ""  # list marker for the next line

    def text(self, s: str) -> None:
        if not s:
            return
        parts = SPACES.sub(" ", s)
        if parts == " ":
            self.blank = True
            return
        if parts[0] == " ":
            self.blank = True
        self._ready()
        if self.blank and self.now and not self.now[-1].endswith(" "):
            self.now.append(" ")
        self.now.append(parts.strip(" "))
        self.blank = parts[-1] == " "

    def _ready(self) -> None:
        if not self.now:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.now.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
            self.blank = False

    def line(self, s: str) -> None:
        """A line of its own, as it is."""
        self.end()
        if self.gap > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0
        lead = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
        self.mark = ""
        self.lines.append((lead + s).rstrip())

    def whole(self, lines: list[str]) -> None:
        """Lines as they are, all at once where no indent is to be put before them."""
        if self.indent or self.mark or not lines:
            for s in lines:
                self.line(s)
        else:
            self.line(lines[0])
            self.lines.extend(lines[1:])

    def end(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.blank = False

    def block(self, breaks: int) -> None:
        self.end()
        self.gap = max(self.gap, breaks)


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


def _number(value: str | None, default: int, low: int, high: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,12})", value or "")
    return min(high, max(low, int(m[1]))) if m else default


def _rows(table: Node) -> tuple[list, list[Node], list[list[tuple[int, Node]]]]:
    """What of a table stands outside of its cells, its captions, and its rows of (column, cell).

    A cell takes the first column that no row span from above holds.
    """
    stray: list = []
    captions: list[Node] = []
    rows: list[list[tuple[int, Node]]] = []
    held: dict[int, int] = {}  # column -> rows that a span still covers, the next one included
    todo: list = [("", kid) for kid in reversed(table.kids)]
    while todo:
        group, kid = todo.pop()
        if kid == "/":
            held.clear()  # spans end with their group of rows
        elif isinstance(kid, str):
            stray.append(kid) if kid.strip() else None
        elif hidden(kid) or kid.tag in ("col", "colgroup"):
            continue
        elif kid.tag == "caption":
            captions.append(kid)
        elif kid.tag in ("tbody", "thead", "tfoot") and not group:
            todo.append((kid.tag, "/"))
            todo.extend((kid.tag, k) for k in reversed(kid.kids))
        elif kid.tag == "tr":
            cells: list[tuple[int, Node]] = []
            column = 0
            new: dict[int, int] = {}
            for cell in kid.kids:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    if not isinstance(cell, str) or cell.strip():
                        stray.append(cell)
                    continue
                if hidden(cell):
                    continue
                while column in held:
                    column += 1
                cells.append((column, cell))
                wide = _number(cell.attrs.get("colspan"), 1, 1, MOST_COLUMNS)
                high = _number(cell.attrs.get("rowspan"), 1, 0, MOST_ROWS) or MOST_ROWS  # 0: to the group's end
                if high > 1:
                    new.update((c, high) for c in range(column, column + wide))
                column += wide
            held.update(new)
            held = {c: n - 1 for c, n in held.items() if n > 1}
            rows.append(cells)
        else:
            stray.append(kid)
    return stray, captions, rows


def table_lines(table: Node) -> list[str]:
    """The table's rows with columns padded to the widest cell. A cell that spans columns goes over their widths and the
    gaps between; where it is wider the last of them widens."""
    stray, captions, rows = _rows(table)
    out = _render(stray) if stray else []
    for c in captions:
        out.extend(_render([c]))
    laid = [[(column, _number(cell.attrs.get("colspan"), 1, 1, MOST_COLUMNS), _render(cell.kids, cell)) for column, cell in row] for row in rows]
    used = sorted({column for row in laid for column, _, lines in row if lines})
    if len(used) <= 1:
        for row in laid:
            for _, _, lines in row:
                out.extend(lines)
        return out
    wide = dict.fromkeys(used, 0)
    spans: list[tuple[list[int], int]] = []
    for row in laid:
        for column, span, lines in row:
            if lines:
                most = max(map(width, lines))
                over = [c for c in used if column <= c < column + span] if span > 1 else [column]
                if len(over) > 1:
                    spans.append((over, most))
                else:
                    wide[column] = max(wide[column], most)
    for over, most in sorted(spans, key=lambda x: (len(x[0]), x[0])):
        wide[over[-1]] += max(0, most - sum(wide[c] for c in over) - 2 * (len(over) - 1))
    starts, at = {}, 0
    for c in used:
        starts[c] = at
        at += wide[c] + 2
    for row in laid:
        row = [(starts[column], lines) for column, _, lines in row if lines]
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line, end = [], 0
            for start, lines in row:
                if k < len(lines) and lines[k]:
                    line.append(" " * (start - end) + lines[k])
                    end = start + width(lines[k])
            out.append("".join(line).rstrip())
    return out


def lay_out(root: Node) -> None:
    """Lays out every table below ``root``, the inner ones first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "table":
            order.append(node)
        todo.extend(kid for kid in node.kids if not isinstance(kid, str))
    for table in reversed(order):
        table.lines = table_lines(table)


def _render(kids: list, parent: Node | None = None) -> list[str]:
    """The lines of ``kids``, whose tables are laid out already; bare strings are as visible as ``parent``."""
    w = Writer()
    # an explicit stack: pages may nest deeper than Python's calls
    shown = parent is None or parent.shown
    todo: list = [("open", k, shown) for k in reversed(kids)]
    lists: list[list] = []
    pre = 0
    while todo:
        what, item, extra = todo.pop()
        if what == "close":
            if item.tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if item.tag in ("pre", "listing"):
                pre -= 1
            if extra:
                w.end()
                w.indent = w.indent[:-extra]
                w.mark = ""
            if item.tag in BLOCK:
                w.block(2 if item.tag in SPACED and not (lists and item.tag in ("ul", "ol")) else 1)
            elif item.tag == "q" and item.shown:
                w.text("”")
            continue
        if isinstance(item, str):
            if not extra:
                continue
            if pre:
                first, *rest = item.replace("\r\n", "\n").split("\n")
                if first:
                    w._ready()
                    w.now.append(first)
                for s in rest:
                    if not w.now:
                        w.line("")
                    else:
                        w.end()
                    if s:
                        w._ready()
                        w.now.append(s)
            else:
                w.text(item)
            continue
        if hidden(item):
            continue
        tag, extra, shown = item.tag, 0, item.shown
        if tag == "br":
            if w.now:
                w.end()
            else:
                w.gap = max(w.gap, 1) + 1 if w.gap else 1
            continue
        if tag == "img":
            if item.attrs.get("alt") and shown:
                w.text(item.attrs["alt"])
            continue
        if tag == "input":
            if item.attrs.get("value") and shown and item.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel"):
                w.text(f" {item.attrs['value']} ")
            continue
        if tag in BLOCK:
            w.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol")) else 1)
        if tag == "hr":
            if shown:
                w.line("---")
            w.block(2)
            continue
        if tag == "table":
            w.whole(item.lines or [])
            w.block(2)
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(item.attrs.get("start"), 1, -MOST_COUNT, MOST_COUNT) if tag == "ol" else 0])
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                value = _number(item.attrs.get("value"), lists[-1][1], -MOST_COUNT, MOST_COUNT)
                lists[-1][1] = value + 1
                mark = f"{value}. "
            extra = len(mark)
            w.indent += " " * extra
            w.mark = mark if shown else ""
        elif tag == "blockquote":
            extra = 2
            w.indent += "  "
        elif tag == "dd":
            extra = 2
            w.indent += "  "
        elif tag in ("pre", "listing"):
            pre += 1
            if item.kids and isinstance(item.kids[0], str) and item.kids[0].startswith("\n"):
                item.kids[0] = item.kids[0][1:]
        elif tag == "q" and shown:
            w.text("“")
        elif tag in ("td", "th"):
            w.blank = True
        todo.append(("close", item, extra))
        todo.extend(("open", k, shown) for k in reversed(item.kids))
    w.end()
    lines = w.lines
    while lines and not lines[-1]:
        lines.pop()
    return lines


def render(html: str | None) -> str | None:
    """The visible text of a page."""
    if html is None:
        return None
    root = parse(html)
    lay_out(root)
    return "\n".join(_render(root.kids))


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and ``text``, one row per input row."""
    ship(df.sparkSession)
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([render(h) for h in b.column(b.num_columns - 1).to_pylist()], pa.string())], names=b.schema.names)

    kinds = ", ".join(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return src.mapInArrow(run, f"{kinds}, h string").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("h").alias("text"))


def op2(df: DataFrame) -> DataFrame:
    return extract(df)
