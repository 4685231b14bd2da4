"""HTML extraction: layout-aware rendering.

A tolerant tree builder closes and opens implied tags; a renderer walks the tree and writes all visible text: blocks begin on lines of
their own, paragraphs and headings are set off by an empty line, list items get markers and indents, preformatted text
keeps its spaces, and table cells are padded to their columns. What a browser wouldn't show isn't written: scripts and what
stands for them, styles, templates, heads, comments, elements hidden by attribute or by inline style (`visibility` is inherited, and can be
taken back inside), closed details and dialogs, what only defines or describes parts of a drawing or formula, and what stands for
audio, video and canvas. Nothing is loaded, so an object shows its fallback. A tag that the page's end cuts off isn't shown.

Neither step recurses or goes back: the scanner passes each character a bounded number of times, open tags are found by name, and
indents, nested tables and padding have limits beyond which text stands without them. So time and memory grow with the page's length, whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
#: What follows a tag's name. A quote opens a value only behind an equals sign, and only if it is closed.
_INSIDE = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+>""")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_LONG_REF = re.compile(r"&#0*[0-9]{8,};?")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
_TEXT_ONLY = frozenset("textarea title".split())
_UNSEEN = frozenset("head title script style template iframe noembed noframes noscript datalist audio video canvas".split())
#: What isn't shown inside drawings and formulas.
_UNSEEN_IN = {
    "svg": frozenset("desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
_FOREIGN = frozenset("svg math foreignobject annotation-xml".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: What a start tag closes, and what the search for it stops at.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
    "body": ({"head"}, set()),
}
_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SHOWN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Levels of indent that are written, levels of tables that are laid out as such, and the width that columns are limited to where
#: padding them in full would take more than `PADDING` characters and eight times the table's text.
INDENTS, TABLES, WIDEST, PADDING = 64, 32, 48, 1 << 18


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Open:
    """The stack of open elements, with the places of each tag in it."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.pop()

    def last(self, tags) -> int:
        """Place of the innermost of these, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags, stops) -> None:
        """Closes the innermost of `tags`, with those of `tags` directly around it, unless one of `stops` stands within."""
        place = self.last(tags)
        if place and place > self.last(stops - tags):
            while place > 1 and self.nodes[place - 1].tag in tags:
                place -= 1
            self.cut(place)


def unescape(text: str) -> str:
    """Character references; a number beyond all characters is U+FFFD."""
    return html.unescape(_LONG_REF.sub("\ufffd", text)) if "&" in text else text


def parse(source: str) -> Node:
    """The tree, with implied tags; whatever the input, every character is in some node, tag or comment."""
    root = Node("", {})
    open_, at, n = _Open(root), 0, len(source)

    def text(s: str) -> None:
        if s:
            if open_.nodes[-1].tag == "head" and not s.isspace():
                open_.pop()
            kids = open_.nodes[-1].kids
            if kids and isinstance(kids[-1], list):
                kids[-1].append(s)
            else:
                kids.append([s])

    def add(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        open_.nodes[-1].kids.append(node)
        if tag not in _VOID:
            open_.push(node)

    while at < n:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        text(source[at:start])
        m = _NAME.match(source, start)
        if not m:
            after = source[start + 1 : start + 2]
            if after in ("!", "?") or (after == "/" and start + 2 < n):
                if source.startswith("<!--", start):
                    at = _COMMENT.match(source, start).end()
                else:
                    at = source.find(">", start) + 1 or n
            else:
                text("<")
                at = start + 1
            continue
        inside = _INSIDE.match(source, m.end())
        if not inside:  # cut off
            break
        at, tag = inside.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                add("br", {})
            elif tag == "p" and not open_.places["p"]:
                add("p", {})
                open_.pop()
            else:
                fence = {"table", "td", "th"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else set()
                place = open_.last((tag,))
                if place and place > open_.last(fence):
                    open_.cut(place)
            continue
        said = source[m.end() : at - 1]
        attrs = {}
        for a in _ATTR.finditer(said):
            attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if open_.nodes[-1].tag == "head" and tag not in _IN_HEAD:
            open_.pop()
        if said.endswith("/") and open_.nodes[open_.last(_FOREIGN)].tag in ("svg", "math"):
            open_.nodes[-1].kids.append(Node(tag, attrs))
            continue
        if tag in _ENDS_P:
            open_.close({"p"}, {"td", "th", "table", "button", "object", "template"})
        if tag in _IMPLIED:
            open_.close(*_IMPLIED[tag])
            if tag in ("td", "th") and open_.nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
                add("tr", {})
        add(tag, attrs)
        if tag in _RAW or tag in _TEXT_ONLY:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            text(source[at : end.start() if end else n])
            open_.pop()
            at = source.find(">", end.start()) + 1 or n if end else n
    return root


def shown(node: Node) -> bool:
    """Whether the element has a box at all."""
    a = node.attrs
    return not (node.tag in _UNSEEN or "hidden" in a or ("style" in a and _HIDES.search(a["style"])) or (node.tag == "dialog" and "open" not in a))


def hidden(node: Node, within: bool) -> bool:
    """Whether its own text is invisible, given whether that around it is."""
    found = _SHOWN.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return found[-1].lower() != "visible" if found else within


class _Box:
    """Lines that are being written: of the page, or of a table cell."""

    def __init__(self):
        self.lines, self.run, self.apart, self.indent, self.marker = [], [], False, 0, None

    def margin(self) -> str:
        return "  " * min(self.indent, INDENTS)

    def put(self, line: str) -> None:
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = False
        if self.marker is not None:
            line, self.marker = self.marker + line, None
        elif line:
            line = self.margin() + line
        self.lines.append(line.rstrip())

    def end_line(self, apart: bool = False) -> None:
        line = _SPACE.sub(" ", "".join(self.run)).strip(" ")
        self.run.clear()
        if line:
            self.put(line)
        self.apart |= apart


def _span(node: Node, name: str, least: int, most: int) -> int:
    """colspan and rowspan within the bounds that HTML gives them."""
    said = node.attrs.get(name, "1").strip()
    if not (said.isascii() and said.isdigit()):
        return 1
    return min(max(int(said[:9]), least), most)


class _Table:
    def __init__(self):
        self.rows, self.groups = [], set()

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """(from column, to column, lines) of each row's cells; a cell that spans rows holds its columns until its row group ends."""
        ends = sorted(self.groups | {len(self.rows)})
        out, taken, group = [], [], 0  # taken: (from, to, until row), in order
        for i, row in enumerate(self.rows):
            while ends[group] <= i:
                group += 1
                taken = []
            taken = [t for t in taken if t[2] > i]
            at, cells, more, k = 0, [], [], 0
            for lines, span, down in row:
                while k < len(taken) and taken[k][0] <= at:
                    at = max(at, taken[k][1])
                    k += 1
                cells.append((at, at + span, lines))
                if down != 1:
                    more.append((at, at + span, min(i + down, ends[group]) if down else ends[group]))
                at += span
            joined: list[tuple[int, int, int]] = []
            for t in sorted(taken + more):
                if joined and joined[-1][1] >= t[0] and joined[-1][2] == t[2]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], t[1]), t[2])
                else:
                    joined.append(t)
            taken = joined
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        rows = self.placed()
        edges = {c: k for k, c in enumerate(sorted({x for row in rows for a, b, _ in row for x in (a, b)}))}  # only columns that some cell begins or ends at
        rows = [[(edges[a], edges[b], lines) for a, b, lines in row] for row in rows]
        wide = [0] * len(edges)
        for row in rows:
            for a, b, lines in row:
                if b == a + 1:
                    wide[a] = max([wide[a], *map(len, lines)])
        upto = [0, *accumulate(wide)]
        full = sum(max((len(lines) for _, _, lines in row), default=0) * (upto[row[-1][0]] if row else 0) for row in rows)
        if full > PADDING + 8 * sum(len(x) for row in rows for _, _, lines in row for x in lines):
            wide = [min(w, WIDEST) for w in wide]
        total = [0, *accumulate(w + 2 for w in wide)]
        out = []
        for row in rows:
            # where each cell begins; a cell that is longer than its columns moves those behind it
            for pieces in zip_longest(*(lines for _, _, lines in row), fillvalue=""):
                line: list[str] = []
                size = 0
                for (a, _, _), piece in zip(row, pieces):
                    if piece:
                        gap = max(total[a] - size, 2 if size else 0)
                        line += (" " * gap, piece)
                        size += gap + len(piece)
                out.append("".join(line))
        return out


def render(root: Node) -> str:
    boxes, tables, lists, pre, foreign = [_Box()], [], [], 0, []
    stack: list = [(root, iter(root.kids), False, False)]  # element, its kids, whether its text is invisible, whether it is laid out as a table's part
    while stack:
        node, kids, unseen, laid = stack[-1]
        kid, box = next(kids, None), boxes[-1]
        tag = node.tag
        if kid is None:
            stack.pop()
            if tag in _FOREIGN:
                foreign.pop()
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].groups.add(len(tables[-1].rows))
            elif tag == "text" and foreign and foreign[-1] == "svg":
                box.run.append(" ")
            if tag == "pre":
                pre -= 1
                if line := "".join(box.run).rstrip():
                    box.put(line)
                box.run.clear()
            if laid and tag in ("td", "th"):
                box.end_line()
                boxes.pop()
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append((box.lines, _span(node, "colspan", 1, 1000), _span(node, "rowspan", 0, 65534)))
            elif laid and tag == "table":
                box.end_line()
                for line in tables.pop().lines():
                    box.put(line)
                box.apart = True
            elif tag in _BLOCK or tag in ("td", "th"):
                box.end_line(tag in _SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                box.marker = None
                box.indent -= 1
            continue
        if isinstance(kid, list):
            said = "" if unseen else unescape("".join(kid))
            if pre:
                first, *rest = said.split("\n")
                box.run.append(first)
                for line in rest:
                    box.put("".join(box.run).rstrip())
                    box.run = [line]
            elif said and not (tables and len(boxes) <= len(tables) and said.isspace()):
                box.run.append(said)
            continue
        tag = kid.tag
        if not shown(kid):
            continue
        invisible = hidden(kid, unseen)
        if foreign:
            if tag in _UNSEEN_IN.get(foreign[-1], ()):
                continue
            if foreign[-1] == "svg":
                if kid.attrs.get("display") == "none":
                    continue
                if "visibility" in kid.attrs and not _SHOWN.search(kid.attrs.get("style", "")):
                    invisible = kid.attrs["visibility"] in ("hidden", "collapse")
        if tag in _FOREIGN:
            foreign.append(tag)
        elif tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1].groups.add(len(tables[-1].rows))
        elif tag == "text" and foreign and foreign[-1] == "svg":
            box.run.append(" ")
        if tag == "br":
            if box.run and "".join(box.run).strip():
                box.end_line()
            elif box.lines or box.run:
                box.run.clear()
                box.put("")
            continue
        if tag == "img" or tag in ("input", "wbr"):
            continue
        part = False
        if tag in ("td", "th"):
            part = bool(tables) and len(boxes) == len(tables)  # not of a table that is nested too deep
            if part:
                boxes.append(_Box())
            else:
                box.end_line()
        elif tag == "tr" and tables and len(boxes) == len(tables):
            box.end_line()
            tables[-1].rows.append([])
        elif tag in _BLOCK:
            box.end_line(tag in _SPACED and not (tag in ("ul", "ol") and lists))
            if tag == "table" and len(tables) < TABLES and len(boxes) == len(tables) + 1:
                part = True
                tables.append(_Table())
            elif tag in ("ul", "ol", "menu", "dir"):
                step = -1 if tag == "ol" and "reversed" in kid.attrs else 1
                first = 1 if step > 0 else sum(isinstance(x, Node) and x.tag == "li" for x in kid.kids)
                lists.append([tag, _number(kid.attrs.get("start"), first), step])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    now = _number(kid.attrs.get("value"), lists[-1][1])
                    mark, lists[-1][1] = f"{now}. ", now + lists[-1][2]
                box.marker = None if invisible else box.margin() + mark
            if tag in ("li", "dd", "blockquote"):
                box.indent += 1
            pre += tag == "pre"
        if tag == "details" and "open" not in kid.attrs:
            stack.append((kid, iter([x for x in kid.kids if isinstance(x, Node) and x.tag == "summary"][:1]), invisible, part))
        elif tag not in _VOID:
            stack.append((kid, iter(kid.kids), invisible, part))
    boxes[0].end_line()
    return "\n".join(boxes[0].lines).strip("\n")


def _number(said: str | None, otherwise: int) -> int:
    """A list's number, as far as HTML reads it (32 bits)."""
    found = re.match(r"\s*([+-]?[0-9]{1,10})", said or "")
    return int(found[1]) if found and abs(int(found[1])) < 1 << 31 else otherwise


def _rendered(batches: Iterator[pa.RecordBatch], at: int, keep: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A few pages at a time, so that a batch of long ones isn't held as text twice."""
    for batch in batches:
        for a in range(0, len(batch), 64):
            part = batch.slice(a, 64)
            said = [None if x is None else render(parse(x)) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(said, pa.string())], names)


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """Every row with `text`, what its HTML shows.

    Null gives null, empty and invisible pages an empty text. Broken markup of any kind is read to its end. Repeated rows stay, other
    columns stay; one named `text` is replaced. An empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c.lower() != "text"]
    (name,) = fresh(pages.columns, "source")
    rows = pages.select(*kept, F.col(source).alias(name))
    at, keep = len(kept), list(range(len(kept)))
    return rows.mapInArrow(lambda batches: _rendered(batches, at, keep, [*kept, "text"]), T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())]))


def page_texts(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """page_id and text alone, as `extract_text` gives it; the HTML itself doesn't travel back."""
    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(source).alias("html")).mapInArrow(lambda batches: _rendered(batches, 1, [0], ["page_id", "text"]), f"page_id {kind}, text string")
