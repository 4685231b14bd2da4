"""Formulas, drawings, fallbacks, cells that span rows, broken and degenerate pages, and a plain renderer over a whole table."""

import html
import time
from html.parser import HTMLParser

import pytest

from foliant.llm.html_layout import extract_text, page_texts, parse, render

SF = "/root/testdata/sf0.001"


def _text(source):
    return render(parse(source))


def test_formulas_drawings_and_fallbacks():
    assert _text("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2 TeX</annotation></semantics></math> holds") == "so x=2 holds"
    svg = "<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><style>s{}</style><script>1</script><defs/><title/><path d='M0'/><text>left</text><text>right</text><text display=none>off</text></svg>"
    assert _text(f"<p>a {svg} b</p><p>c") == "a left right b\n\nc"
    assert _text("<object data=x><p>no viewer</p></object><desc>plain</desc>") == "no viewer\n\nplain"
    assert _text("<svg><foreignObject><div>in</div><p/>side</foreignObject></svg>") == "in\n\nside"


def test_rowspan():
    rows = "<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h"
    assert _text(f"<table>{rows}</table>") == "a  b  c\n   d  e\nf  g  h"
    assert _text("<table><tr><td>x<td rowspan=0>y<td>z<tr><td>1<td>2<tr><td>3<td>4</table>") == "x  y  z\n1     2\n3     4"
    assert _text("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</tbody></table>") == "a  b\nc  d"
    assert _text("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>") == "a     b\n      c\nd  e  f"


def test_cells_of_any_width():
    wide = "w" * 60
    assert _text(f"<table><tr><td>{wide}<td>b<td>c<tr><td>a<td>d<td>e</table>") == f"{wide}  b  c\n" + "a".ljust(62) + "d  e"
    many = "".join(f"<tr><td>{i}<td>x" for i in range(3000))
    got = _text(f"<table><tr><td>{'w ' * 50_000}<td>b{many}</table>")
    assert len(got) < 1_000_000 and got.count("x") == 3000 and got.count("w") == 50_000


def test_inherited_visibility():
    assert _text("<div style='visibility:hidden'>a<p style='visibility: visible'>b</p>c<i>d</i></div>e") == "b\n\ne"
    assert _text("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>") == "- b"
    assert _text("<div style='display:none'>a<p style='visibility: visible'>b</p></div>e") == "e"
    assert _text("<svg><g visibility=hidden><text>a</text><text visibility=visible>b</text></g></svg>") == "b"


def test_scripting_and_lists():
    assert _text("<noscript><p>turn it on</p></noscript>a") == "a"
    assert _text("<ol><li>a<li value=7>b<li>c</ol><ol reversed><li>x<li>y</ol>") == "1. a\n7. b\n8. c\n\n2. x\n1. y"


def test_attributes_and_references():
    assert _text("<p title=it's>a</p><p title='>'>b</p><a href=\"x>y</a> c") == "a\n\nb\n\ny c"
    assert _text("&#" + "1" * 6000 + ";&#65;&#x" + "f" * 6000 + ";") == "\ufffdA\ufffd"
    assert _text("a<!-->b<!-- c --!>d<!doctype html>e<?x?>f</>g") == "abdefg"


DEGENERATE = {
    "open tag": "<a ",
    "div": "<div>",
    "quote": "<a b='",
    "paragraph": "<p>",
    "end": "</p>",
    "list": "<ul><li>x",
    "table": "<table><tr><td>x",
    "row": "<tr><td>x<td>y",
    "span": "<td rowspan=9 colspan=1000>x",
    "bold": "<b>x",
    "comment": "<!-- ",
    "script": "</script x<script>",
    "less": "<",
    "entity": "&am",
    "line": "<br> ",
    "definition": "<dl><dd>x",
    "svg": "<svg><text>x/",
    "details": "<details><summary>x",
    "head": "<head>x",
    "select": "<select><option>x",
}


@pytest.mark.parametrize("kind", DEGENERATE)
def test_degenerate_pages_take_linear_time(kind):
    page = ("<table>" if kind in ("row", "span") else "") + DEGENERATE[kind] * (1_000_000 // len(DEGENERATE[kind]))
    began = time.process_time()
    _text(page)
    assert time.process_time() - began < 8


class _Plain(HTMLParser):
    """Lines of words in order, a marker before a list item's; the test pages hold none of the rarer elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.off += 1
        elif tag in ("p", "div", "li", "br", "h1", "article", "nav", "ul", "footer"):
            self.words.append("\0")
        if tag == "li":
            self.words.append("- ")

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "title"):
            self.off -= 1
        elif tag in ("p", "div", "li", "h1", "article", "nav", "ul", "footer"):
            self.words.append("\0")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)

    def lines(self):
        """Where blocks and breaks part lines; white space in a line is one space."""
        return [" ".join(x.split()) for x in "".join(self.words).split("\0") if x.split()]


def test_whole_table_against_a_plain_renderer(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in page_texts(pages).collect()}
    for r in pages.collect():
        plain = _Plain()
        plain.feed(r["html"])
        plain.close()
        assert [" ".join(x.split()) for x in got[r["page_id"]].split("\n") if x.split()] == plain.lines()
        assert html.unescape("&copy;") in got[r["page_id"]]
    assert extract_text(pages.limit(0)).columns == ["page_id", "url", "html", "text"] and extract_text(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([("<p>a", "s", 1), (None, "s", 2)], "text string, source string, page_id int")
    assert [tuple(r) for r in extract_text(odd, "text").select("source", "page_id", "text").orderBy("page_id").collect()] == [("s", 1, "a"), ("s", 2, None)]
