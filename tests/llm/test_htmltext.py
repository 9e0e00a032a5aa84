import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.htmltext import BLOCK, extract, render


@pytest.mark.parametrize("html, text", [
    ("", ""), ("a <b>b</b>c  d", "a bc d"), ("<p>one<p>two", "one\n\ntwo"), ("x<br>y", "x\ny"),
    ("<script>no</script><p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
    ("<table><tr><th>k<th>value<tr><td>long<td>1</table>", "k    | value\nlong | 1"),
    ("<div>" * 5000 + "deep", "deep"), ("<td>stray</td> &eacute;", "stray é"),
])
def test_render(html, text):
    assert render(html) == text


@pytest.mark.parametrize("html, text", [
    ("<head><title>t</title><body><p>text", "text"), ("<head><title>t</title><p>text", "text"),
    ("<html><head><meta charset=x><style>s</style>\n bare text", "bare text"),
    ("<head><title>t</title><script>no</script></head><body>text", "text"),
    ("<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>", "x=1 2"),
    ("<p>Pick <select><option>one<option selected>two</select> now", "Pick\none\ntwo\nnow"),
    ("<object data=x>fall <b>back</b></object>", "fall back"),
    ("<svg><title>no</title><defs><text>no</text></defs><g>no<text>a<tspan>b</tspan></text><text>c</text></g></svg>d", "ab\nc\nd"),
    ("<svg><path d=x><p>after", "after"),
    ("<pre><span>a</span>\n<span>b</span></pre>", "a\nb"), ("<p>x</p><pre>\r\na\r\n\r\n  b<br>c\n</pre>y", "x\n\na\n\n  b\nc\n\ny"),
    ("<pre>a <i> b</i>\n\n<i>c</i></pre>", "a  b\n\nc"),
])
def test_no_visible_text_goes(html, text):
    assert render(html) == text


@pytest.mark.parametrize("html, text", [
    ("<svg>" * 1500 + "<p>x", "x"), ("a<![foo[x]]>b", "ab"), ("<![CDATA[x]]>y", "y"), ("&#" + "9" * 5000 + "; x", "� x"),
    ("&#" + "0" * 5000 + "65; x", "A x"), ("<a title='&#" + "9" * 5000 + ";'>k</a>", "k"), ("a<!--b", "a<!--b"), ("<p>one<b", "one<b"),
    ("<script>no > no", ""), ("x < y &amp; z", "x < y & z"),
])
def test_odd_markup_ends_no_job(html, text):
    assert render(html) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b", ">", "<", "<!--", "-->", "<![", "]]>", "<svg>", "</svg>", "<table>", "<tr>", "<td colspan=2>",
                                 "<td rowspan=3>", "</table>", "<li>", "<ul>", "</ul>", "<pre>", "</pre>", "<head>", "<body>", "<select>", "<option>",
                                 "<math>", "<mfrac>", "&#9", "&#x;", "&eacute", "'", "\"", "a", " ", "\n", "\0", "é", "<style>", "</style>", "<br>", "</",
                                 "<div style='visibility:hidden'>", "</div>", "<ol start=x>", "<text>"]), max_size=40))
@settings(max_examples=400, deadline=None)
def test_any_markup_renders(parts):
    assert isinstance(render("".join(parts)), str)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_text_renders(text):
    assert isinstance(render(text), str)


@pytest.mark.parametrize("part, end", [
    ("<div>", ""), ("</x>", ""), ("<ul><li>", ""), ("<table><tr><td>", ""), ("<b><p>", ""), ("<tr><td rowspan=60000>x", ""), ("<!--", ""),
    ("<a ", ""), ("<a b='", ""), ("<a ", ">"), ("<![a", ""), ("<td colspan=1000 rowspan=1000>x", "<tr><td>y"),
])
def test_time_grows_with_the_page(part, end):
    def seconds(n):
        best = 9e9
        for _ in range(2):
            start = time.perf_counter()
            render("<table><ul><li><ul>" + part * n + end)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(8000) < 5 * seconds(4000) + 0.1


@pytest.mark.parametrize("html, text", [
    ("<table><tr><th colspan=2>Name<th>Age<tr><td>Al<td>Bo<td>3</table>", "Name    | Age\nAl | Bo | 3"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td colspan=2>a long one<td>x<tr><td>b<td>c<td>y</table>", "a long one | x\nb | c      | y"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<ul><li>no</ul></div>z", "yes\n\nz"),
    ("<ol start=3><li>a<li>b<li value=9>c<li>d</ol>", "3. a\n4. b\n9. c\n10. d"),
])
def test_spans_visibility_and_numbers(html, text):
    assert render(html) == text


def test_awkward_rows(spark):
    long = "<p>" + "word " * 200_000 + "<table><tr><td>end</table>"
    rows = [(1, None), (2, ""), (3, "<p>a<p>b"), (3, "<p>a<p>b"), (None, "<b>x</b>"), (4, long)]
    pages = spark.createDataFrame([(i, h, "own", "own") for i, h in rows], "page_id long, html string, id string, text string").repartition(3)
    got = sorted(((r.id, r.text) for r in extract(pages, "page_id", "html").collect()), key=str)
    assert got == sorted(((i, render(h or "")) for i, h in rows), key=str) and dict(got)[4].endswith("word\n\nend")
    assert len(dict(got)[4]) > 999_000
    assert extract(pages.limit(0), "page_id", "html").collect() == []


def visible(node, out):
    """Visible text of well-formed markup, by a plain walk."""
    tag, attrs, children = node
    if tag in ("script", "style") or "hidden" in attrs:
        return
    for c in children:
        visible(c, out) if isinstance(c, tuple) else out.append(c)


def test_all_visible_words_in_order_against_a_plain_walk():
    rng = random.Random(7)

    def tree(depth):
        tag = rng.choice(["div", "p", "span", "b", "ul", "li", "table", "tr", "td", "h1", "section", "script", "style"])
        attrs = ["hidden"] if rng.random() < 0.15 else []
        inner = [f"w{rng.randrange(10 ** 6)}" if depth == 0 or tag in ("script", "style") or rng.random() < 0.5 else tree(depth - 1) for _ in range(rng.randint(0, 4))]
        return tag, attrs, inner

    def written(node):
        tag, attrs, children = node
        return f"<{tag} {' '.join(attrs)}>" + "".join(f" {c} " if isinstance(c, str) else written(c) for c in children) + f"</{tag}>"

    nested = {"p": BLOCK, "li": {"li"}, "td": {"td", "tr"}, "tr": {"tr"}, "table": {"td", "tr"}}

    def plain(node, around=()):
        """Only trees whose tags close each other nowhere."""
        return all(isinstance(c, str) or (c[0] not in {x for t in (*around, node[0]) for x in nested.get(t, ())} and plain(c, (*around, node[0])))
                   for c in node[2])

    tried = 0
    for _ in range(4000):
        t = tree(4)
        if not plain(t) or "td" in written(t) or "tr" in written(t):
            continue
        tried += 1
        out = []
        visible(t, out)
        assert [w for w in render(written(t)).split() if w.startswith("w")] == out, written(t)
    assert tried > 300
