"""T3-T5 against an independent model built on the stdlib HTML parser
(text nodes joined by a space, script/style/template bodies skipped,
character references decoded), over every page and document of sf0.01."""

import html.entities
import re
from html.parser import HTMLParser

import pytest

from lectern.functions import html as H
from lectern.functions.text import KEPT_LETTERS, KEPT_PUNCTUATION
from conftest import SF01

_NOT_KEPT = re.compile(r"[^a-zA-Z0-9\s" + re.escape(KEPT_PUNCTUATION + KEPT_LETTERS) + r"-]")
_WS = re.compile(r"\s+")


class _Text(HTMLParser):
    """Text nodes as a tree builder makes them: data and references run
    together until markup (tag, comment, declaration) ends the node."""
    RAW = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts, self.buf, self.skip = [], [], 0

    def flush(self):
        if self.buf:
            if not self.skip:
                self.parts.append("".join(self.buf))
            self.buf = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in self.RAW:
            self.skip += 1

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.RAW and self.skip:
            self.skip -= 1

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_pi(self, data):
        self.flush()

    def unknown_decl(self, data):
        self.flush()

    def handle_data(self, data):
        self.buf.append(data)

    def handle_entityref(self, name):
        ch = html.entities.html5.get(name + ";")
        self.buf.append(ch if ch is not None else "&" + name)

    def handle_charref(self, name):
        try:
            n = int(name[1:], 16) if name[:1] in "xX" else int(name)
            self.buf.append(chr(n))
        except (ValueError, OverflowError):
            self.buf.append(" ")


def model(s: str) -> str:
    p = _Text()
    p.feed(s or "")
    p.close()
    p.flush()
    text = " ".join(p.parts)
    return _WS.sub(" ", _NOT_KEPT.sub(" ", text)).strip()


CASES = [
    "<p>Été &amp; hiver</p><!-- x --><script>if (a<b) {}</script>fin",
    "<div class='a'>caf&eacute; l&#39;&Eacute;t&#233; &#x41;&#X62;</div>",
    "&amp;lt;b&amp;gt; &unknown; &copy;&nbsp;2024",
    "<STYLE>p{}</STYLE><Template><b>caché</b></Template>visible",
    "a<br/>b<img src=x>c</p>d",
    "<!DOCTYPE html><?xml version='1.0'?><title>Titre</title>",
    # References without ';' (a parser ends a name at the first other
    # character), long and zero-padded numbers, names with '-' and '.'.
    "caf&eacute au lait, d&eacute;j&agrave, fin &eacute",
    "l&#39ete &#233t&#xE9 &#x41;&#0065; &#00000233; &#9999999999; &#65a &#x",
    "&amp&lt; &notin; &foo.bar;x &amp.y &AMP &ampx",
    "<p>&eacute</p>&#233<br>&#xe9",
]


@pytest.mark.parametrize("case", CASES)
def test_fixture_cases(spark, case):
    got = spark.createDataFrame([(case,)], "t string").select(H.clean_text("t").alias("c")).first().c
    assert got == model(case)


@pytest.mark.parametrize("table,col,key", [("pages", "html", "page_id"), ("documents", "text", "doc_id")])
def test_whole_tables(spark, table, col, key):
    df = spark.read.parquet(f"{SF01}/{table}.parquet")
    rows = df.select(key, col, H.clean_text(col).alias("c")).collect()
    bad = [r[key] for r in rows if r.c != model(r[col])]
    assert not bad, f"{len(bad)} rows differ, e.g. {bad[:5]}"


def test_sql_twin_on_fixture_cases():
    """The DuckDB restatement used by the oracles follows the same rules."""
    import duckdb

    from lectern import oracle as O

    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES "
                + ", ".join(f"({i}, {O.q(c)})" for i, c in enumerate(CASES)) + ") v(k, x)")
    rows = con.execute(f"WITH {O.clean_text_ctes('t', 'k', 'x', 'c')} SELECT k, c FROM _c ORDER BY k").fetchall()
    assert [c for _, c in rows] == [model(c) for c in CASES]
