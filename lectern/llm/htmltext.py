"""Operator 7: HTML extraction by layout-aware rendering.

A tree builder closes what a start tag implies closed (paragraphs before
blocks, list items, table rows and cells, definition terms, options, the head
before anything that is not head content); elements left open end with their
parent. All visible text is emitted: not what script, style, template or head
elements hold, nor elements that are ``hidden`` or styled ``display:none``; what is
styled ``visibility:hidden`` goes but for parts styled visible again. Of drawings the ``text`` elements are seen, of formulas
all but annotations. Blocks and options stand on lines of their own, paragraphs
and headings with an empty line between, list items with their mark and depth,
preformatted text as it is, and a table's cells in aligned columns, also where
they cover several. The tree is built with the places of open elements at hand
and walked with an explicit stack, so depth is no limit and costs nothing.

Defined results: null and empty pages give an empty text; repeated rows repeat;
an empty table gives no rows; columns other than the two named are never read.
Marked sections (``<![``) are comments; a character reference beyond all
characters is U+FFFD, however many digits it has. Pages are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

# Names of HTML's elements by their behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe title datalist".split())
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
BLOCK = SPACED | frozenset("address article aside body dd details div dt fieldset figcaption footer form header html li main nav"
                           " section summary tr caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "tbody"}, "thead": {"caption"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}}
#: Lines of their own that close no paragraph; elements whose parts stand apart.
LINES = frozenset("option optgroup".split())
APART = frozenset("mfrac msup msub msubsup munder mover munderover mmultiscripts mroot mtr mtable".split())
#: What a drawing or a formula holds unseen, and where HTML starts again inside.
FOREIGN_UNSEEN = {"svg": frozenset("defs symbol desc metadata clippath mask pattern marker".split()),
                  "math": frozenset("annotation annotation-xml".split())}
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_STYLED_AWAY = re.compile(r"(?i)display\s*:\s*none")
_VISIBILITY = re.compile(r"(?i)visibility\s*:\s*([a-z]+)")
#: Columns and rows that a cell covers, at most: a page's table stays in
#: proportion to the page.
MOST_COLUMNS, MOST_ROWS = 100, 100
#: Depth from which on nested lists are not set in further.
DEEPEST = 40
_FIRST_NEWLINE = re.compile(r"\A(?:\r\n?|\n)")
_NEWLINE = re.compile(r"\r\n?")
_SPACE = re.compile(r"[ \t\r\n\f]+")
_DIGITS = re.compile(r"\s*\+?([0-9]{1,9})")
_LONG_REFERENCE = re.compile(r"&#([0-9]{9,})")


class _Tree(HTMLParser):
    """``root`` is ``[tag, attributes, children]``; a child is a node or text.
    ``at`` has the places in ``open`` of each tag's open elements, so that
    looking for one does not walk the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}

    def _last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        for node in reversed(self.open[place:]):
            self.at[node[0]].pop()
        del self.open[place:]

    def _close(self, tags, stop) -> None:
        """Close open ``tags`` up to the innermost open of ``stop``."""
        bound = self._last(stop)
        while (place := self._last(tags)) > bound:
            self._cut(place)

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (self.open[-1][0] == "head" and tag not in HEAD):
            self._close({"head"}, ())
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE.get(tag, {"table"}))
        if tag in BLOCK:
            self._close({"svg", "math"}, INTEGRATION)
            self._close({"p"}, {"td", "th", "li", "div", "table"})
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag):
        if self.at.get(tag):
            self._cut(self.at[tag][-1])

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip(" \t\r\n\f"):
            self._close({"head"}, ())
        if self.open[-1][0] == "pre" and not self.open[-1][2]:
            data = _FIRST_NEWLINE.sub("", data)
        self.open[-1][2].append(data)

    def parse_marked_section(self, i, report=1):
        """``<![...`` is a comment up to the next ``>``, as in browsers."""
        return self.parse_bogus_comment(i)


def _number(attrs: dict, name: str, default: int, most: int) -> int:
    """A whole number of an attribute, from 1 to ``most``."""
    m = _DIGITS.match(attrs.get(name) or "")
    return min(int(m[1]), most) or default if m else default


def _aligned(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of cells ``(text, columns, rows)`` in aligned columns. Only
    columns where a cell starts are told apart."""
    placed, covered = [], []                   # covered: (first column, last, rows) of cells from above
    for row in rows:
        at, line, high, above = 0, [], [], 0
        for text, wide, tall in row:
            while above < len(covered) and covered[above][0] <= at:
                at = max(at, covered[above][1])
                above += 1
            line.append((at, text, wide))
            if tall > 1:
                high.append((at, at + wide, tall))
            at += wide
        covered = sorted((a, b, n - 1) for a, b, n in [*covered, *high] if n > 1)
        placed.append(line)
    starts = sorted({at for line in placed for at, _, _ in line})
    index = {c: i for i, c in enumerate(starts)}
    width = [0] * len(starts)
    spans = []
    for line in placed:
        for at, text, wide in line:
            i, j = index[at], bisect_left(starts, at + wide)
            spans.append((i, j, text))
            if j == i + 1:
                width[i] = max(width[i], len(text))
    for i, j, text in spans:
        if j > i + 1:
            width[j - 1] += max(0, len(text) - sum(width[i:j]) - 3 * (j - i - 1))
    out, done = [], 0
    for line in placed:
        cells, next_ = [], 0
        for i, j, text in spans[done:done + len(line)]:
            cells += [" " * w for w in width[next_:i]]
            cells.append(text.ljust(sum(width[i:j]) + 3 * (j - i - 1)))
            next_ = j
        done += len(line)
        if line:
            out.append(" | ".join(cells).rstrip())
    return "\n".join(out)


class _Out:
    """Text under way: pending line breaks, collapsed white space."""

    def __init__(self):
        self.parts, self.breaks, self.gap = [], 0, False

    def line(self, n: int) -> None:
        self.breaks, self.gap = max(self.breaks, n), False

    def put(self, text: str) -> None:
        if text:
            if self.parts:
                self.parts.append("\n" * self.breaks or (" " if self.gap else ""))
            self.parts.append(text)
            self.breaks, self.gap = 0, False

    def inline(self, data: str) -> None:
        words = _SPACE.sub(" ", data)
        self.gap = self.gap or words.startswith(" ")
        self.put(words.strip(" "))
        self.gap = self.gap or (words.endswith(" ") and self.breaks == 0)

    def raw(self, data: str) -> None:
        """Preformatted: newlines at the ends wait as breaks do."""
        data = _NEWLINE.sub("\n", data)
        body = data.strip("\n")
        lead = len(data) - len(data.lstrip("\n"))
        self.breaks += lead
        if body:
            self.put(body)
            self.breaks = len(data) - lead - len(body)

    def text(self) -> str:
        return "".join(self.parts)


def _short_reference(m: re.Match) -> str:
    digits = m[1].lstrip("0") or "0"
    return f"&#{digits if len(digits) < 8 else 1114112}"


def render(html: str) -> str:
    tree = _Tree()
    # References beyond all characters stay so, in few digits. After the last
    # ``>`` no tag ends: that is text, which the parser would search for tags.
    html = _LONG_REFERENCE.sub(_short_reference, html)
    end = html.rfind(">") + 1
    tree.feed(html[:end])
    rest = tree.rawdata + html[end:]
    tree.rawdata = ""
    if rest:
        tree.handle_data(unescape(rest))
    out, lists, tables, pre = [_Out()], [], [], 0
    foreign: list = [("", True, None)]         # drawings and formulas around, and whether their text is seen
    seen: list = [(True, None)]                # visibility, and the element that set it
    todo: list = [(tree.root, True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            if foreign[-1][1] and seen[-1][0]:
                out[-1].raw(node) if pre else out[-1].inline(node)
            continue
        tag, attrs, children = node
        if enter:
            if tag in UNSEEN or tag in FOREIGN_UNSEEN.get(foreign[-1][0], ()) or "hidden" in attrs or _STYLED_AWAY.search(attrs.get("style") or ""):
                continue
            if (m := _VISIBILITY.search(attrs.get("style") or "")) and m[1].lower() in ("hidden", "collapse", "visible"):
                seen.append((m[1].lower() == "visible", node))
            if tag == "br":
                out[-1].raw("\n") if pre else out[-1].line(1)
                continue
            if tag in FOREIGN_UNSEEN:
                foreign.append((tag, tag == "math", node))
            elif foreign[-1][0] == "svg" and tag in ("text", "foreignobject"):
                foreign.append(("svg" if tag == "text" else "", True, node))
                out[-1].line(1)
            if tag in LINES:
                out[-1].line(1)
            if tag in BLOCK:
                out[-1].line(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol"):
                lists.append([tag, _number(attrs, "start", 1, 1 << 30) - 1])
            elif tag == "li" and lists:
                lists[-1][1] = _number(attrs, "value", lists[-1][1] + 1, 1 << 30)
                if seen[-1][0]:
                    out[-1].put("  " * min(len(lists) - 1, DEEPEST) + (f"{lists[-1][1]}." if lists[-1][0] == "ol" else "-"))
                    out[-1].gap = True
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                out.append(_Out())
            pre += tag == "pre"
            todo.append((node, False))
            if tag in APART:
                children = [x for c in children for x in (c, " ")]
            todo += [(c, True) for c in reversed(children)]
            continue
        if tag == "pre":
            pre -= 1
            out[-1].breaks = 0
        if seen[-1][1] is node:
            seen.pop()
        if foreign[-1][2] is node:
            foreign.pop()
            if tag in ("text", "foreignobject"):
                out[-1].line(1)
        if tag in LINES:
            out[-1].line(1)
        if tag in ("ul", "ol"):
            lists.pop()
        elif tag in ("td", "th") and tables and len(out) > 1:
            cell = _SPACE.sub(" ", out.pop().text())
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell, _number(attrs, "colspan", 1, MOST_COLUMNS), _number(attrs, "rowspan", 1, MOST_ROWS)))
        elif tag == "table":
            out[-1].line(2)
            out[-1].put(_aligned(tables.pop()))
        if tag in BLOCK:
            out[-1].line(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
    return out[0].text()


def extract(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, text`` for every row."""
    rows = texts(pages, id_col, html_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([render(t) for t in b.column("text").to_pylist()], pa.string())],
                                             ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
