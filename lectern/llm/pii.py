"""Operator 9: personal data, also where it is disguised.

Plain identifiers are found in the text as it stands. For disguised ones the
text passes through transducers, each of which rewrites stretches and keeps,
for every character it emits, the source range that the character stands for:

1. homoglyphs: full-width forms, other scripts' digits, look-alike Cyrillic
   and Greek letters, odd dots, dashes and spaces; invisible characters go;
2. at/dot disguises: ``(at)``, ``[dot]`` and the like, and bare ``at`` / ``dot``
   words where the whole reads as an address;
3. spelled digits: three or more digit words in a row, ``plus`` before them.

The same detectors then run over the rewritten text, and their spans map back
to source characters. A text without any sign of a disguise skips this.

Every step takes time in proportion to the text. Spans are half-open ranges of
code points. A rewritten find that lies within a
plain one of its kind is the same identifier and is not added; one that reaches
further (the plain one is a fragment of it) is, beside the plain one. Null and empty
texts have none; texts are processed whole; repeated rows repeat; an empty
table gives no rows; columns other than the two named are never read.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

KINDS = ("email", "ip", "card", "phone")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _is_ip(s: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in s.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _is_card(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 16 <= len(d) <= 19 and _luhn(d)


def _is_phone(s: str) -> bool:
    return 8 <= sum(c.isdigit() for c in s) <= 15


def _emails(text: str):
    """The pattern's matches, found from their ``@``: the local part is the
    run of its characters to the left, back to the last match's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and (text[lo - 1] in _LOCAL):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            end = m.end()
        at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def detect(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each of ``KINDS``, leftmost first, without overlaps."""
    out = [list(_emails(text)), [], [], []]
    if _DIGIT.search(text):
        for k, pattern, ok in ((1, _IP, _is_ip), (2, _CARD, _is_card)):
            out[k] = [m.span() for m in pattern.finditer(text) if ok(m[0])]
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return out


# --- transducers ------------------------------------------------------------------

# Letters of other alphabets that look like Latin ones, and marks
# that stand for ASCII ones.
_LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеоѕіјрсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχ",
                      "ABESIJKMHOPCTYXaeosijpcyxhdqwABEZHIKMNOPTYXaivopux"))
_MARKS = (dict.fromkeys("\u3002\uff0e\uff61\u2024\u2027\u00b7", ".") | dict.fromkeys("\uff20\ufe6b", "@")
          | dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212\ufe63\u2043", "-")
          | dict.fromkeys("\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))), " "))
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Also full-width forms, and digits of other scripts and styles.
_ODD = re.compile("[" + "".join([*_LOOKALIKE, *_MARKS]) + _HIDDEN + "\uff01-\uff5e\u0660-\u0669\u06f0-\u06f9"
                  "\u0966-\u096f\U0001d7ce-\U0001d7ff\u2070\u00b9\u00b2\u00b3\u2074-\u2079\u2080-\u2089\u2460-\u2468]")

# The names of the digits in the four languages.
_DIGIT_WORDS = {w: str(d) for names in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(names.split())} | {"oh": "0"}
_NAMES = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:(plus)[\s,-]+)?((?:{_NAMES})(?:[\s,-]+(?:{_NAMES}))+)(?!\w)")
_NAME = re.compile(rf"(?i)(?:{_NAMES})(?!\w)")
_MANY = 3

_AT = r"(?:at|arroba)"
_DOT = r"(?:dot|punkt|point|punto)"
_BRACKETED = re.compile(rf"(?i)[\[({{<]\s*(?:({_AT})|{_DOT})\s*[\])}}>]")
#: Bare disguises are found from their ``at``; what stands around it is read
#: outwards from there.
_BARE_AT = re.compile(rf"(?i)@|(?<=\s){_AT}(?=\s)")
_BARE_DOT = re.compile(rf"(?i)(?<=\s){_DOT}(?=\s)")
_BARE_DOMAIN = re.compile(rf"(?i)[A-Za-z0-9-]+(?:(?:\s+{_DOT}\s+|\.)[A-Za-z0-9-]+)*\s+{_DOT}\s+[A-Za-z]{{2,}}(?!\w)")
_BARE_IP = re.compile(rf"(?i)(?<!\w)[0-9]++(?:(?:\s+{_DOT}\s+|\.)[0-9]++){{3}}(?!\w)")
#: Without one of these neither kind of disguise is there: bare ones have a dot.
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_BRACKET = re.compile(rf"(?i)[\[({{<]\s*(?:{_AT}|{_DOT})\s*[\])}}>]")


class Mapped:
    """A rewritten text: character i stands for source ``[lo[i], hi[i])``."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges of the current text (in order, apart from each
        other); each new character stands for its whole range."""
        text, lo, hi, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            lo += self.lo[at:a]
            hi += self.hi[at:a]
            if b > a:
                lo += [self.lo[a]] * len(new)
                hi += [self.hi[b - 1]] * len(new)
            at = b
        self.text, self.lo, self.hi = "".join(text), lo, hi


def _plain(c: str) -> str:
    if c in _HIDDEN:
        return ""
    if (p := _LOOKALIKE.get(c) or _MARKS.get(c)) is not None:
        return p
    if "\uff01" <= c <= "\uff5e":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.digit(c, "")) or c


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(text)]


def _gap_left(text: str, at: int, end: int) -> int:
    """Where the white space before ``at`` starts, not before ``end``."""
    while at > end and text[at - 1].isspace():
        at -= 1
    return at


def _gap_right(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    edits, end = [], 0
    for m in _BRACKETED.finditer(text):
        lo, end = _gap_left(text, m.start(), end), _gap_right(text, m.end(), len(text))
        edits.append((lo, end, "@" if m[1] else "."))
    return edits


def _dots(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """An edit for each bare ``dot`` with white space on both sides."""
    edits, end = [], lo
    for m in _BARE_DOT.finditer(text, lo, hi):
        a, b = _gap_left(text, m.start(), end), _gap_right(text, m.end(), hi)
        if a < m.start() and b > m.end():
            edits.append((a, b, "."))
            end = b
    return edits


def _run_left(text: str, at: int, end: int) -> int:
    """Where the run of local characters before ``at`` starts; ``at`` where it
    is none, or goes on before ``end``."""
    lo = at
    while lo > end and text[lo - 1] in _LOCAL:
        lo -= 1
    return at if lo == end and lo > 0 and text[lo - 1] in _LOCAL else lo


def _local_left(text: str, at: int, end: int) -> int:
    """Where a bare local part (runs with ``dot`` between them) before ``at``
    starts; ``at`` where there is none."""
    lo = _run_left(text, at, end)
    if lo == at or text[at - 1] == ".":
        return at
    first = lo
    while "." not in text[lo:at]:
        # One step further: white space, a dot's word, white space, a run.
        at = _gap_left(text, lo, end)
        word = _run_left(text, at, end)
        if at == lo or word == at or text[word:at].lower() not in _DOT_WORDS:
            break
        at = _gap_left(text, word, end)
        lo = _run_left(text, at, end)
        if at == word or lo == at or text[at - 1] == ".":
            break
        first = lo
    return first


def _bare(text: str) -> list[tuple[int, int, str]]:
    edits, taken, end = [], [], 0
    for m in _BARE_AT.finditer(text):
        if m.start() < end:
            continue
        lo = _gap_left(text, m.start(), end)
        hi = _gap_right(text, m.end(), len(text))
        first = _local_left(text, lo, end)
        domain = _BARE_DOMAIN.match(text, hi) if first < lo else None
        if domain:
            end = domain.end()
            edits += [*_dots(text, first, lo), (lo, hi, "@"), *_dots(text, hi, end)]
            taken.append((first, end))
    for m in _BARE_IP.finditer(text):
        if not _overlaps(m.span(), taken):
            edits += _dots(text, *m.span())
    return sorted(edits)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """One edit for each digit word: it also takes the gap before it, but for
    the run's first."""
    edits = []
    for m in _SPELLED.finditer(text):
        names = list(_NAME.finditer(text, m.start(2), m.end(2)))
        if len(names) < _MANY:
            continue
        if m[1]:
            edits.append((m.start(1), m.end(1), "+"))
        end = m.end(1) if m[1] else m.start(2)
        for n in names:
            edits += [(end, n.start(), "")] * (n.start() > end) + [(n.start(), n.end(), _DIGIT_WORDS[n[0].lower()])]
            end = n.end()
    return edits


def normalise(text: str) -> Mapped | None:
    """The rewritten text, or None where nothing is disguised."""
    steps = []
    if not text.isascii() and _ODD.search(text):
        steps.append(_homoglyphs)
    low = text.lower()
    if steps or any(s in low for s in _DOT_WORDS) or _BRACKET.search(text):
        steps += [_bracketed, _bare]
    if steps or len(_DIGIT_WORDS.keys() & low.replace("-", " ").replace(",", " ").split()) > 0:
        steps.append(_spelled)
    if not steps:
        return None
    out, changed = Mapped(text), False
    for step in steps:
        if edits := step(out.text):
            out.rewrite(edits)
            changed = True
    return out if changed else None


def find(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """The plain spans of each kind, and those with the disguised ones."""
    base = detect(text)
    every = base
    if (m := normalise(text)) is not None:
        every = []
        for plain, spans in zip(base, detect(m.text)):
            found = [(m.lo[a], m.hi[b - 1]) for a, b in spans]
            every.append(sorted({*plain, *(f for f in found if not _within(f, plain))}))
    return base, every


def _overlaps(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    from bisect import bisect_right

    i = bisect_right(spans, (span[0], 1 << 62))
    return bool((i and spans[i - 1][1] > span[0]) or (i < len(spans) and spans[i][0] < span[1]))


def _within(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """Whether one of the spans (in order, apart from each other) holds it."""
    from bisect import bisect_right

    i = bisect_right(spans, (span[0], 1 << 62))
    return bool(i and spans[i - 1][1] >= span[1])


def _listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, found in zip(KINDS, spans) for a, b in found)


def find_pii(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, the number of plain spans of each kind (``n_email`` ...),
    ``base`` (the plain spans as ``kind:start:end``, joined by commas, kinds
    in their order) and ``spans`` (all spans, joined likewise)."""

    def run(batches):
        for b in batches:
            base, every, count = [], [], [[] for _ in KINDS]
            for text in b.column("text").to_pylist():
                plain, found = find(text)
                base.append(_listed(plain))
                every.append(_listed(found))
                for c, p in zip(count, plain):
                    c.append(len(p))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(c, pa.int64()) for c in count), pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = texts(df, id_col, text_col)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {counts}, base string, spans string")
