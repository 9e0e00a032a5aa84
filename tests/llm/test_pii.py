import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import by_id, documents

from lectern.llm import pii
from lectern.llm import queries as Q

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def ours(text):
    return [(k, a, b) for k, spans in zip(pii.KINDS, pii.find(text)[0]) for a, b in spans]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "1", "25", "256", ".", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "é", "🙂", "0", "ab@x.y"]), max_size=25).map("".join))
def test_plain_spans_against_the_patterns(text):
    assert ours(text) == plain(text)


@pytest.mark.parametrize("text, kind, found", [
    ("mail john (dot) doe [at] example [dot] com now", "email", "john (dot) doe [at] example [dot] com"),
    ("é🙂 john dot doe at mail dot example dot com", "email", "john dot doe at mail dot example dot com"),
    ("write to ｊohn＠exаmple。com", "email", "ｊohn＠exаmple。com"),
    ("jo​hn@example.com", "email", "jo​hn@example.com"),
    ("call plus one four one five five five five one two one two", "phone", "plus one four one five five five five one two one two"),
    ("card four one one one one one one one one one one one one one one one.", "card",
     "four one one one one one one one one one one one one one one one"),
    ("ip １０.0.0.٣ here", "ip", "１０.0.0.٣"),
    ("10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.find(text)
    k = pii.KINDS.index(kind)
    more = [text[a:b] for a, b in every[k] if (a, b) not in base[k]]
    assert more == ([found] if found else [])
    assert all(set(b) <= set(e) for b, e in zip(base, every))


@pytest.mark.parametrize("text", ["at the dot of noon", "one two three", "the year 2024. At 10 dot 30 we eat", "look at example.com", "Привет, мир"])
def test_ordinary_text_has_none(text):
    assert all(not e for e in pii.find(text)[1])


def test_query_over_awkward_rows(spark):
    texts = [None, "", "a@b.c 1.2.3.4", "a@b.c 1.2.3.4", "word " * 40000 + "+1 (212) 555-0100"]
    ids = [1, 2, 3, 3, None]
    docs = documents(spark, texts, ids=ids)
    got = by_id(pii.find_pii(docs, "doc_id", "text").collect(), "id")
    for i, t in zip(ids, texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or ""))
        assert {r.base for r in got[i]} == {want} == {r.spans for r in got[i]}
    assert len(got[3]) == 2 and got[3][0].n_email == 1 and got[3][0].n_ip == 1 and got[None][0].n_phone == 1
    assert pii.find_pii(docs.limit(0), "doc_id", "text").collect() == []


def test_registered_query_against_the_patterns(spark):
    from conftest import SF001
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = Q.QUERIES["op9_pii"](spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


@pytest.mark.parametrize("text, kind, plain_part, whole", [
    ("to jоhn@example.com", "email", "hn@example.com", "jоhn@example.com"),
    ("to jo\u200bhn@example.com", "email", "hn@example.com", "jo\u200bhn@example.com"),
    ("to john(dot)doe@example.com", "email", "doe@example.com", "john(dot)doe@example.com"),
    ("to a@mail.example (dot) com", "email", "a@mail.example", "a@mail.example (dot) com"),
    ("call +1 212 555 01\uff100", "phone", "+1 212 555 01", "+1 212 555 01\uff100"),
])
def test_partly_disguised_ones_are_whole(text, kind, plain_part, whole):
    base, every = pii.find(text)
    k = pii.KINDS.index(kind)
    assert [text[a:b] for a, b in base[k]] == [plain_part]
    assert {text[a:b] for a, b in every[k]} == {plain_part, whole}


@pytest.mark.parametrize("at", ["{ at }", "< at >", "(  at )", "[at ]", "{at}", "( Arroba )"])
def test_every_bracketed_at_is_a_sign(at):
    text = f"john {at} example.com"
    assert [text[a:b] for a, b in pii.find(text)[1][0]] == [text]


def test_a_find_within_a_plain_one_is_not_added():
    text = "x@y.example.com, call me (dot) soon\u200b"
    assert pii.normalise(text) is not None
    assert pii.find(text)[0] == pii.find(text)[1]


@pytest.mark.parametrize("text, found", [
    ("0" * 5000 + ".0.0.1 x", [(0, 5006)]), ("1." * 3 + "0" * 5000 + "255", [(0, 5009)]), ("1.2.3." + "0" * 5000 + "256", []),
])
def test_long_runs_of_zeros_are_read(text, found):
    assert pii.find(text)[0][1] == found


@given(st.lists(st.sampled_from(["a", "dot", "at", "@", " ", "\t", ".", "-", "1", "22", "(at)", "[ dot ]", "(", "one", "two", "plus", "é", "​", "ｘ", "+", "Punkt"]), max_size=24))
@settings(max_examples=400, deadline=None)
def test_any_text_keeps_its_plain_spans_and_order(parts):
    text = "".join(parts)
    base, every = pii.find(text)
    assert [(k, a, b) for k, found in zip(pii.KINDS, base) for a, b in found] == list(plain(text))
    for b, e in zip(base, every):
        assert set(b) <= set(e) and e == sorted(set(e)) and all(0 <= lo < hi <= len(text) for lo, hi in e)


@pytest.mark.parametrize("part, end", [
    (" ", "x"), ("1 dot ", ""), ("a dot ", "b at c dot com"), ("c dot ", ""), ("a at ", ""), ("1", " dot 2"), ("one ", "x"), ("( ", ""), ("@ ", "dot x"), ("0", ".0.0.1 dot"),
])
def test_time_grows_with_the_text(part, end):
    def seconds(n):
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            pii.find("le point x at " + part * n + end)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(40_000) < 5 * seconds(20_000) + 0.05
