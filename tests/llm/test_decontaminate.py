import random
import re

import numpy as np
from rows import by_id, documents

from lectern.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for i in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for p, own in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i:i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= own
        out.append((len(w), hit, sorted(found)))
    return out


def case(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cd", "É", "ef1", "gh", "日本"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(8)]
    items += [(10, "solo"), (11, ""), (12, None), (None, "ab cd ab cd ab cd ab cd ab cd ab"), (2, "Twice, THE same ID here!"), (3, items[4][1])]
    texts = [None, "", "...", "solo", "no match at all", "Solo-solo. twice the SAME id: here"]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [", ".join(w[a:a + rng.randint(1, 40)]), " ".join(word() for _ in range(rng.randint(0, 9)))]
        texts.append(" ".join(parts))
    texts.append((texts[-1] + "\n") * 400)
    return texts, items


def check(rows, texts, want):
    got = by_id(rows, "id")
    for i, (n, hit, items) in enumerate(want):
        (r,) = got[i]
        covered = {x for s in r.spans for x in range(s.first, s.last)}
        assert (r.n_words, covered, list(r.items)) == (n, hit, items), texts[i][:200]
        assert all(a.last < b.first for a, b in zip(r.spans, r.spans[1:]))


def test_against_brute_force_in_one_pass_and_in_blocks(spark):
    texts, items = case()
    docs = documents(spark, texts).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = expected(texts, items)
    assert any(hit for _, hit, _ in want)
    check(D.find_leaks(docs, bench, "doc_id", "text", "item_id", "text").collect(), texts, want)
    check(D.find_leaks(docs, bench, "doc_id", "text", "item_id", "text", block_bytes=300).collect(), texts, want)


def test_without_short_items_only_phrase_stretches_are_indexed(spark):
    texts, items = case(5)
    items = [(i, t) for i, t in items if t and len(words(t)) >= 10]
    bench = spark.createDataFrame(items, "item_id long, text string")
    check(D.find_leaks(documents(spark, texts), bench, "doc_id", "text", "item_id", "text").collect(), texts, expected(texts, items))


def test_empty_tables_and_repeated_rows(spark):
    docs = documents(spark, ["a b c", "a b c"], ids=[1, 1])
    bench = spark.createDataFrame([(1, "B c")], "item_id long, text string")
    rows = D.find_leaks(docs, bench, "doc_id", "text", "item_id", "text").collect()
    assert [[tuple(s) for s in r.spans] for r in rows] == [[(1, 3)], [(1, 3)]]
    assert D.find_leaks(docs.limit(0), bench, "doc_id", "text", "item_id", "text").collect() == []
    assert all(not r.spans and r.n_words == 3 for r in D.find_leaks(docs, bench.limit(0), "doc_id", "text", "item_id", "text").collect())
    assert D.remove_spans("Keep A, b c! end", [(1, 4)]) == "Keep ! end"


def test_index_finds_and_locates_every_occurrence():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 40, rng.integers(1, 12))
        tokens, starts = rng.integers(1, 4, sizes.sum()), np.cumsum(sizes) - sizes
        index = D.FMIndex(tokens, starts)
        length = int(rng.integers(1, 6))
        rows = np.zeros((30, 6), np.int64)
        rows[:, 6 - length:] = rng.integers(1, 5, (30, length))
        lo, hi = index.search(rows)
        for row, a, b in zip(rows[:, 6 - length:], lo, hi):
            found = sorted(index.locate(np.arange(a, b)).tolist())
            want = []
            for k, (s, n) in enumerate(zip(starts, sizes)):
                want += [s + k + i for i in range(n - length + 1) if (tokens[s + i:s + i + length] == row).all()]
            assert found == want
