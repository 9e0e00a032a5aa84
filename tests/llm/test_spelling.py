import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from rows import documents

from lectern.llm import spelling as S


def counts(rows):
    out = Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def expected(rows):
    n = counts(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def run(docs, **more):
    rows = S.spelling_groups(docs, "doc_id", "text", **more).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def texts(seed, n):
    """Words with chains of misspellings, in several alphabets."""
    rng = random.Random(seed)
    letters = "abcdeéÀßiom"
    out = []
    for _ in range(n):
        words = []
        for _ in range(40):
            w = list(rng.choice(["bacade", "bodice", "Ébamoid", "cadmium", "aaaaa", "idiomatic", "beßéabe"]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i:i + rng.choice([0, 1])] = rng.choice([[], [rng.choice(letters)]])
            words.append("".join(w))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("symbols", [S.SYMBOLS, 2])
def test_groups_against_brute_force(spark, symbols):
    body = texts(1, 60) + [None, "", "short abc x", "tied1tidal tided " * 3, "zarbode " * 3 + "zarbodex " * 7 + "zarbodexx " * 16]
    ids = [None, None] + list(range(2, len(body)))
    rows = list(zip(ids, body))
    want = expected(rows)
    assert sum(f is not None for f, *_ in want.values()) > 20 and any(f != r and f for f, r, *_ in want.values())
    assert run(documents(spark, body, ids=ids).repartition(4), symbols=symbols) == want


def test_spoiled_runs_lose_their_letter(spark):
    words = [f"{w}{x}{y}" for w in ("planet", "window") for x in "abcdefgh" for y in "klmnopqrst"]
    rows = [(i, " ".join(words)) for i in range(12)]
    plain = Counter(w for _, t in rows for w in t.split())
    got = {r.word: r.n for r in S.words(documents(spark, [t for _, t in rows]), "doc_id", "text").groupBy("word").agg(S.F.count("*").alias("n")).collect()}
    assert got != dict(plain) and sum(got.values()) == sum(plain.values())
    every = Counter()
    for i, t in rows:
        for w in t.split():
            h = zlib.crc32(f"{i}:{w}".encode())
            every[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    assert got == dict(every)


def test_neighbourhood_is_the_full_one(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgié") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    r = S.Reduced(words, 4)
    code = {int(c): i for i, c in enumerate(r.symbols)}
    assert len(code) == 4
    got = {i: [] for i in range(len(words))}
    for row, key in r.neighbours():
        for a, b in zip(row.tolist(), key.tolist()):
            got[a].append(b)

    def number(symbols):
        h = sum(int(r.symbols[t]) * pow(int(S._BASE), i, 1 << 64) for i, t in enumerate(symbols)) % (1 << 64)
        return int(S._mix(np.array([h], np.uint64))[0])

    for i, w in enumerate(words):
        s = tuple(((ord(c) * 2654435761) >> 16) % 4 for c in w)
        near = {s} | {s[:p] + s[p + 1:] for p in range(len(s))}
        near |= {s[:p] + (t,) + s[p + 1:] for p in range(len(s)) for t in range(4)}
        near |= {s[:p] + (t,) + s[p:] for p in range(len(s) + 1) for t in range(4)}
        assert sorted(got[i]) == sorted(map(number, near))


def test_very_long_words_in_bounded_blocks(spark):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    other = word[:30_000] + word[30_001:]
    blocks = [len(k) for _, k in S.Reduced([word]).neighbours()]
    assert sum(blocks) > 14 * 60_000 and max(blocks) <= (2 * S.SYMBOLS + 1) * S.BLOCK
    whole = [i for i in range(99) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in (word, other))][:7]
    got = run(documents(spark, [f"{word} {other} {word}"] * 7, ids=whole))
    kept = {(x[0] == word, x[1] == word, x[2:]) for x in got.values()}
    assert set(got) == {word, other} and kept == {(False, True, (14, 1, None)), (True, True, (7, 1, 14))}


def test_large_buckets_are_dealt_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_WORDS", 5)
    body = texts(2, 60)
    want = expected(list(enumerate(body)))
    assert run(documents(spark, body), symbols=2) == want


def test_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, ["planets planet"] * 3, ids=[4, 4, 4])
    assert run(docs) == expected([(4, "planets planet")] * 3)
    assert run(docs.limit(0)) == {} and run(documents(spark, ["", None, "a b c"])) == {}


def test_one_edit_of_short_and_long_words(spark):
    rng = random.Random(9)
    pairs = []
    for n in (1, 2, 5, 63, 64, 65, 66, 129):
        for _ in range(40):
            w = [rng.choice("abé") for _ in range(n)]
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                i = rng.randrange(len(v) + 1)
                v[i:i + rng.choice([0, 1])] = rng.choice([[], [rng.choice("abé")]])
            pairs.append(("".join(w), "".join(v)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", S.one_edit(S.F.col("a"), S.F.col("b")).alias("x")).collect()
    assert len(got) == len(pairs) and 60 < sum(r.x for r in got) < 300
    for r in got:
        assert r.x == one_edit(r.a, r.b), (r.a, r.b)
