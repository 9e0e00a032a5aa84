import re
from itertools import permutations

from rows import documents

from lectern.llm import filter_audit as A

ORDERS = ["".join(p) for p in permutations("ABCDE")]


def cells(rows):
    """Failed letters of each (id, text), by the contract's words."""
    out = []
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t in rows))
        out.append(fails)
    return out


def expected(rows, parts, quality, toxic):
    fails, want = cells(rows), {}
    for part in {p or "" for p in parts}:
        docs = [(f, quality.get(i) == 1, toxic.get(i) == 1) for f, (i, _), p in zip(fails, rows, parts) if (p or "") == part]
        for order in ORDERS:
            there = docs
            for s, x in enumerate(order, 1):
                here = [d for d in there if x in d[0]]
                there = [d for d in there if x not in d[0]]
                failing = [d for d in docs if x in d[0]]
                want[part, order, s] = [len(there), len(here), len(failing) - len(here), sum(d[0] == x for d in docs),
                                        sum(d[1] for d in here), sum(d[2] for d in here)]
        for x in "ABCDE":
            total = sum(v[1] for (p, o, s), v in want.items() if p == part and o[s - 1] == x)
            for (p, o, s), v in want.items():
                if p == part and o[s - 1] == x and len(v) == 6:
                    v.append(total)
    return want


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG), (2, LONG), (2, LONG), (2, LONG + " # X"), (3, "ABC DEF"), (4, "ABC DEF"), (5, None), (6, ""), (7, " \t\n"),
    (8, "a a a a a"), (9, "a|b " * 300), (10, LONG.upper()), (None, LONG), (None, None), (11, "é🙂 " * 200 + "É"), (12, LONG * 40 + " &"),
    (13, "ab\u00a0cd " * 201), (14, "x " * 100 + LONG), (0, LONG),
]
PARTS = ["en", "en", None, "", "en", "de", "de", None, "de", "en", "en", "fr", "en", "fr", "fr", "de", "de", "en", "en"]


def table(spark, rows, parts):
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).drop("lang")
    named = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "k long, lang string")
    numbered = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k long, doc_id long, text string")
    clash = docs.drop("doc_id", "text", "source", "n_chars").limit(1).first()
    out = numbered.join(named, "k").drop("k")
    for c in clash.asDict():
        out = out.withColumn(c, A.F.lit("own"))
    return out


def test_audit_against_brute_force(spark):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (5, None, 1), (None, 1, 1), (9, 1, 0), (11, 0, 1), (99, 1, 1)]
    marked = spark.createDataFrame([(*r, "own", "own") for r in labels], "doc_id long, quality int, toxic int, cell string, id string")
    quality, toxic = {}, {}
    for i, q, t in labels[:5] + labels[6:]:
        quality[i], toxic[i] = max(quality.get(i, 0), q or 0), max(toxic.get(i, 0), t or 0)
    got = A.filter_audit(table(spark, ROWS, PARTS).repartition(5), marked, "doc_id", "text", "lang").collect()
    want = expected(ROWS, PARTS, quality, toxic)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert [r[c] for c in (*A.COUNTS, "shapley")] == want[r.part, r.filter_order, r.step], (r.part, r.filter_order, r.step)


def test_cells_hold_every_condition():
    seen = "".join(cells(ROWS))
    assert set(seen) == set("ABCDE") and "" in cells(ROWS)


def test_empty_table_and_one_text_everywhere(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, ROWS[:1], PARTS[:1])
    assert A.filter_audit(docs.limit(0), none, "doc_id", "text", "lang").collect() == []
    rows = [(i, LONG) for i in range(300)]
    got = A.filter_audit(table(spark, rows, ["en"] * 300), none, "doc_id", "text", "lang").filter("filter_order = 'EABCD'").collect()
    assert {r.step: (r.kept, r.removed) for r in got}[1] == (1, 299)
    assert {r.shapley for r in got if r.step == 1} == {120 * 299}


def test_fewer_filters(spark):
    counted = spark.createDataFrame([("p", "", 5, 1, 0), ("p", "xy", 2, 2, 1), ("p", "y", 3, 0, 0)],
                                    "part string, cell string, n long, good long, toxic long")
    got = {(r.filter_order, r.step): tuple(r[c] for c in (*A.COUNTS, "shapley")) for r in A.audit(counted, "xy").collect()}
    assert got == {("xy", 1): (8, 2, 0, 0, 2, 1, 2), ("xy", 2): (5, 3, 2, 3, 0, 0, 8),
                   ("yx", 1): (5, 5, 0, 3, 2, 1, 8), ("yx", 2): (5, 0, 2, 0, 0, 0, 2)}
