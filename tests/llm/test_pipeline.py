import hashlib
import random
import re
import zlib

import corpus_pipeline as P
from rows import CLASHING, by_id, documents
from test_bpe import THEIRS
from test_decontaminate import expected as leaks
from test_neardup import classes
from test_secrets import expected as secrets

BENCH = "Window words of the benchmark item stand here in their own order today"


def world(spark, scratch):
    rng = random.Random(0)
    body = [f"w{i}" for i in range(60)]
    clean = body + (BENCH + " leak end password kept another clean text extra").split()
    labelled = []
    for i in range(240):
        words = rng.sample(clean, 40)
        if i % 4 == 0:
            words[3:3] = rng.sample(["stupid", "idiot", "moron", "scum"], 3)
        labelled.append(" ".join(words))
    labels = [(1000 + i, 0, int(i % 4 == 0)) for i in range(240)]
    texts = labelled + [None, "", " ".join(body), " ".join(body), " ".join(body) + " extra", "leak: " + BENCH + " end",
                        "password = Q1w2E3r4T5y6 kept", "another clean text", "another clean text"]
    ids = [1000 + i for i in range(240)] + [1, 2, 3, 4, 5, 6, 7, None, None]
    docs = documents(spark, texts, ids=ids, sources=["s"] * len(texts))
    docs.repartition(3).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    return texts, ids


def test_stages_decide_by_their_operators(spark, scratch):
    world(spark, scratch)
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    assert set(CLASHING) <= set(docs.columns)
    before = docs.select(*P.COLUMNS).collect()
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, scratch)
        assert out.columns == list(P.COLUMNS) and [f.dataType for f in out.schema] == [docs.schema[c].dataType for c in P.COLUMNS]
        out.write.parquet(f"{scratch}/stage{k}")
        docs = spark.read.parquet(f"{scratch}/stage{k}")
        after = docs.collect()
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            held = {i for i in range(1000, 1240) if zlib.crc32(str(i).encode()) % 4 == 2}
            bad = {1000 + i for i in range(0, 240, 4)}
            assert len(gone & bad) > 0.95 * len(bad) and held & gone and len(gone - bad) < 10 and not gone & set(range(8))
        elif name == "near_dedup":
            named = classes([(r.doc_id, r.text) for r in before], 5)
            want = sorted({k for k, _, c in named if k is not None and k == c})
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == want
            assert [r.text for r in after if r.doc_id is None] == ["another clean text"]
        elif name == "decontaminate":
            hit = leaks([r.text for r in before], [(1, BENCH)])
            assert sorted(map(str, (r.doc_id for r in after))) == sorted(str(r.doc_id) for r, h in zip(before, hit) if not h[1])
        else:
            texts = by_id(after)
            assert texts[7][0].text == "[SECRET] kept" and texts[7][0].n_chars == 13
            same = [r for r, (plain, _) in zip(before, secrets([(r.text, r.source) for r in before])) if not plain]
            assert {(r.doc_id, r.text, r.n_chars) for r in same} <= {(r.doc_id, r.text, r.n_chars) for r in after}
        before = after
    rows = P.STAGES[-1][1](spark, docs, scratch).collect()
    assert len(rows) == len(before)
    for r in rows:
        (text,) = {b.text for b in before if b.doc_id == r.doc_id}
        assert r.n_tokens == len(THEIRS.encode_ordinary(text or ""))
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    got = P.run(spark, scratch)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((str(r.doc_id), r.n_tokens) for r in rows)


def test_empty_documents(spark, scratch):
    world(spark, scratch)
    docs = spark.read.parquet(f"{scratch}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, scratch)
        assert docs.collect() == []
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert re.match("doc_id", P.STAGES[-1][1](spark, docs, scratch).columns[0])


def test_dedup_judges_rows_not_ids(spark, scratch):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, b), (7, a), (7, b + " more"),            # a stands nowhere else; 7's other text copies 3
            (5, c), (5, c + " more"), (9, c),            # two near copies under the lowest id
            (1, None), (1, None), (1, ""), (2, None)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).repartition(3)
    out = dict(P.STAGES)["near_dedup"](spark, docs, scratch)
    assert out.columns == list(P.COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert sum(i == 5 for i, _ in got) == 1
    assert [x for x in got if x[0] != 5] == sorted([(3, b), (7, a), (1, None), (1, ""), (2, None)], key=str)
