import pytest
import zlib

import numpy as np
from conftest import SF01

SF1 = SF01.replace("0.01", "0.1")
from rows import documents

from lectern.llm import queries as Q
from lectern.llm import toxicity as T
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    rows = Q.QUERIES["op8_toxicity"](spark, SF1).collect()
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    pos, neg = [s for s, v in held if v], [s for s, v in held if not v]
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.95       # area under the curve
    assert sum(s >= 0.3 for s in pos) > 0.75 * len(pos) and sum(s >= 0.3 for s in neg) < 0.05 * len(neg)


def small_model():
    rng = np.random.default_rng(0)
    vocab = ["calm", "river", "stone", "paper", "green", "window", "table", "cloud", "garden", "music"]
    bad = ["stupid", "idiot", "moron"]
    docs, y = [], []
    for i in range(400):
        w = list(rng.choice(vocab, 30))
        if i % 4 == 0:
            w[5] = str(rng.choice(bad))
        docs.append(" ".join(w))
        y.append(float(i % 4 == 0))
    return T.train(docs, np.array(y)), vocab


def test_misspellings_share_ngrams_and_repeats_do_not_decide():
    model, vocab = small_model()
    clean, odd = model.score([" ".join(vocab * 3), " ".join(vocab * 3) + " idioot stupidd"])
    assert clean < 0.3 < odd
    assert model.score(["river " * 5000])[0] < 0.3
    assert abs(model.score([""])[0] - model.score(["..."])[0]) < 1e-12


def test_awkward_rows(spark):
    model, _ = small_model()
    texts = [None, "", "you idiot", "you idiot", "calm river " * 20000]
    docs = documents(spark, texts, ids=[1, 2, 3, 3, None]).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.drop("score")
    got = [(r.doc_id, r.score, r.row) for r in T.score(docs, model).collect()]
    by = {k: s for k, s, _ in got}
    assert by[1] == by[2] and len([1 for k, *_ in got if k == 3]) == 2 and by[3] > by[1]
    assert all(own == "own row" for *_, own in got)
    assert T.score(docs.limit(0), model).collect() == []


def test_labels(spark):
    docs = documents(spark, ["a bad text", "a good text", "no label"], ids=[0, 1, 2])
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (None, 1), (9, 1), (1, None)], "doc_id long, toxic int")
    held = {i for i in range(10) if zlib.crc32(str(i).encode()) % 4 == 2}
    got, y = T.sample(docs, labels, "doc_id", "text", "toxic")
    want = {"a bad text": 1.0, "a good text": 0.0}
    assert dict(zip(got, y)) == {t: v for (t, v), i in zip(want.items(), (0, 1)) if i not in held}
    assert T.sample(docs, labels.limit(0), "doc_id", "text", "toxic")[0] == []
    assert T.train([], np.zeros(0)).score(["anything"]).tolist() == [0.0]


def test_the_sample_keeps_to_its_bytes_without_emptying_itself(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_BYTES", 3000)
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:201]
    texts = {i: f"text {i} bad" if k % 2 else f"text {i} good" for k, i in enumerate(learnt)}
    first = spark.createDataFrame([(i,) for i in learnt], "id long").orderBy(F.xxhash64("id")).first().id
    texts[first] = "long " * 700
    docs = documents(spark, [*texts.values(), "zz other text"], ids=[*texts, learnt[1]])
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(learnt)], "doc_id long, toxic int")
    got, y = T.sample(docs, labels, "doc_id", "text", "toxic")
    assert 150 <= len(got) <= 201 and sum(map(len, got)) <= 3000 and set(y) == {0.0, 1.0}
    assert len(set(got)) == len(got) and "long " * 700 not in got
    monkeypatch.setattr(T, "SAMPLE_BYTES", 5)
    with pytest.raises(ValueError):
        T.sample(docs, labels, "doc_id", "text", "toxic")
