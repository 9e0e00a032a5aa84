import math

import numpy as np
import pytest
from rows import CLASHING

from lectern.llm import topk
from pyspark.sql import functions as F


def brute(rows, is_query, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, qv in ok:
        if not is_query(q) or (q, tuple(qv)) in seen:
            continue
        seen.add((q, tuple(qv)))
        near = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def run(spark, rows, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(1))
    got = topk.exact_topk(df, df["vec_id"] % 5 == 0, k, "vec_id", "embedding", **kw)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, got.collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(i, [0.5] * 8) for i in range(100, 140)]                       # ties
    rows += [(200, None), (201, [1.0, None] + [0.0] * 6), (205, [float("nan")] * 8), (210, [float("inf")] * 8),
             (215, [1.0, 2.0]), (216, [3.0, 4.0]), (220, []), (221, []), (None, [1.0] * 8)]
    rows += [rows[5], rows[7], (7, [0.25] * 8)]                             # repeated rows, an id with two vectors
    want = brute(rows, lambda i: i % 5 == 0, 5)
    assert run(spark, rows) == want
    assert run(spark, rows, block_bytes=400) == want                        # several passes


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [4000.0 + i, -3999.5 - i, 0.001]) for i in range(30)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_best_cuts_ties_by_id():
    score = np.zeros((2, 100), np.int64)
    ids = np.arange(100)[::-1].copy()
    s, i = topk._best(score, ids, 3)
    assert i.tolist() == [[0, 1, 2]] * 2 and (s == 0).all()


@pytest.mark.parametrize("size", [5000.0, 1e6])
def test_components_of_any_size_stay_apart(spark, size):
    rows = [(i, [size * (1 + i % 7), -size + i, 0.25 * i]) for i in range(30)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_products_beyond_64_bits_are_exact_or_an_error():
    q = np.array([[2.0 ** 40, 2.0 ** 40, 3.0], [2.0 ** 31, 2.0 ** 30, 1.0], [0.0, 1.0, 2.0 ** 62]])
    v = np.array([[2.0 ** 40, -2.0 ** 40, 5.0], [2.0 ** 31 - 1, 1.0, 7.0], [7.0, -5.0, 1.0]])
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in q]
    big = np.array([[abs(s) >= 2 ** 63 - 1 for s in line] for line in want])
    assert big.any() and not big.all() and want[0][0] == 15
    with pytest.raises(OverflowError):
        topk._product(q, v)
    got = topk._product(q, v, big)
    assert [int(s) for s in got[~big]] == [s for line, b in zip(want, big) for s, x in zip(line, b) if not x]


def test_a_component_beyond_64_bits_is_an_error():
    import pyarrow as pa

    for x in (2.0 ** 55, -1e300, 1.7e308):
        with pytest.raises(OverflowError):
            topk._scaled(pa.array([[x, 0.0]], pa.list_(pa.float64())))
