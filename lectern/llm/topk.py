"""Operator 10: exact top-k search by tiled matrix products.

Every vector component x becomes floor(256 * x). Queries are collected in
blocks of a bounded number of bytes (measured first; as many blocks as the
queries need, each one pass over the vectors whose result is stored before the
next block is loaded). A pass broadcasts its block;
a task multiplies it with its shard tile by tile, selects each query's best k
of a tile, and keeps a running list. A task hands on k rows a query, and the
lists are merged up a tree: first within groups of shards, then over all.

Defined results: a vector that is null or holds null or non-finite components
takes no part, as a query or as a candidate, and neither does a row without
an id. A query's candidates are the rows of its own dimension with another
id. Ties go to the smaller id. Repeated rows are candidates each; a query row
repeated with the same vector is answered once. Scores are exact whole
numbers; an empty table has no queries and gives no rows; other columns are
never read, whatever their names; a scaled component, or the score of a query and a candidate, that is
no 64-bit integer is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.batches import BATCH, sliced
from ..session import scratch_path

#: Bytes of queries (as 64-bit floats) that one pass broadcasts.
BLOCK_BYTES = 32 << 20
#: Rows and queries of a tile; a tile's product has so many scores.
TILE = 2048
#: Groups of shards merged at the first level of the tree.
FAN_IN = 64
_NONE = np.iinfo(np.int64).min


def _usable(vec: Column) -> Column:
    """Not null, and every component a finite number."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & ok


def _scaled(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows' positions and their integer matrix, by dimension."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.floor(flat * 256.0)
    if (np.abs(flat) >= 2.0 ** 63).any():
        raise OverflowError("a component times 256 does not fit a 64-bit integer")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        out.append((at, flat[starts[at][:, None] + np.arange(dim)]))
    return out


def _product(q: np.ndarray, v: np.ndarray, unasked: np.ndarray | None = None) -> np.ndarray:
    """Exact integer products: in floats where every partial sum is a whole
    number below 2^53, else in 64-bit integers. Those are right but for a
    multiple of 2^64; where the score is not safely small, Python's integers
    tell. The pairs of ``unasked`` may have any score."""
    top = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    if top < 2 ** 53:
        return (q @ v.T).astype(np.int64)
    score = q.astype(np.int64) @ v.astype(np.int64).T
    if top >= 2 ** 62:
        error = np.abs(q) @ np.abs(v).T * (q.shape[1] + 4) * 2.0 ** -52
        unsure = np.abs(q @ v.T) + error >= 2 ** 62
        if unasked is not None:
            unsure &= ~unasked
        for i, j in zip(*np.nonzero(unsure)):
            exact = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), v[j].tolist()))
            if abs(exact) >= 2 ** 63 - 1:          # the lowest numbers mark what is no candidate
                raise OverflowError("a score does not fit a 64-bit integer")
            score[i, j] = exact
    return score


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k largest scores with their ids, the smaller id first among
    equals. ``ids`` is one row or one for each row of scores."""
    n = score.shape[1]
    if ids.ndim == 1:
        order = np.argsort(ids, kind="stable")
        score, ids = score[:, order], np.broadcast_to(ids[order], score.shape)
    else:
        order = np.argsort(ids, axis=1, kind="stable")
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    if n > 4 * k and (score.max(initial=0) < 2 ** 62 // n) and (score[score != _NONE].min(initial=0) > -(2 ** 62) // n):
        # One number ranks score and position together: whole ties are cut right.
        key = np.where(score == _NONE, _NONE, score * n + (n - 1 - np.arange(n)))
        pick = np.argpartition(key, n - k, axis=1)[:, n - k:]
        pick.sort(axis=1)
        score, ids = np.take_along_axis(score, pick, 1), np.take_along_axis(ids, pick, 1)
    order = np.argsort(-np.maximum(score, _NONE + 1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _shard_lists(block: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """The function that scores a block (query rows, ids and matrix of each
    dimension) against a shard."""

    def run(batches):
        from pyspark import TaskContext

        best = [[np.full((len(r), k), _NONE), np.zeros((len(r), k), np.int64)] for r, _, _ in block]
        by_dim = {m.shape[1]: i for i, (_, _, m) in enumerate(block)}
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for at, matrix in _scaled(b.column("v")):
                i = by_dim.get(matrix.shape[1])
                for lo in range(0, len(at) if i is not None else 0, TILE):
                    tile, own = matrix[lo:lo + TILE], ids[at[lo:lo + TILE]]
                    _, q_ids, q = block[i]
                    for a in range(0, len(q), TILE):
                        same = q_ids[a:a + TILE, None] == own[None, :]
                        s = _product(q[a:a + TILE], tile, same)
                        s[same] = _NONE
                        ts, ti = _best(s, own, min(k, s.shape[1]))
                        rs, ri = (x[a:a + TILE] for x in best[i])
                        ms, mi = _best(np.hstack([rs, ts]), np.hstack([ri, ti]), k)
                        best[i][0][a:a + TILE], best[i][1][a:a + TILE] = ms, mi
        shard = TaskContext.get().partitionId()
        for (rows, q_ids, _), (s, v) in zip(block, best):
            keep = s != _NONE
            n = keep.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rows, n)), pa.array(np.repeat(q_ids, n)), pa.array(np.full(n.sum(), shard, np.int64)),
                 pa.array(v[keep]), pa.array(s[keep])],
                ["query_row", "query_id", "shard", "vec_id", "score"])

    return run


def _load(rows: pa.Table, first: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block's distinct query rows by dimension, numbered from ``first``."""
    rows = rows.combine_chunks()
    ids = rows.column("id").to_numpy()
    column = rows.column("v").combine_chunks()
    out = []
    for at, matrix in _scaled(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column):
        key = np.unique(np.column_stack([ids[at].astype(np.int64), matrix.astype(np.int64)]), axis=0)
        out.append((np.arange(first, first + len(key)), key[:, 0], key[:, 1:].astype(np.float64)))
        first += len(key)
    return out


def exact_topk(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id long, rank int, vec_id long, score long``: for each row of
    ``vectors`` where ``is_query`` holds, its k best other rows."""
    flagged = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"),
                             F.coalesce(is_query, F.lit(False)).alias("q"))
    usable = flagged.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    queries = usable.filter("q").select("id", "v")
    need, longest = queries.agg(F.sum(8.0 * F.size("v") + 8), F.max(F.size("v"))).first()

    def merged(rows: DataFrame, *by) -> DataFrame:
        w = Window.partitionBy("query_row", *by).orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def searched(block: DataFrame) -> DataFrame:
        lists = usable.select("id", "v").mapInArrow(
            _shard_lists(_load(block.toArrow(), 0), k), "query_row long, query_id long, shard long, vec_id long, score long")
        group = F.pmod(F.col("shard"), F.lit(FAN_IN)).alias("shard")
        first = merged(lists.select("query_row", "query_id", group, "vec_id", "score"), "shard").drop("rank")
        return merged(first).select("query_id", "rank", "vec_id", "score")

    if 1.5 * (need or 0.0) <= block_bytes:
        return searched(queries)
    # Each pass is stored before the next one's block is loaded: the driver
    # holds one block. Distinct query rows are numbered, so a block is full
    # and no larger, whatever id repeats.
    rows = max(1, int(block_bytes / (1.5 * (8 * longest + 8))))
    dealt = sliced(queries.distinct(), [F.col("id"), F.col("v")], rows)
    path = scratch_path(vectors.sparkSession, "topk")
    for i in range(dealt.agg(F.max(BATCH)).first()[0] + 1):
        searched(dealt.filter(F.col(BATCH) == i).select("id", "v")).write.parquet(f"{path}/block={i}")
    return vectors.sparkSession.read.parquet(path).select("query_id", "rank", "vec_id", "score")

