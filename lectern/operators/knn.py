"""Exact k-nearest-neighbour search of question vectors
against an index table (squared L2 distance, ties broken by id).

No join emits question x vector pairs. The index is scanned once by
``mapInArrow`` tasks; each task scores its vectors against the questions
with a matrix product (float32), keeps per question only candidates within
a rounding margin of its k-th best, recomputes their distances exactly in
float64 (summing dimensions in order), and carries a running top-k across
its batches, whose rows come sorted by id within the task. Only ``k`` rows per question per task leave the task; the
final top-k is a window rank per question (Spark plans a partial
``WindowGroupLimit`` before that small shuffle).

Scoring reads only ids and vectors, and candidates carry only
``(question, id, distance)``. Index columns the caller wants with the hits
(text, metadata, vectors) are attached to the final ``questions x k`` hits
by a join. With many scoring tasks, candidates outnumber hits by the task
count, so carrying text through them would shuffle most of the corpus. The
hits are written once to the shared checkpoint folder and measured. They
are broadcast into a scan of the wanted columns only when their measured
size fits ``broadcast_max_bytes``, else joined by a shuffle. Index ids must
be unique (chunk ids are).

Questions reach the tasks in one of two ways:

* **broadcast** when ``count x dim x 4`` bytes fits ``broadcast_max_bytes``
  (the size is checked with an aggregate before anything is collected);
* **blocks** otherwise: the questions are numbered and stored once, and each
  block of as many as fit the bound has a pass of its own over the index: it
  is broadcast, scored, ranked, and its hits (k rows a question) are stored
  before the next one starts. No index row is shuffled, and driver and tasks
  hold one block at a time. A pass reads a vector once for a whole block of
  questions, thousands of multiplications a byte, so that reading the index
  again costs little beside the scoring, and a shuffle of it for each block
  costs much;
* **grid** (only when asked for): questions are hashed into ``QB`` blocks that
  each fit the bound, index rows into ``G`` groups, and ``cogroup`` on
  ``(group, block)`` scores every block against every group. Nothing passes
  through the driver, but the index is copied through a shuffle for each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BROADCAST_MAX_BYTES = 64 << 20
DEFAULT_GROUP_ROWS = 200_000
_BLOCK_CELLS = 1 << 19    # questions x vectors scored at once: as many as stay in a core's cache
_PIECE_ROWS = 512         # vectors scored at once, at most
_FIRST_ROWS = 256         # and at first
_EXACT_ROWS = 1 << 12     # candidate pairs whose exact distance is taken at once
_HELD_IDS = 1 << 20       # ids a task holds before it drops those that are out
SALTS = 64                # groups of the first level of the final top-k


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector of length ``dim``, their float32 matrix)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros((0, dim), dtype=np.float32)
    lens = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    good = np.nonzero(valid & (np.nan_to_num(lens, nan=-1) == dim))[0]
    if len(good) == 0:
        return good, np.zeros((0, dim), dtype=np.float32)
    sub = col.take(pa.array(good))
    flat = pc.list_flatten(sub).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return good, flat.reshape(len(good), dim)


def _exact(qm: np.ndarray, vm: np.ndarray) -> np.ndarray:
    """Row-wise squared L2 in float64, summed over dimensions in order."""
    diff = np.subtract(qm.T, vm.T, dtype=np.float64, order="C")
    np.multiply(diff, diff, out=diff)
    acc = np.zeros(len(qm), dtype=np.float64)
    for of_dimension in diff:
        acc += of_dimension
    return acc


def _exact_pairs(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """``_exact`` of many index pairs, in slices of bounded memory."""
    out = np.empty(len(qi), dtype=np.float64)
    for s in range(0, len(qi), _EXACT_ROWS):
        e = s + _EXACT_ROWS
        out[s:e] = _exact(q[qi[s:e]], v[vi[s:e]])
    return out


class TopK:
    """Running exact top-k per question over streamed index batches.

    Rows must come in the order of their ids, so that of two at the same
    distance the earlier one wins and ids need not be compared. A question
    block's distances are one matrix product that stays in a core's cache and
    one maximum a question, compared with its exact k-th best so far; only
    where that passes are the cells looked at again. Pieces of the
    index start small and grow with what was seen, so that the first bounds
    are taken from few vectors and about k pass for each doubling."""

    def __init__(self, qmat: np.ndarray, k: int, id_col: str):
        self.q = qmat.astype(np.float32, copy=False)
        self.qn = np.einsum("ij,ij->i", self.q, self.q)
        self.k, self.id_col = k, id_col
        self.dim = qmat.shape[1]
        # The k best so far per question: exact distance (inf until k were
        # seen) and place in ``ids``, the ids seen so far.
        self.dist = np.full((len(self.q), k), np.inf)
        self.pos = np.full((len(self.q), k), -1, dtype=np.int64)
        self.ids: list[pa.Array] = []
        self.held = 0
        self.seen = 0

    def add(self, tbl: pa.Table, vec_col: str):
        rows, v = _matrix(tbl.column(vec_col), self.dim)
        if len(rows) == 0 or len(self.q) == 0:
            return
        ids = tbl.column(self.id_col)
        self.ids.append((ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).take(pa.array(rows)))
        vn = np.einsum("ij,ij->i", v, v)
        finite = vn[np.isfinite(vn)]
        tol = 6.0 * (self.dim + 4) * 2.0 ** -24 * (self.qn.astype(np.float64) + (finite.max() if len(finite) else 0.0)) + 1e-12
        # |q - v|^2 = |q|^2 - (2 qv - |v|^2); the bracket is one product.
        wide = np.empty((len(v), self.dim + 1), dtype=np.float32)
        np.multiply(v, 2.0, out=wide[:, :-1])
        np.negative(vn, out=wide[:, -1])
        pieces, lo = [], 0
        while lo < len(v):
            hi = min(len(v), lo + min(_PIECE_ROWS, max(_FIRST_ROWS, self.seen + lo)))
            pieces.append((lo, hi))
            lo = hi
        widest = max(hi - lo for lo, hi in pieces)
        step = max(1, _BLOCK_CELLS // widest)
        cells = np.empty(step * widest, dtype=np.float32)
        for s in range(0, len(self.q), step):
            e = min(s + step, len(self.q))
            qb = np.ones((e - s, self.dim + 1), dtype=np.float32)
            qb[:, :-1] = self.q[s:e]
            floor, waiting, n_waiting = None, [], 0
            for lo, hi in pieces:
                near = cells[:(e - s) * (hi - lo)].reshape(e - s, hi - lo)
                np.matmul(qb, wide[lo:hi].T, out=near)
                # A vector can only enter the top k if it is no worse than
                # the k-th best so far (or among this piece's k best).
                if hi - lo > self.k and (self.pos[s:e, -1] < 0).any():
                    near[np.isnan(near)] = -np.inf
                    best = np.partition(near, hi - lo - self.k, axis=1)[:, hi - lo - self.k]
                    kth = np.minimum(self.dist[s:e, -1], self.qn[s:e] - best.astype(np.float64))
                    floor = (self.qn[s:e] - kth - tol[s:e]).astype(np.float32)
                elif floor is None:
                    floor = (self.qn[s:e] - self.dist[s:e, -1] - tol[s:e]).astype(np.float32)
                # Few questions have any: only theirs are looked through (and
                # those with a cell that is no number, which no maximum shows).
                some = np.flatnonzero(~(near.max(axis=1) < floor))
                qi, vi = np.nonzero(near[some] >= floor[some, None])
                if len(qi) == 0:
                    continue
                # Pruned per block: even where all vectors tie, one block's
                # cells are all that is held beside the k best. What passes is
                # merged when there is some for every question, as the bounds
                # are not much tighter before.
                if n_waiting + len(qi) > _BLOCK_CELLS:
                    self._merge_all(waiting, v)
                    waiting, n_waiting = [], 0
                waiting.append((some[qi] + s, vi + lo))
                n_waiting += len(qi)
                if n_waiting >= e - s:
                    self._merge_all(waiting, v)
                    floor, waiting, n_waiting = None, [], 0
            self._merge_all(waiting, v)
        self.held += len(v)
        self.seen += len(v)
        if self.held > max(_HELD_IDS, 4 * self.pos.size):
            self._forget()

    def _merge_all(self, waiting: list[tuple[np.ndarray, np.ndarray]], v: np.ndarray):
        """Candidate pairs of some pieces, each by question, then place."""
        if waiting:
            qi, vi = (np.concatenate(x) for x in zip(*waiting))
            order = np.argsort(qi, kind="stable")
            self._merge(qi[order], vi[order], v)

    def _merge(self, qi: np.ndarray, vi: np.ndarray, v: np.ndarray):
        """Candidate pairs, sorted by question, then place."""
        dist = _exact_pairs(self.q, v, qi, vi)
        # At the k-th best's distance the earlier row stays.
        new = (dist < self.dist[qi, -1]) | (self.pos[qi, -1] < 0)
        qi, dist, pos = qi[new], dist[new], vi[new] + self.held
        if len(qi) == 0:
            return
        own = qi[np.r_[True, qi[1:] != qi[:-1]]]
        q = np.r_[np.repeat(own, self.k), qi]
        d = np.r_[self.dist[own].ravel(), dist]
        p = np.r_[self.pos[own].ravel(), pos]
        there = p >= 0
        q, d, p = q[there], d[there], p[there]
        order = np.lexsort((d, q))  # stable: at equal distances by place
        q, d, p = q[order], d[order], p[order]
        starts = np.r_[0, np.nonzero(np.diff(q))[0] + 1]
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        top = rank < self.k
        self.dist[q[top], rank[top]] = d[top]
        self.pos[q[top], rank[top]] = p[top]

    def _forget(self):
        """Hold only the ids among the k best."""
        used = np.unique(self.pos[self.pos >= 0])
        self.ids = [pa.concat_arrays(self.ids).take(pa.array(used))]
        self.pos = np.where(self.pos < 0, -1, np.searchsorted(used, self.pos))
        self.held = len(used)

    @property
    def state(self) -> pa.Table | None:
        """``_q, _id, _d`` of the k best so far; None before any vector."""
        if not self.ids:
            return None
        there = self.pos >= 0
        return pa.table({"_q": pa.array(np.nonzero(there)[0].astype(np.int32)),
                         "_id": pa.concat_arrays(self.ids).take(pa.array(self.pos[there])),
                         "_d": pa.array(self.dist[there])})


def _out_schema(questions: DataFrame, index: DataFrame, q_id: str, i_id: str) -> T.StructType:
    return T.StructType(
        [T.StructField(q_id, questions.schema[q_id].dataType),
         T.StructField(i_id, index.schema[i_id].dataType),
         T.StructField("distance", T.DoubleType())])


def _emit(tk: TopK, qids: pa.Array, q_id: str, i_id: str):
    st = tk.state
    if st is None or st.num_rows == 0:
        return None
    arrays = [qids.take(st.column("_q")), st.column("_id"), st.column("_d")]
    return pa.Table.from_arrays(arrays, names=[q_id, i_id, "distance"])


def _final_rank(cands: DataFrame, k: int, q_id: str, i_id: str) -> DataFrame:
    """Top k per question over the per-task candidates.

    Every scoring task sends k rows per question, so one question has
    ``k x tasks`` candidates. They are first reduced per (question, salt)
    group, so that no window group grows with the index alone; the plan
    does not depend on the number of tasks."""
    order = [F.col("distance").asc(), F.col(i_id).asc()]
    salted = cands.withColumn("_s", F.pmod(F.xxhash64(F.col(i_id)), F.lit(SALTS)))
    w1 = Window.partitionBy(q_id, "_s").orderBy(*order)
    cands = (salted.withColumn("_r", F.row_number().over(w1))
             .filter(F.col("_r") <= k).drop("_s", "_r"))
    w = Window.partitionBy(q_id).orderBy(*order)
    ranked = cands.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k)


def knn(questions: DataFrame, index: DataFrame, k: int,
        q_id: str = "question_id", q_vec: str = "vector",
        i_id: str = "chunk_id", i_vec: str = "vector", carry=(),
        broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
        group_rows: int = DEFAULT_GROUP_ROWS,
        strategy: str = "auto", dim: int | None = None) -> DataFrame:
    """Hits ``(question_id, rank, chunk_id, distance, *carry)``: for each
    question its ``k`` nearest index rows (fewer when the index is
    smaller). ``dim`` is the index's vector length (read off its first
    vector when not given). Rows without a vector, or with a vector of
    another length, are not searchable; a question without a vector gets no
    hits, and one with a vector of another length than ``dim`` is an error.

    Both inputs are read more than once (the questions for the size check
    and then the search, the index for its row count on the grid path and
    for ``carry``), so pass stored tables or checkpoints, not lineages
    with model calls in them; ``plans.serve.retrieve`` checkpoints the
    question vectors for that reason."""
    if k < 1:
        raise ValueError("k must be >= 1")
    carry = [c for c in carry if c not in (i_id,)]
    qs = questions.select(q_id, q_vec).filter(F.col(q_vec).isNotNull())
    if dim is None:
        some = index.filter(F.col(i_vec).isNotNull()).select(F.size(i_vec).alias("dim")).first()
        dim = int(some["dim"]) if some else 0
    stats = qs.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(q_vec) != dim, 1)).alias("odd")).first()
    nq = int(stats["n"])
    if dim and stats["odd"]:
        raise ValueError(f"{stats['odd']} questions have vectors of another length than the index's {dim}")
    schema = _out_schema(questions, index, q_id, i_id)
    if nq == 0 or dim == 0:
        empty = index.sparkSession.createDataFrame([], schema)
        empty = empty.withColumn("rank", F.lit(1)).filter(F.lit(False))
        for c in carry:
            empty = empty.withColumn(c, F.lit(None).cast(index.schema[c].dataType))
        return empty.select(q_id, "rank", i_id, "distance", *carry)
    qbytes = nq * dim * 4
    if strategy == "auto":
        strategy = "broadcast" if qbytes <= broadcast_max_bytes else "blocks"
    idx = index.select(i_id, i_vec)
    if strategy == "broadcast":
        if qbytes > broadcast_max_bytes:
            raise ValueError("questions exceed the broadcast bound")
        cands, _ = _broadcast_scan(qs, idx, k, q_id, q_vec, i_id, i_vec, dim, schema)
    elif strategy == "blocks":
        hits = _block_scans(qs, idx, k, q_id, q_vec, i_id, i_vec, dim, schema, max(1, broadcast_max_bytes // (dim * 4)))
        return _attach(hits, index, q_id, i_id, carry, broadcast_max_bytes) if carry else hits
    elif strategy == "grid":
        cands = _grid_scan(qs, idx, k, q_id, q_vec, i_id, i_vec, dim, schema,
                           nq, broadcast_max_bytes, group_rows)
    else:
        raise ValueError(strategy)
    hits = _final_rank(cands, k, q_id, i_id).select(q_id, "rank", i_id, "distance")
    if not carry:
        return hits
    return _attach(hits, index, q_id, i_id, carry, broadcast_max_bytes)


# Bytes of one hit row besides its two ids (row header, rank, distance and
# the ids' offsets), used to bound the broadcast of measured hits.
_HIT_ROW_OVERHEAD = 64


def _attach(hits: DataFrame, index: DataFrame, q_id: str, i_id: str, carry: list[str],
            broadcast_max_bytes: int) -> DataFrame:
    """Index columns ``carry`` for each hit, joined on the (unique) id."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(hits.sparkSession)
    hits = hits.checkpoint(eager=True)
    size = hits.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.octet_length(F.col(q_id).cast("string"))).alias("lq"),
        F.max(F.octet_length(F.col(i_id).cast("string"))).alias("li")).first()
    n = int(size["n"])
    row = _HIT_ROW_OVERHEAD + int(size["lq"] or 0) + int(size["li"] or 0)
    small = F.broadcast(hits) if n * row <= broadcast_max_bytes else hits
    meta = index.select(i_id, *carry)
    return meta.join(small, i_id).select(q_id, "rank", i_id, "distance", *carry)


def _block_scans(qs, idx, k, q_id, q_vec, i_id, i_vec, dim, schema, block_rows: int) -> DataFrame:
    """Hits of all questions, a pass over the index for each block of
    ``block_rows``."""
    from ..session import scratch_path
    from .batches import BATCH, sliced

    rows = sliced(qs, [F.col(q_id)], block_rows)
    path = scratch_path(idx.sparkSession, "knn-blocks")
    blocks = rows.agg(F.max(BATCH)).first()[0] + 1
    for b in range(blocks):
        block = rows.filter(F.col(BATCH) == b).select(q_id, q_vec)
        cands, sent = _broadcast_scan(block, idx, k, q_id, q_vec, i_id, i_vec, dim, schema)
        _final_rank(cands, k, q_id, i_id).select(q_id, "rank", i_id, "distance").write.parquet(f"{path}/block={b}")
        sent.destroy()
    hits = idx.sparkSession.read.parquet(path)
    return hits.select(q_id, "rank", i_id, "distance")


def _broadcast_scan(qs, idx, k, q_id, q_vec, i_id, i_vec, dim, schema):
    spark = idx.sparkSession
    qt = qs.toArrow()  # bounded: size checked by the caller
    rows, qmat = _matrix(qt.column(q_vec), dim)
    qids = qt.column(q_id).combine_chunks().take(pa.array(rows))
    bc = spark.sparkContext.broadcast((qids, qmat))

    def score(batches):
        ids, mat = bc.value
        tk = TopK(mat, k, i_id)
        for b in batches:
            tk.add(pa.Table.from_batches([b]), i_vec)
        out = _emit(tk, ids, q_id, i_id)
        if out is not None:
            yield from out.to_batches()

    return idx.sortWithinPartitions(F.col(i_id).asc_nulls_last()).mapInArrow(score, schema), bc


def _grid_scan(qs, idx, k, q_id, q_vec, i_id, i_vec, dim, schema,
               nq, broadcast_max_bytes, group_rows):
    n_index = idx.count()
    groups = max(1, math.ceil(n_index / group_rows))
    blocks = max(1, math.ceil(nq * dim * 4 / broadcast_max_bytes))
    # Both sides must carry the keys with the same type, or equal keys
    # would hash to different partitions and never meet.
    left = (idx.withColumn("_g", F.pmod(F.xxhash64(F.col(i_id)), F.lit(groups)).cast("long"))
            .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    right = (qs.withColumn("_b", F.pmod(F.xxhash64(F.col(q_id)), F.lit(blocks)).cast("long"))
             .withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))

    def score(left_t: pa.Table, right_t: pa.Table) -> pa.Table:
        empty = pa.Table.from_pylist([], schema=_arrow_schema(left_t, right_t, q_id, i_id))
        if left_t.num_rows == 0 or right_t.num_rows == 0:
            return empty
        rows, qmat = _matrix(right_t.column(q_vec), dim)
        qids = right_t.column(q_id).combine_chunks().take(pa.array(rows))
        tk = TopK(qmat, k, i_id)
        tk.add(left_t.sort_by(i_id), i_vec)
        out = _emit(tk, qids, q_id, i_id)
        return empty if out is None else out.cast(empty.schema)

    return (left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b"))
            .applyInArrow(score, schema))


def _arrow_schema(left_t, right_t, q_id, i_id):
    return pa.schema([pa.field(q_id, right_t.schema.field(q_id).type),
                      pa.field(i_id, left_t.schema.field(i_id).type),
                      pa.field("distance", pa.float64())])
