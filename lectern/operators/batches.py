"""Batches of a fixed size in one global order, for calls to models.

Rows get their place in the order by a distributed prefix sum: they are
range-partitioned and sorted, each partition's rows are counted, and a row's
place is the sum of the counts before its partition plus its place in it. Only
one number a partition passes the driver. Batch ``n`` holds the places from
``n * size`` on, so batches are the same on any cluster and after any retry,
no group is larger than ``size``, and tasks grow with the rows.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

PLACE, BATCH = "_place", "_slice"


def numbered(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """``df`` with ``_place``: from 0, in the order ``order_by`` (rows that it
    does not tell apart come in any order). The rows are stored once."""
    ensure_checkpoint_dir(df.sparkSession)
    at = F.monotonically_increasing_id()           # partition in the upper bits, place within it below
    rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_at", at).checkpoint(eager=True)
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    first = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _first long")
    placed = rows.withColumn("_part", part).join(F.broadcast(first), "_part")
    return placed.withColumn(PLACE, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_at")


def sliced(df: DataFrame, order_by: list[Column], size: int) -> DataFrame:
    """``numbered`` rows with ``_slice``, the number of their batch."""
    return numbered(df, order_by).withColumn(BATCH, F.floor(F.col(PLACE) / size))


def call_in_batches(df: DataFrame, order_by: list[Column], size: int, call, fields: list[T.StructField],
                    error_col: str) -> DataFrame:
    """``df`` with ``fields`` and ``error_col``: ``call`` gets each batch as
    a ``pyarrow.Table`` and returns one list a field, a value for each row. A
    batch whose call fails keeps its rows, with nulls and the error."""
    rows = sliced(df, order_by, size).repartition(F.col(BATCH)).sortWithinPartitions(BATCH, PLACE)
    names = df.columns
    schema = T.StructType(df.schema.fields + fields + [T.StructField(error_col, T.StringType())])
    kinds = [_arrow(f.dataType) for f in fields]

    def done(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).select(names)
        n, error = table.num_rows, None
        try:
            values = [list(v) for v in call(table)]
            if [len(v) for v in values] != [n] * len(fields):
                raise ValueError(f"{[len(v) for v in values]} values for {n} rows")
            arrays = [pa.array(v, type=k) for v, k in zip(values, kinds)]
        except Exception as e:  # noqa: BLE001 - a failed call fails its batch only
            error = f"{type(e).__name__}: {e}"
            arrays = [pa.nulls(n, type=k) for k in kinds]
        own = [table.column(i).combine_chunks() for i in range(table.num_columns)]
        return pa.RecordBatch.from_arrays([*own, *arrays, pa.array([error] * n, pa.string())], names=schema.names)

    def run(batches):
        held, now = [], None
        for b in batches:
            of, start = b.column(BATCH).to_pylist(), 0
            for i in range(1, len(of) + 1):
                if i == len(of) or of[i] != of[start]:
                    if held and now != of[start]:
                        yield done(held)
                        held = []
                    held.append(b.slice(start, i - start))
                    now, start = of[start], i
        if held:
            yield done(held)

    return rows.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
