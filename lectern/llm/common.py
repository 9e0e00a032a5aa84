"""Small helpers the operators of this package share."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, scratch_path, small_batches  # noqa: F401 - for the operators


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, through Spark's reader (any store it can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch_dropped(spark: SparkSession):
    """Tables ``stored`` inside are removed at the end, from the shared folder
    too. What is needed afterwards is stored outside of it by ``keep``, the
    function that it gives."""
    made: list[str] = []
    token = _MADE.set(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        made.pop()
        return out

    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and
    read back. It cuts the lineage, is column-pruned when read, and survives
    the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of text that a task works on together, and rows at most.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 512


def slices(batch, column: str = "text"):
    """Slices of an Arrow batch of at most ``SLICE_BYTES`` of text (a longer
    text stands alone) and ``SLICE_ROWS`` rows: what is held beside a batch is
    bounded by bytes, wherever long texts stand together."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        room = (size[lo - 1] if lo else 0) + SLICE_BYTES
        hi = min(max(lo + 1, int(np.searchsorted(size, room, side="right"))), lo + SLICE_ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def release() -> None:
    """Give memory that Arrow keeps for later back to the system, between
    batches: a Python worker lives on from stage to stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``(id, text)``: a null text counts as empty, and no other column
    (whatever its name) reaches the operator."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
