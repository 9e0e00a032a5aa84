"""Read the parquet tables of a data directory.

Only the columns a query uses are read (Catalyst prunes the scan, and
filters are pushed to the Parquet reader, also through the optional
round-robin spread below).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Tables whose rows carry heavy per-row work (regexes, splitting, vectors).
CPU_HEAVY = {"documents", "pages", "embeddings", "conversations"}


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy rows at least ``min_partitions`` tasks.

    A small file with one row group is read by a single task, so every
    regex and Python step after it would run on one core. Only then is the
    scan spread round-robin; a large input already has one task per split
    and is returned untouched (no shuffle is added at scale).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def table(spark: SparkSession, data_dir: str, name: str, spread_rows: bool | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    if spread_rows if spread_rows is not None else name in CPU_HEAVY:
        df = spread(df)
    return df
