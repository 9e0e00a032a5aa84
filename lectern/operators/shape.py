"""Keep the known columns that exist, in a fixed order, renamed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema


def project_known(df: DataFrame, columns=schema.EVENT_COLUMNS) -> DataFrame:
    """Select the existing columns of ``columns`` (pairs of input name and
    output name) in their listed order; unknown columns are dropped and
    missing ones skipped."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{src}`").alias(dst)
                       for src, dst in columns if src in present])
