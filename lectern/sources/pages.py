"""Paged record sources landed as JSON.

A page envelope is ``{"region": .., "offset": .., "total_count": ..,
"results": [record, ...]}``. Pages are landed one per line (JSON Lines,
splittable) or one per file (``multi_line=True``; the offset is then also
read from a ``..._<offset>.json`` file name). Reading is ``PERMISSIVE``: a
page that does not parse arrives with ``results`` null and its text in
``_corrupt``; it goes to the rejects and the completeness report, while
good pages flow on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

CORRUPT = "_corrupt"
# Timestamps are landed with microseconds so that they read back exactly.
JSON_TIME_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                     "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def envelope_schema(record_schema: T.StructType = schema.RECORD_SCHEMA) -> T.StructType:
    return T.StructType([
        T.StructField("region", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("total_count", T.LongType()),
        T.StructField("results", T.ArrayType(record_schema)),
        T.StructField(CORRUPT, T.StringType()),
    ])


def read_landed_pages(spark: SparkSession, path: str,
                      record_schema: T.StructType = schema.RECORD_SCHEMA,
                      multi_line: bool = False) -> DataFrame:
    """One row per landed page: region, offset, total_count, results,
    _corrupt, _file. Offsets missing from a broken page are recovered from
    its raw text or its file name."""
    raw = (spark.read.schema(envelope_schema(record_schema))
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT)
           .option("multiLine", multi_line)
           .options(**JSON_TIME_OPTIONS)
           .json(path)
           .withColumn("_file", F.input_file_name()))
    return normalise_pages(raw)


def normalise_pages(raw: DataFrame) -> DataFrame:
    """Recover region and offset of broken pages from their raw text or
    file name (also used by the streaming reader)."""
    from_text = F.regexp_extract(F.col(CORRUPT), r'"offset"\s*:\s*(\d+)', 1)
    from_name = F.regexp_extract("_file", r"(\d+)\.json[^/]*$", 1)
    region_text = F.regexp_extract(F.col(CORRUPT), r'"region"\s*:\s*"([^"]*)"', 1)
    return raw.select(
        F.coalesce("region", F.nullif(region_text, F.lit(""))).alias("region"),
        F.coalesce(F.col("offset"),
                   F.nullif(from_text, F.lit("")).cast("long"),
                   F.nullif(from_name, F.lit("")).cast("long")).alias("offset"),
        "total_count", "results", CORRUPT, "_file")


def is_bad_page(pages: DataFrame) -> F.Column:
    return F.col(CORRUPT).isNotNull() | F.col("results").isNull()


def good_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~is_bad_page(pages))


def rejected_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(is_bad_page(pages)).select("region", "offset", "_file", CORRUPT)


def explode_records(pages: DataFrame) -> DataFrame:
    """One row per record, page order kept in ``_ord`` =
    offset + position (the record's index in the full result set)."""
    rec = (good_pages(pages)
           .select("region", "offset", F.posexplode("results").alias("pos", "r")))
    return rec.select("region", F.col("offset").alias("page_offset"),
                      F.col("pos").cast("long").alias("pos"),
                      (F.col("offset") + F.col("pos")).alias("_ord"), "r.*")


def page_facts(pages: DataFrame) -> DataFrame:
    """What completeness needs to know of each landed page: ``region,
    offset, _own`` (names a page without an offset), ``_n`` (its records, null
    if it is broken) and ``total_count``."""
    n = F.when(~is_bad_page(pages), F.size("results"))
    own = F.when(F.col("offset").isNull(), F.xxhash64("_file", CORRUPT, F.to_json("results")))
    return pages.select("region", "offset", own.alias("_own"), n.alias("_n"), "total_count")


def completeness(pages: DataFrame) -> DataFrame:
    """S2 per region (null where the source has none): expected =
    total_count of the first page (smallest offset), actual = records read.
    A page landed twice counts once, and as good if one of its copies is;
    pages without an offset count each. Broken pages add no records.
    ``complete`` follows the paging stop rule (actual >= expected); a total
    of 0 means an empty, complete result. Where the first page is broken
    the total is unknown: ``expected`` and ``complete`` are null if all
    other pages are good, and ``complete`` is false if any is broken."""
    return completeness_of(page_facts(pages))


def completeness_of(facts: DataFrame) -> DataFrame:
    """``completeness`` from the pages' facts."""
    once = (facts.groupBy("region", "offset", "_own")
            .agg(F.max("_n").cast("long").alias("_n"), F.max("total_count").alias("total_count")))
    return (once.groupBy("region")
            .agg(F.coalesce(F.min_by("total_count", "offset"), F.when(F.count("offset") == 0, F.max("total_count")))
                 .alias("expected"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("actual"),
                 F.count(F.lit(1)).alias("pages"),
                 F.count(F.when(F.col("_n").isNull(), 1)).cast("long").alias("bad_pages"))
            .withColumn("complete", F.when(F.col("bad_pages") > 0, F.lit(False))
                        .otherwise(F.col("actual") >= F.col("expected"))))


def readable_prefix(pages: DataFrame) -> DataFrame:
    """S3: what the paging loop would have kept: per region the pages before
    the first broken one; pages without a region form one source. A broken
    page whose offset cannot be recovered may have been the first, so
    nothing of its source is kept; a good page without an offset is kept
    only where no page is broken. The first-bad offsets are one row per
    region and join back as a small aggregate, not a per-page scan."""
    first_bad = (pages.filter(is_bad_page(pages)).groupBy(F.col("region").alias("_region"))
                 .agg(F.min(F.coalesce("offset", F.lit(0).cast("long"))).alias("_first_bad")))
    joined = pages.join(first_bad, F.col("region").eqNullSafe(F.col("_region")), "left")
    kept = joined.filter(F.col("_first_bad").isNull() | (F.col("offset") < F.col("_first_bad")))
    return kept.drop("_first_bad", "_region")


#: Partition columns of landed records.
REGION_PART, MONTH_PART = "_region", "_month"


def land_records(records: DataFrame, path: str, region_col: str, date_col: str, mode: str = "overwrite") -> None:
    """Land records by region and month of their date (``none`` without one),
    so that a window reads the folders it can touch and no others. Rows are
    dealt by both and a hash first: a folder gets few files, and a region that
    holds most rows still many writers."""
    month = F.coalesce(F.date_format(_as_time(records, date_col), "yyyy-MM"), F.lit("none"))
    parted = records.withColumns({REGION_PART: F.col(region_col), MONTH_PART: month})
    salt = F.pmod(F.xxhash64(*records.columns), F.lit(LANDING_SALTS))
    parted.repartition(REGION_PART, MONTH_PART, salt).write.mode(mode).partitionBy(REGION_PART, MONTH_PART).parquet(path)


#: Writers of one region and month.
LANDING_SALTS = 16


def _as_time(records: DataFrame, date_col: str):
    text = isinstance(records.schema[date_col].dataType, T.StringType)
    return F.try_to_timestamp(F.col(date_col)) if text else F.col(date_col)


def read_window(spark: SparkSession, path: str, region_col: str, date_col: str, region: str,
                as_of=None, days: int = 365) -> DataFrame:
    """P1 over landed records: the region and the months that the window
    touches select folders, the window itself rows."""
    from ..operators.predicates import window_bounds, window_filter

    lo, hi = (b[:7] for b in window_bounds(as_of, days))
    landed = spark.read.option("basePath", path).parquet(path)
    # Months are text: Spark's guess of a partition's type does not matter.
    month = F.col(MONTH_PART).cast("string")
    near = landed.filter((F.col(REGION_PART) == region) & (month >= lo) & (month <= hi))
    return window_filter(near, date_col, region_col, region, as_of, days).drop(REGION_PART, MONTH_PART)


def pack_pages(records: DataFrame, region_col: str, order_col: str,
               fields: list[str], page_size: int = schema.PAGE_SIZE) -> DataFrame:
    """Inverse of the source, used to land test data: records grouped into
    pages of ``page_size`` by ``order_col // page_size`` (a page holds at
    most ``page_size`` records, so no group is unbounded), with the
    region's record count as ``total_count``. Returns ``region, offset,
    value`` where value is the JSON envelope text."""
    page_no = F.floor(F.col(order_col) / page_size).cast("long")
    recs = records.select(F.col(region_col).alias("region"), page_no.alias("_page"),
                          F.struct(F.col(order_col).alias("_k"),
                                   F.struct(*fields).alias("rec")).alias("_e"))
    totals = recs.groupBy("region").agg(F.count(F.lit(1)).alias("total_count"))
    pages = (recs.groupBy("region", "_page")
             .agg(F.array_sort(F.collect_list("_e")).alias("_es"))
             .join(totals, "region")
             .select("region", (F.col("_page") * page_size).alias("offset"), "total_count",
                     F.transform("_es", lambda e: e["rec"]).alias("results")))
    return pages.select("region", "offset",
                        F.to_json(F.struct("region", "offset", "total_count", "results"),
                                  JSON_TIME_OPTIONS).alias("value"))
