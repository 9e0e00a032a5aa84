"""Incremental ingestion of landed pages (S1-S3 on a file stream).

Pages keep landing in a folder (one JSON page per line or per file); a
file-source stream picks up new files, and each micro-batch explodes the
good pages into records and sets broken pages aside. Each batch writes
into its own ``batch_id=<n>`` folder with ``overwrite``, so a batch that is
replayed after a failure replaces its own output instead of duplicating
it; the checkpoint records which files were consumed. Beside the records each
batch keeps its pages' facts (offset, number of records or broken, total): the
state from which completeness (S2) and the readable prefix (S3) follow at any
time, also when pages come late, again, or good after they came broken. ``availableNow``
processes everything present and stops, which suits scheduled runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..sources import pages as PG


def read_page_stream(spark: SparkSession, landing_dir: str,
                     record_schema: T.StructType = schema.RECORD_SCHEMA,
                     multi_line: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming twin of ``pages.read_landed_pages``."""
    r = (spark.readStream.schema(PG.envelope_schema(record_schema))
         .option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", PG.CORRUPT)
         .option("multiLine", multi_line)
         .options(**PG.JSON_TIME_OPTIONS))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.json(landing_dir).withColumn("_file", F.input_file_name())
    return PG.normalise_pages(raw)


def ingest_pages_stream(spark: SparkSession, landing_dir: str, out_dir: str,
                        checkpoint_dir: str, record_schema: T.StructType = schema.RECORD_SCHEMA,
                        available_now: bool = True, **read_args):
    """Start the stream; returns the ``StreamingQuery``. Records go to
    ``<out_dir>/records/batch_id=<n>``, broken pages to
    ``<out_dir>/rejects/batch_id=<n>``, the facts of all pages to
    ``<out_dir>/facts/batch_id=<n>``. A page that lands twice in a batch gives
    its records once."""
    pages = read_page_stream(spark, landing_dir, record_schema, **read_args)
    out = out_dir.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int):
        batch = batch.persist()
        PG.page_facts(batch).write.mode("overwrite").parquet(f"{out}/facts/batch_id={batch_id}")
        PG.explode_records(_once(batch)).write.mode("overwrite").parquet(f"{out}/records/batch_id={batch_id}")
        PG.rejected_pages(batch).write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
        batch.unpersist()

    w = (pages.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _once(pages: DataFrame) -> DataFrame:
    """One of the good copies of each page; pages without an offset stay."""
    good = PG.good_pages(pages)
    named = good.filter("offset is not null").groupBy("region", "offset").agg(
        F.min_by(F.struct("total_count", "results", PG.CORRUPT), F.col("_file")).alias("p"), F.min("_file").alias("_file"))
    return named.select("region", "offset", "p.*", "_file").unionByName(good.filter("offset is null"))


def _facts(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir.rstrip('/')}/facts")


def landed_completeness(spark: SparkSession, out_dir: str) -> DataFrame:
    """S2 over all batches so far, as ``pages.completeness`` has it: a page
    counts once, and as good as soon as one of its copies is."""
    return PG.completeness_of(_facts(spark, out_dir))


def landed_records(spark: SparkSession, out_dir: str) -> DataFrame:
    """S3 over all batches so far: the records of each page once (from the
    first batch that had it good), per region up to the first page that is
    still broken. Facts are one row a page and are reduced before they meet
    the records."""
    pages = _facts(spark, out_dir).groupBy("region", "offset", "_own").agg(
        F.max("_n").alias("_n"), F.min(F.when(F.col("_n").isNotNull(), F.col("batch_id"))).alias("_from"))
    bad = (pages.filter("_n is null").groupBy(F.col("region").alias("_region"))
           .agg(F.min(F.coalesce("offset", F.lit(0).cast("long"))).alias("_first_bad")))
    kept = pages.filter("_n is not null").join(bad, F.col("region").eqNullSafe(F.col("_region")), "left") \
        .filter(F.col("_first_bad").isNull() | (F.col("offset") < F.col("_first_bad"))) \
        .select(F.col("region").alias("_r"), F.col("offset").alias("_o"), "_from").distinct()
    records = spark.read.parquet(f"{out_dir.rstrip('/')}/records")
    same = (F.col("region").eqNullSafe(F.col("_r")) & F.col("page_offset").eqNullSafe(F.col("_o")) & (F.col("batch_id") == F.col("_from")))
    return records.join(kept, same, "left_semi").drop("batch_id")
