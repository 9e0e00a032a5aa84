"""The training-data pipeline over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before it kept; what it returns is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of
``documents``:

* toxicity: documents that score ``TOXIC_FROM`` or more go;
* near_dedup: one row of each group of near copies stays (the lowest id's
  first row, one without an id only where none has one; five-word shingles,
  similarity 0.8); rows without words are copies where they share id and text;
* decontaminate: documents that hold a benchmark window go;
* secrets: values that only one owner holds, or too few to be a copied
  example, are replaced by a mark in the text; ``n_chars`` follows;
* bpe: the texts as token ids, with the columns ``doc_id, lang, source,
  n_tokens, ids`` (packed little-endian unsigned 32-bit) and the digest of the
  decoded bytes.

Null texts count as empty and stay. Documents that share an id but not a text are told apart
by no stage but the dedup, which judges each row by its own text. Other columns
than those of ``documents`` are not carried. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, neardup, secrets, toxicity
from lectern.llm import queries as Q
from lectern.llm.common import read, scratch_dropped, small_batches, stored

#: Row numbers that are broadcast at once, at most (some 64 MB).
SENT_ROWS = 2_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = Q.toxicity_model(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), model, keep_text=True)
    return scored.filter(F.col("score") < Q.TOXIC_FROM).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # Rows have numbers of their own: ids may repeat, with other texts, or lack.
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    with scratch_dropped(spark) as keep:
        classes = keep(neardup.near_duplicates(rows, "row", "text").select(
            F.col("id").alias("row"), F.col("component_id").alias("copies"), "n_shingles"), "dedup-classes")
    worded = rows.select("row", "doc_id").join(classes.filter("n_shingles > 0").select("row", "copies"), "row")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    best = worded.groupBy("copies").agg(F.min(first).alias("best")).select(F.col("best.row").alias("row"))
    wordless = rows.filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    single = wordless.groupBy("doc_id", "text").agg(F.min("row").alias("row")).select("row")
    # Texts stay where they are: only row numbers are shuffled, and those of
    # the rows that go are sent to all tasks where their number allows.
    gone = stored(rows.select("row").join(best.unionByName(single), "row", "left_anti"), "dedup-gone")
    gone = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    own = F.struct(*(c for c in COLUMNS if c != "text"), F.col("text").isNull().alias("no_text"))
    found = Q.decontaminate.find_leaks(docs.select(own.alias("own"), "text"), read(spark, sf_dir, "benchmark"),
                                       "own", "text", "item_id", "text", keep_text=True)
    text = F.when(~F.col("id.no_text"), F.col("text")).alias("text")
    return found.filter(F.size("spans") == 0).select(*(text if c == "text" else F.col(f"id.{c}") for c in COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, "text", "doc_id", "source", list(COLUMNS))
    example = secrets.KINDS.index("example")
    copied = F.filter("spans", lambda s: s["kind"] == example)
    hide = F.filter("base", lambda s: ~F.exists(copied, lambda c: (c["first"] == s["first"]) & (c["last"] == s["last"])))
    text = secrets.redacted(F.col("keep.text"), hide)
    changed = F.size(hide) > 0
    return found.select(
        "keep.doc_id", text.alias("text"), "keep.lang", "keep.source",
        F.when(changed, F.length(text).cast("long")).otherwise(F.col("keep.n_chars")).alias("n_chars"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ranks, pattern = Q.bpe_ranks()
    keyed = docs.select(F.struct("doc_id", "lang", "source").alias("own"), "text")
    # Stored between the two, so that a task holds one Python worker, not two.
    ids = stored(bpe.encode(keyed, ranks, pattern, "own", "text"), "pipeline-ids")
    return bpe.decode(ids, ranks).select("id.doc_id", "id.lang", "id.source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot say the trained classifier's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
