"""Shared fixtures: a documents table with every awkward case."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use inside; none may clash with a caller's column.
CLASHING = ("id", "row", "key", "v", "n", "node", "spans", "score", "rank", "hash", "words", "found", "ids", "label", "root", "size")


def documents(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or [f"src{i % 3}" for i in range(len(texts))]
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
