"""Scale properties of the physical plans, checked on static plans
(adaptive execution off): what a cluster starts from."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lectern.operators.dedup import dedup_first
from lectern.operators.knn import knn
from conftest import SF001


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_combines_before_its_only_shuffle(static):
    docs = static.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    plan = _plan(dedup_first(docs, "text", "doc_id"))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "partial_min" in plan.split("Exchange hashpartitioning")[1]
    assert "Window" not in plan


def test_knn_scores_ids_and_vectors_only(static):
    e = static.read.parquet(f"{SF001}/embeddings.parquet")
    qs = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    idx = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"),
                   F.col("label"))
    plan = _plan(knn(qs, idx, 3))
    scoring = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(scoring) == 1
    args = re.search(r"MapInArrow \w+\(([^)]*)\)", scoring[0]).group(1)
    assert sorted(a.split("#")[0].strip() for a in args.split(",")) == ["chunk_id", "vector"]
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("key", ["knn_top5", "search_display", "context_assembly", "eval_dataset",
                                 "metric_gate", "ingest_prefix", "chunk_documents", "index_complete",
                                 "answer_prompts", "evaluate_job"])
def test_no_pairwise_joins(static, key):
    plan = _plan(E.queries()[key](static, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDF
