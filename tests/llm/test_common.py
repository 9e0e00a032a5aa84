import pyarrow as pa
import pytest

from lectern.llm import common as C


def test_slices_are_bounded_by_bytes_and_rows(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 100)
    monkeypatch.setattr(C, "SLICE_ROWS", 7)
    texts = ["a" * 30] * 5 + ["é" * 300] + [None, ""] * 12 + ["b" * 99, "cc"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    parts = [p.column("text").to_pylist() for p in C.slices(batch)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 7 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100) for p in parts)
    assert [p.column("text").to_pylist() for p in C.slices(batch.slice(3, 4))] == [texts[3:5], texts[5:6], texts[6:7]]
    assert list(C.slices(batch.slice(0, 0))) == []


@pytest.mark.parametrize("given, kept", [("64m", False), ("67108864b", False), ("1048576", True), ("4m", True), ("512k", True), ("1g", False)])
def test_small_batches_only_make_them_smaller(spark, given, kept):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, given)
    try:
        C.small_batches(spark)
        assert spark.conf.get(key) == (given if kept else str(C.BATCH_BYTES))
    finally:
        spark.conf.unset(key)
