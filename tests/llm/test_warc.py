import hashlib
import io

import pytest
import zstandard
from rows import CLASHING

from lectern.llm import warc
from pyspark.sql import functions as F

BIG, OTHER = "<p>é" * 400, "<b>x" * 500
ROWS = [(1, "http://a", BIG), (7, "http://b", BIG), (3, None, BIG), (4, "http://c\r\nX: y", "small"), (5, "u", "small"),
        (6, "u", None), (8, "u", ""), (None, "u", BIG), (9, "u", OTHER), (9, "u", OTHER), (2, "u", OTHER),
        (10, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60), (11, "u", "z" * 3_000_000)]


def expected(rows):
    same = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            same[h] = max(i, same.get(h, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = same.get(h) if len(data) >= 1000 else None
        revisit = to is not None and to != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def table(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in (*CLASHING, "payload", "same", "sha1", "record_type", "first_id"):
        df = df.withColumn(c, F.lit("own"))
    return df.repartition(3)


def number(name):
    return int(name.removeprefix("urn:page:")) if name not in (None, "urn:page:") else None


def test_round_trip(spark, scratch):
    warc.write(table(spark, ROWS), scratch, "page_id", "url", "html")
    rows = warc.read(spark, scratch).collect()
    assert sorted(((number(r.record), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows), key=str) == expected(ROWS)
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(r.payload == html[number(r.record)] for r in rows if r.record_type == "response")
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_seek_by_index_and_plain_readers(spark, scratch, monkeypatch, tmp_path):
    warc.write(table(spark, ROWS).coalesce(1), scratch, "page_id", "url", "html")
    bundles = [r.bundle for r in spark.read.parquet(scratch).select("bundle").collect()]
    index = warc.index(spark, scratch).collect()
    assert len(index) == len(ROWS)
    (bundle,) = bundles
    assert len(warc.seek_table(bundle)) > 1            # the long record closed a frame
    for r in index:
        headers, _ = warc.read_record(bundle, r.frame, r.offset, r.length)
        assert headers["WARC-Record-ID"] == f"<{r.record}>"
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle), read_across_frames=True).read()
    assert len(list(warc.read_records(plain))) == len(ROWS)
    (file,) = warc.export(spark, scratch, str(tmp_path)).collect()
    assert open(file.file, "rb").read() == bundle


def test_damage_is_noticed():
    rec = warc.write_record(1, "u", b"abc", 3, hashlib.sha1(b"abd").hexdigest(), "response", None)
    (_, headers, block), = warc.read_records(rec)
    with pytest.raises(ValueError):
        warc._parsed(headers, block, True)


def test_empty_table(spark, scratch):
    warc.write(table(spark, ROWS).limit(0), scratch, "page_id", "url", "html")
    assert warc.read(spark, scratch).collect() == []
