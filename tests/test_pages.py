"""S1-S3 (F1): landed pages, empty result, broken first / later page."""

import json
import os

from pyspark.sql import functions as F

from lectern.sources import pages as PG


def _land(dirpath, pages, broken=()):
    os.makedirs(dirpath, exist_ok=True)
    with open(os.path.join(dirpath, "pages.json"), "w") as f:
        for i, p in enumerate(pages):
            line = json.dumps(p, ensure_ascii=False)
            if i in broken:
                line = line[: len(line) // 2]
            f.write(line + "\n")


def _page(offset, total, n, region="Occitanie"):
    return {"region": region, "offset": offset, "total_count": total,
            "results": [{"uid": 10_000 + offset + i, "title_fr": f"e{offset + i}",
                         "keywords_fr": ["a", "b"] if i % 2 else "plain"} for i in range(n)]}


def test_two_pages_in_order(spark, tmp_path):
    _land(str(tmp_path), [_page(0, 3, 2), _page(100, 3, 1)])
    pages = PG.read_landed_pages(spark, str(tmp_path))
    rec = PG.explode_records(pages).orderBy("_ord").collect()
    assert [r.title_fr for r in rec] == ["e0", "e1", "e100"]
    assert rec[0].uid == "10000"          # numeric uid read as a string
    assert rec[1].keywords_fr == '["a", "b"]'   # raw JSON text kept as is
    c = PG.completeness(pages).first()
    assert (c.expected, c.actual, c.complete) == (3, 3, True)


def test_nothing(spark, tmp_path):
    _land(str(tmp_path), [{"region": "Occitanie", "offset": 0, "total_count": 0, "results": []}])
    pages = PG.read_landed_pages(spark, str(tmp_path))
    assert PG.explode_records(pages).count() == 0
    assert PG.completeness(pages).first().complete


def test_first_page_fails(spark, tmp_path):
    _land(str(tmp_path), [_page(0, 150, 100), _page(100, 150, 50)], broken={0})
    pages = PG.read_landed_pages(spark, str(tmp_path))
    assert PG.explode_records(PG.readable_prefix(pages)).count() == 0
    rej = PG.rejected_pages(pages).collect()
    assert [r.offset for r in rej] == [0]
    assert not PG.completeness(pages).first().complete


def test_later_page_fails(spark, tmp_path):
    _land(str(tmp_path), [_page(0, 250, 100), _page(100, 250, 100), _page(200, 250, 50)],
          broken={1})
    pages = PG.read_landed_pages(spark, str(tmp_path))
    kept = PG.explode_records(PG.readable_prefix(pages))
    assert kept.count() == 100
    c = PG.completeness(pages).first()
    assert (c.expected, c.actual, c.bad_pages, c.complete) == (250, 150, 1, False)


def test_one_file_per_page(spark, tmp_path):
    for off in (0, 100):
        p = _page(off, 4, 2)
        del p["offset"]
        with open(tmp_path / f"page_{off:06d}.json", "w") as f:
            json.dump(p, f, indent=2)
    pages = PG.read_landed_pages(spark, str(tmp_path), multi_line=True)
    rec = PG.explode_records(pages).orderBy("_ord").collect()
    assert [r._ord for r in rec] == [0, 1, 100, 101]


def _plain(offset, total, n):
    """The source's own envelope: no region, no offset."""
    p = _page(offset, total, n)
    return {"total_count": p["total_count"], "results": p["results"]}


def _land_files(path, pages, broken=()):
    for off, p in pages:
        text = json.dumps(p)
        with open(path / f"page_{off}.json", "w") as f:
            f.write(text[: len(text) // 2] if off in broken else text)


def test_plain_envelope_keeps_the_prefix(spark, tmp_path):
    _land_files(tmp_path, [(0, _plain(0, 250, 100)), (100, _plain(100, 250, 100)), (200, _plain(200, 250, 50))], broken={100})
    pages = PG.read_landed_pages(spark, str(tmp_path), multi_line=True)
    kept = PG.explode_records(PG.readable_prefix(pages))
    assert (kept.count(), kept.agg({"_ord": "max"}).first()[0]) == (100, 99)
    c = PG.completeness(pages).first()
    assert (c.region, c.expected, c.actual, c.bad_pages, c.complete) == (None, 250, 150, 1, False)


def test_broken_page_without_an_offset_keeps_nothing(spark, tmp_path):
    _land(str(tmp_path), [_plain(0, 150, 100), _plain(100, 150, 50)], broken={1})
    pages = PG.read_landed_pages(spark, str(tmp_path))
    assert PG.readable_prefix(pages).count() == 0
    _land(str(tmp_path / "whole"), [_plain(0, 150, 100), _plain(100, 150, 50)])
    whole = PG.read_landed_pages(spark, str(tmp_path / "whole"))
    assert PG.readable_prefix(whole).count() == 2
    assert PG.completeness(whole).first().complete


def test_page_landed_twice_counts_once(spark, tmp_path):
    _land(str(tmp_path), [_page(0, 200, 100), _page(0, 200, 100)])
    c = PG.completeness(PG.read_landed_pages(spark, str(tmp_path))).first()
    assert (c.expected, c.actual, c.pages, c.complete) == (200, 100, 1, False)


def test_broken_first_page_leaves_the_total_unknown(spark, tmp_path):
    _land(str(tmp_path), [_page(0, 150, 100), _page(100, 150, 50)], broken={0})
    c = PG.completeness(PG.read_landed_pages(spark, str(tmp_path))).first()
    assert (c.expected, c.actual, c.complete) == (None, 50, False)


def test_landed_records_are_pruned_by_region_and_month(spark, scratch):
    from lectern.operators.predicates import window_filter
    from lectern.sources import pages as PG
    rows = [(i, ["a", "b", None][i // 12 % 3], f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}" if i % 10 else ["soon", None][i % 20 == 0]) for i in range(720)]
    recs = spark.createDataFrame(rows, "id int, region string, day string")
    PG.land_records(recs, scratch, "region", "day")
    got = PG.read_window(spark, scratch, "region", "day", "a", as_of="2024-03-10", days=30)
    want = window_filter(recs, "day", "region", "a", "2024-03-10", 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 0 < got.count() < 100
    plan = got._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(_region" in text and "_month" in text.split("PartitionFilters", 1)[1].split("]")[0]
    # Three of the twelve months, one of the regions.
    read = {r[0].rsplit("/", 1)[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert len(read) == 3 and all("_region=a" in f for f in read)
    assert PG.read_window(spark, scratch, "region", "day", "no such", as_of="2024-03-10").count() == 0
