"""Incremental landing: new files only, broken pages set aside."""

import json
import os

from lectern.streaming.landing import ingest_pages_stream
from test_pages import _page


def _write(path, name, pages, broken=()):
    with open(os.path.join(path, name), "w") as f:
        for i, p in enumerate(pages):
            line = json.dumps(p)
            f.write((line[: len(line) // 2] if i in broken else line) + "\n")


def test_two_runs_pick_up_new_files(spark, tmp_path, scratch):
    land = tmp_path / "landing"
    land.mkdir()
    out, ckpt = f"{scratch}/out", f"{scratch}/ckpt"
    _write(land, "a.json", [_page(0, 300, 100), _page(100, 300, 100)])
    ingest_pages_stream(spark, str(land), out, ckpt).awaitTermination(120)
    assert spark.read.parquet(f"{out}/records").count() == 200
    _write(land, "b.json", [_page(200, 300, 100), _page(300, 300, 5)], broken={1})
    ingest_pages_stream(spark, str(land), out, ckpt).awaitTermination(120)
    assert spark.read.parquet(f"{out}/records").count() == 300
    rej = spark.read.parquet(f"{out}/rejects").collect()
    assert [r.offset for r in rej] == [300]


def _run(spark, land, out, ckpt):
    ingest_pages_stream(spark, str(land), out, ckpt).awaitTermination(120)


def test_completeness_and_prefix_follow_late_broken_and_repeated_pages(spark, tmp_path, scratch):
    from lectern.streaming.landing import landed_completeness, landed_records
    land = tmp_path / "landing"
    land.mkdir()
    out, ckpt = f"{scratch}/out", f"{scratch}/ckpt"
    pages = [_page(o, 350, 100 if o < 300 else 50) for o in (0, 100, 200, 300)]

    def state():
        (r,) = landed_completeness(spark, out).collect()
        rows = landed_records(spark, out).collect()
        assert len({(r.page_offset, r.pos) for r in rows}) == len(rows)
        return (r.expected, r.actual, r.pages, r.bad_pages, r.complete), sorted({x.page_offset for x in rows}), len(rows)

    _write(land, "a.json", [pages[0], pages[1], pages[0]], broken={1})
    _run(spark, land, out, ckpt)
    assert state() == ((350, 100, 2, 1, False), [0], 100)
    _write(land, "b.json", [pages[2], pages[3], pages[0]])                 # later pages first, one again
    _run(spark, land, out, ckpt)
    assert state() == ((350, 250, 4, 1, False), [0], 100)
    _write(land, "c.json", [pages[1]])                                     # the broken one comes good
    _run(spark, land, out, ckpt)
    assert state() == ((350, 350, 4, 0, True), [0, 100, 200, 300], 350)
    _write(land, "d.json", [pages[2]], broken={0})                         # and a good one comes again, broken
    _run(spark, land, out, ckpt)
    assert state() == ((350, 350, 4, 0, True), [0, 100, 200, 300], 350)
