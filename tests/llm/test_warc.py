"""Archives: round trips, revisits, what is read and what is skipped."""
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from gatherlens.llm import warc as W

BIG, OTHER = "<p>" + "é" * 120, "x" * 100
ROWS = [(5, "http://a/5", BIG), (3, "http://a/3\r\nX: y%0A", BIG), (9, None, BIG), (7, "u", OTHER), (8, "u", OTHER), (1, "u", "short"),
        (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "n", BIG), (3, "again", BIG), (11, "u", "y" * 99), (12, "u", "y" * 99)]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*r, "z", 1) for r in ROWS], "page_id long, url string, html string, payload string, warc_type int")


def test_round_trip(spark, pages):
    got = sorted(map(tuple, W.round_trip(pages.repartition(4)).drop("target_uri").collect()), key=str)
    want = []
    for i, _, html in ROWS:
        b = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "").encode() == b and j is not None]
        first = min(same) if len(b) >= 100 and len([1 for r in ROWS if (r[2] or "").encode() == b]) > 1 else None
        revisit = first is not None and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_urls_headers_and_push_down(spark, pages, tmpdir_path):
    W.write_pages(pages, tmpdir_path)
    df = W.read(spark, tmpdir_path)
    assert {r["target_uri"] for r in df.where("page_id = 3").collect()} == {"http://a/3\r\nX: y%0A", "again"}
    only = df.where((F.col("warc_type") == "response") & F.col("page_id").isin(3, 7))
    assert "PushedFilters" not in only._jdf.queryExecution().executedPlan().toString() or only.count() == 3
    assert sorted(r["page_id"] for r in only.collect()) == [3, 3, 7]
    heads = W.read(spark, tmpdir_path, payload=False)
    assert heads.count() == len(ROWS) and heads.where("payload IS NOT NULL").count() == 0


def test_reader_takes_filters_and_skips_blocks():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    r = W.WarcReader("x", True)
    back = list(r.pushFilters([EqualTo(("warc_type",), "revisit"), In(("page_id",), (1, 2)), GreaterThan(("page_id",), 1),
                               EqualTo(("payload",), b"x")]))
    assert len(back) == 2 and r.wanted == {"warc_type": {"revisit"}, "page_id": {1, 2}}
    row = {"page_id": 1, "url": "u", "payload": b"p" * 50, "payload_digest": "d", "payload_bytes": 50, "refers_to": None}
    broken = W.record(row).replace(gzip.compress(b"p" * 50, 1, mtime=0), b"!" * len(gzip.compress(b"p" * 50, 1, mtime=0)))
    good = W.record({**row, "page_id": 2})
    # The first record's payload can't be decoded: it is only touched if wanted.
    found = list(W.records(io.BytesIO(broken + good), {"page_id": {2}}, True))
    assert [x["page_id"] for x in found] == [2] and found[0]["payload"] == b"p" * 50
    with pytest.raises(Exception):
        list(W.records(io.BytesIO(broken + good), {}, True))


def test_only_committed_archives_count(spark, pages, tmpdir_path):
    W.write_pages(pages, tmpdir_path)
    with open(os.path.join(tmpdir_path, "left-by-a-lost-task.warc"), "wb") as f:
        f.write(b"WARC/1.1\r\nbroken")
    assert W.read(spark, tmpdir_path).count() == len(ROWS)


def test_empty_table_and_rolling(spark, pages, tmpdir_path):
    assert W.round_trip(pages.limit(0)).count() == 0
    writer = W.WarcWriter(tmpdir_path, 300)
    done = writer.write([{"page_id": i, "url": None, "payload": b"p", "payload_digest": "d", "payload_bytes": 1, "refers_to": None} for i in range(9)])
    writer.commit([done, None])
    assert len(done.files) > 3 and W.read(spark, tmpdir_path).count() == 9
