"""Archives written and read back, byte for byte."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from voxmill.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, offset long"
BIG, SAME = "<p>" + "x" * 70_000 + "é</p>", "<p>" + "same " * 300 + "</p>"
PAGES = [(1, "http://a/1", "<p>short</p>"), (2, "http://a/\r\nX: y", SAME), (3, None, SAME), (4, "http://a/4", SAME), (5, "http://a/5", None),
         (6, "http://a/6", ""), (7, "http://a/7", BIG), (8, "http://a/8", "<p>short</p>"), (4, "http://a/4", SAME), (None, "http://a/n", SAME),
         (None, "http://a/m", "y" * 2000), (None, "http://a/o", "y" * 2000), (9, "http://a/9", "z" * 999 + "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", "é" * 500), (11, "u", "é" * 500)]


@pytest.fixture(scope="module")
def index(spark):
    pages = spark.createDataFrame([(*p, "clash", -1) for p in PAGES], SCHEMA).repartition(3)
    return warc.write_archives(pages, file_bytes=3000).cache()


def test_records_come_back(index):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        top = max(same) if len(b) >= 1000 and same else None
        r = top if top is not None and i != top else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if r is not None else "response", r))
    assert got == sorted(want, key=str)


def test_each_record_is_a_gzip_member_where_the_index_says(index):
    for r in index.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            z = zlib.decompressobj(31)
            data = z.decompress(f.read(r.length))
        assert z.eof and not z.unused_data and data.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and data.endswith(b"\r\n\r\n")
        assert b"\r\nX: y" not in data and f"sha1:{r.digest}".encode() in data
    assert index.select("file").distinct().count() > 1


def test_chosen_records_with_gaps(index):
    chosen = index.filter(F.col("page_id").isin(1, 7, 9))
    for gap, most in ((0, 1), (1 << 20, 1 << 30)):
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(chosen, gap, most).collect()}
        assert got == {1: "<p>short</p>", 7: BIG, 9: PAGES[12][2]}


def test_no_pages(spark):
    index = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and warc.read_records(index).count() == 0


def test_a_damaged_record_is_an_error(spark, index):
    with pytest.raises(Exception):
        warc.read_records(index.withColumn("offset", F.col("offset") + 3)).count()
