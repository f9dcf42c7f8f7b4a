"""Archives that other writers made: long headers, both versions, compressed members, damage."""

import gzip
import hashlib

import pytest

from terrane.llm import warc


def record(i, body, version="1.1", url="u", length=None):
    head = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


BODIES = [b"", b"x" * 10, b"WARC/1.0\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3, "é\r\n\r\nWARC/1.".encode(), b"WARC/1.9\r\n\r\n\r\n"]


@pytest.mark.parametrize("split", ["128m", "3000"])
def test_long_headers_versions_and_members(spark, tmp_path, split):
    records = [record(i, BODIES[i % len(BODIES)], "1.0" if i % 3 else "1.1", "u" * {7: 70_000, 13: 2_000_000}.get(i, 5)) for i in range(30)]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:20]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[20:])))  # a member for each record
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_archives(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((int(r.record_id[10:-1]), r.sha1, r.payload_bytes) for r in got) == [(i, hashlib.sha1(BODIES[i % len(BODIES)]).hexdigest(), len(BODIES[i % len(BODIES)])) for i in range(30)]
    assert all(r.intact and not r.broken for r in got) and {len(r.uri) for r in got} == {5, 70_000, 2_000_000}


def test_a_damaged_length_is_told(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(record(i, b"body", length=9 if i == 2 else None) for i in range(5)))
    (tmp_path / "b.warc").write_bytes(record(7, b"body") + record(8, b"body", length="nine"))
    (tmp_path / "c.warc").write_bytes(record(9, b"body")[:-6])
    got = {int(r.record_id[10:-1]): r.broken for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {0: False, 1: False, 2: True, 7: False, 8: True, 9: True}


def test_long_urls_of_pages(spark, tmp_path):
    rows = [(i, "u" * (70_000 if i == 5 else 3_000_000 if i == 6 else 4), "<p>" * i) for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op4_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, 3 * i) for i in range(40)]


def test_rounds_keep_the_plans_size(spark):
    """A long chain takes many rounds; the estimated size of what they give stays that of a table."""
    chain = spark.range(60).selectExpr("'a' as file", "id * 10 as off", "case when id <> 40 then id * 10 + 10 end as next")
    found = warc.reachable(chain)
    assert found.count() == 41
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
