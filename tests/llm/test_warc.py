"""Archives: round trips, assembly of scattered records, edges."""

import base64
import gzip
import hashlib

import pytest
from oracle import compare

from tallyglass.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, key string"


def expected(rows):
    """Brute force over (page_id, url, html)."""
    rows = sorted(((i, u, h or "") for i, u, h in rows), key=str)
    out = []
    for i, u, h in rows:
        last = max((j for j, _, k in rows if k == h and j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((i, len(h.encode()), digest, "response" if i == last else "revisit", None if i == last else last))
    return sorted(out, key=str)


def test_equals_sql(spark, duck, table):
    assert compare(warc.round_trip(table("pages")), duck, warc.SQL) is None


def test_edges(spark):
    long = "\u00e9\r\n\r\nWARC/1.1\r\n" * 50_000
    pages = [(1, "u", "a"), (2, None, "a"), (3, "x\r\ny: z", None), (4, "u", ""), (5, "u", long), (6, "u", long), (7, "u", "b"), (7, "u", "b")]
    got = warc.round_trip(spark.createDataFrame([(*p, "x", "y") for p in pages], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids(spark):
    got = warc.round_trip(spark.createDataFrame([(None, "u", "a", "", ""), (3, "u", "a", "", "")], SCHEMA)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 3), (3, "response", None)]


def test_small_payloads_can_be_kept(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "bb"), (4, "u", "bb")], "page_id long, url string, html string")
    warc.write_captures(pages, f"{tmp_path}/a", min_revisit_bytes=2)
    assert sorted((r.capture_id, r.record_type) for r in warc.captures(spark, f"{tmp_path}/a").collect()) == [
        ("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def record(kind, name, block=b"", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"Content-Length: {len(block)}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items())]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_scattered_records_are_assembled(spark, tmp_path):
    http = {"Content_Type": "application/http;msgtype=response"}
    first = [
        record("warcinfo", "info"),
        record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nhello", **http),
        record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\nworld", WARC_Concurrent_To="<q2>", **http),
        record("request", "q3"),
    ]
    second = [
        record("metadata", "m1", b"captureId: 1\r\n", WARC_Concurrent_To="<q1>"),
        record("request", "q1", WARC_Concurrent_To="<r1>"),
        record("request", "q2"),
        record("metadata", "m2", b"captureId: 2\r\n", WARC_Concurrent_To="<q2>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, first)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(second)))
    rows = {r.record_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path), payload=True)).collect()}
    assert set(rows) == {"<r1>", "<r2>", "<q3>"}
    for n, body in (("1", b"hello"), ("2", b"world")):
        r = rows[f"<r{n}>"]
        assert (bytes(r.response.payload), r.request.record_id, r.metadata.capture_id) == (body, f"<q{n}>", n)
        assert (r.n_requests, r.n_metadata) == (1, 1)
    assert rows["<q3>"].response is None


def test_truncated_archives_raise(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("response", "r", b"x" * 100)[:-20]))
    with pytest.raises(Exception, match="ends within"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_repeated_rows_come_back_as_often(spark):
    pages = [(7, "u", "b")] * 3 + [(8, "u", "b")] * 2 + [(None, None, None)] * 2 + [(5, "v", "c")] + [(2, "w", "b")] * 4
    got = warc.round_trip(spark.createDataFrame([(*p, "", "") for p in pages], SCHEMA)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted(
        [(7, "revisit", 8)] * 3 + [(8, "response", None)] * 2 + [(0, "response", None)] * 2 + [(5, "response", None)] + [(2, "revisit", 8)] * 4, key=lambda r: (r[0], r[1])
    )


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    pages = spark.createDataFrame([(i, "u", f"{i}" + "x" * 100_000) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_captures(pages, f"{tmp_path}/a")
    assert len(list((tmp_path / "a").glob("*.gz"))) >= 6
    assert warc.captures(spark, f"{tmp_path}/a").count() == 60
