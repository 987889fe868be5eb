import gzip
import hashlib

import pytest

from cauce.llm import warc
from cauce.llm.common import scratch_path

BIG = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
ROWS = [(1, "http://a/x", BIG), (5, "http://b/y", BIG), (3, None, BIG), (4, "http://c/\r\nX: y", "short"), (6, "u", "short"),
        (7, "http://d/", None), (8, "http://e/", ""), (9, "http://f", "z" * 999), (10, "http://f", "z" * 999),
        (11, "http://g", "z" * 1000), (12, "http://g", "z" * 1000), (13, "http://h", "lines\nof\r\ntext\n" * 100)]


def captures(spark, pages):
    path = warc.archive_pages(pages)
    found = warc.assemble(warc.read_records(spark, path))
    rows = found.select("*", warc.field("metadata", "page-id").alias("page_id"),
                        warc.field("original_metadata", "page-id").alias("original")).collect()
    return path, rows


def expected(rows):
    top = {}
    for page_id, _, html in rows:
        top[html or ""] = max(top.get(html or "", -1), page_id)
    out = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and top[html] != page_id
        out[page_id] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                        str(top[html]) if revisit else None)
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    _, rows = captures(spark, pages)
    assert len(rows) == len(ROWS)
    got = {int(r["page_id"]): (r["payload_bytes"], r["payload_sha1"], r["record_type"], r["original"]) for r in rows}
    assert got == expected(ROWS)
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in rows:
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        assert r["payload_digest_header"] == "sha1:" + r["payload_sha1"]
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[int(r["page_id"])]
    urls = {int(r["page_id"]): r["target_uri"] for r in rows}
    assert urls[3] is None and urls[1] == "http://a/x" and urls[4] == "http://c/%0D%0AX: y"


def test_hot_payload_ties_and_nulls(spark):
    rows = [(i % 50 if i % 7 else None, f"http://h/{i}", BIG) for i in range(400)] + [(None, "n", "q" * 2000)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    _, found = captures(spark, pages)
    assert len(found) == 402
    responses = [r for r in found if r["record_type"] == "response"]
    assert sorted(str(r["page_id"]) for r in responses) == ["49", "None"]
    assert {r["original"] for r in found if r["record_type"] == "revisit"} == {"49", None}


def test_empty_table_and_other_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, record_id string")
    path = scratch_path(spark, "warc")
    warc.write_archive(warc.plan_captures(pages), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


def record(kind, rid, block, *headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *headers, f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\n\r\nbody"


def test_foreign_archive(spark, tmp_path):
    """One gzip member per record, links in either direction, several captures, other record types."""
    parts = [record("warcinfo", "w", b"x"),
             record("response", "r1", HTTP, "Content-Type: application/http", "WARC-Concurrent-To: <q1>"),
             record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
             record("metadata", "m1", b"a: 1\r\nb: x: y\r\n", "Content-Type: application/warc-fields", "WARC-Concurrent-To: <q1>"),
             record("response", "r2", HTTP, "Content-Type: application/http"),
             record("metadata", "m2", b"a: 2\r\n", "Content-Type: application/warc-fields", "WARC-Concurrent-To: <r2>",
                    "WARC-Concurrent-To: <r1>"),
             record("revisit", "v", b"", "WARC-Refers-To: <r1>"), record("revisit", "lost", b"", "WARC-Refers-To: <none>")]
    (tmp_path / "part-a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:5]))
    (tmp_path / "part-b.warc").write_bytes(b"".join(parts[5:]))
    got = {r["record_id"]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r1>", "<r2>", "<v>", "<lost>"}
    assert [x["record_id"] for x in got["<r1>"]["requests"]] == ["<q1>"]
    assert [x["record_id"] for x in got["<r1>"]["metadata"]] == ["<m1>", "<m2>"]
    assert [x["record_id"] for x in got["<r2>"]["metadata"]] == ["<m2>"]
    assert got["<v>"]["payload_bytes"] == 4 and got["<v>"]["payload_sha1"] == hashlib.sha1(b"body").hexdigest()
    assert got["<lost>"]["payload_bytes"] is None


def test_damaged_archive_is_an_error():
    whole = record("response", "r", HTTP)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_records(whole[:-20], "f"))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_records(b"junk\r\n", "f"))


def test_archives_of_any_usual_name_are_read(spark, tmp_path):
    def record(i):
        block = f"HTTP/1.1 200 OK\r\n\r\npage {i}".encode()
        return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n"
                f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    # a gzip member per record, as crawlers write them; plain; and a file that is no archive
    (tmp_path / "CC-MAIN-0001.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(5)))
    (tmp_path / "crawl.warc").write_bytes(b"".join(record(i) for i in range(5, 8)))
    (tmp_path / "README.txt").write_text("no records")
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["payload"]).decode() for r in rows) == [f"page {i}" for i in range(8)]
