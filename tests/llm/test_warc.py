from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from flowloom.llm import warc
from flowloom.llm.warc import payload_records, read_warc, write_warc
from flowloom.session import shared_dir


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "u\r\nX: y", "a" * 3_000_000),
        (2, None, "b"),
        (3, "http://é", "a" * 3_000_000),
        (None, "x", None),
        (5, "y", ""),
        (5, "y", ""),
        (7, "z", "\r\n\r\n" * 10),
        (8, "z", "\r\n\r\n" * 10),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_round_trip(spark, pages):
    folder = shared_dir(spark, "warc")
    write_warc(payload_records(pages), folder)
    rows = read_warc(spark, folder).collect()
    last = sorted(
        (r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)
        for r in rows
        if r.last
    )
    a, none, feeds = digest(b"a" * 3_000_000), digest(b""), digest(b"\r\n" * 20)
    assert last == [
        ("urn:record:", "revisit", "urn:record:5", 0, none),
        ("urn:record:1", "response", None, 3_000_000, a),
        ("urn:record:2", "response", None, 1, digest(b"b")),
        ("urn:record:3", "revisit", "urn:record:1", 3_000_000, a),
        ("urn:record:5", "response", None, 0, none),
        ("urn:record:5", "response", None, 0, none),
        ("urn:record:7", "response", None, 40, feeds),
        ("urn:record:8", "revisit", "urn:record:7", 40, feeds),
    ]
    assert all(r.payload_digest == r.stated_digest for r in rows if r.last)
    chunks = sorted((r.chunk_no, r) for r in rows if r.record_id == "urn:record:1")
    data = b""
    for _, row in chunks:
        assert len(row.data) <= warc.CHUNK
        data += bytes(row.data)
        assert (row.payload_bytes, row.payload_digest) == (len(data), digest(data))
    assert len(chunks) > 2 and data == b"a" * 3_000_000


def test_archives_are_plain_warc(spark, pages):
    folder = shared_dir(spark, "warc")
    write_warc(payload_records(pages.filter("page_id = 2")), folder)
    file = spark.read.parquet(f"{folder}/manifest").first().file
    with gzip.open(f"{folder.removeprefix('file:')}/{file}") as archive:
        text = archive.read()
    head, http, body = text.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert b"Content-Length: %d" % (len(http) + 4 + 1) in head
    assert body == b"b\r\n\r\n"


def test_small_payloads_are_no_revisits(pages):
    rows = payload_records(pages, least_bytes=41).collect()
    assert {r.key for r in rows if r.record_type == "revisit"} == {3}


def test_archives_are_cut_by_size(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 1)
    folder = shared_dir(spark, "warc")
    write_warc(payload_records(pages.coalesce(1)), folder)
    assert spark.read.parquet(f"{folder}/manifest").filter("records > 0").count() == 8
    assert read_warc(spark, folder).filter("last").count() == 8


def test_empty_table(spark, pages):
    folder = shared_dir(spark, "warc")
    write_warc(payload_records(pages.limit(0)), folder)
    assert read_warc(spark, folder).count() == 0
