import hashlib
import random

from capledger.llm.warc import chunked, dechunked, parse_record, read_archives, records, resolved, write_archives
from capledger.sources.scratch import scratch_path

import pytest

SCHEMA = "page_id long, url string, html string, digest string, record_type int"


def _rows():
    r = random.Random(5)
    long = "".join(r.choices("abc dé\r\n<p>", k=60_000))
    evil = ("WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 200) + "WARC/1.1"
    same = "s" * 1000
    return [
        (1, "http://a/1", "<p>short</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/WARC/1.1", evil), (5, "http://a/5\r\nX: y", long),
        (6, "u", same), (7, "u", same), (8, "u", same), (8, "u", same), (9, "u", "s" * 999), (10, "u", "s" * 999), (None, "u", same), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (11, "u", "0\r\n\r\n"),
    ]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, compression):
    rows = _rows()
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    path = scratch_path(spark, "warc-test")
    write_archives(pages, path, segment_bytes=4096, compression=compression)
    read = read_archives(spark, path)
    found = read.collect()
    assert all(r["fault"] is None for r in found) and len(found) == len(rows)
    payloads = sorted((str(r["row_id"]), bytes(r["payload"])) for r in found if r["record_type"] == "response")
    want = []
    for n, _, page in rows:
        if not (n in (6, 7) or (n is None and page == "s" * 1000)):
            want.append((str(n), (page or "").encode()))
    assert payloads == sorted(want)
    got = sorted((str(r["row_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["fault"]) for r in resolved(read).collect())
    expected = []
    for n, _, page in rows:
        raw = (page or "").encode()
        revisit = page == "s" * 1000 and n != 8
        expected.append((str(n), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 8 if revisit else None, None))
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(spark.createDataFrame([], SCHEMA), path)
    assert read_archives(spark, path).collect() == []


def test_faults_are_named(spark):
    path = scratch_path(spark, "warc-test")
    whole = records(1, 1, "u", b"x" * 5000, "d", None, 2048)
    parts = [b"WARC/1.1\r\n" + p for p in whole.split(b"WARC/1.1\r\n")[1:]]
    lost = records(2, 2, "u", b"x" * 5000, "d", None, 2048)
    other = [b"WARC/1.1\r\n" + p for p in lost.split(b"WARC/1.1\r\n")[1:]]
    short = records(3, 3, "u", b"abc", "d", None, 2048).replace(b"3\r\nabc", b"9\r\nabc")
    spark.createDataFrame([(bytes(parts[2] + parts[0] + other[1] + other[2] + parts[1] + short),)], "v binary").selectExpr("cast(v AS string) AS value").coalesce(1).write.text(path)
    got = {r["row_id"]: r["fault"] for r in read_archives(spark, path).collect()}
    assert got == {1: None, None: "the origin is missing", 3: "a chunk is cut off"}


def test_framing():
    for payload in (b"", b"a", b"WARC/1.1" * 9, b"\r\n" * 5000):
        framed = chunked(payload, 7)
        assert b"WARC/1.1" not in framed
        assert dechunked(framed) == payload
    assert dechunked(b"3;name=value\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert parse_record(b"WARC-Type: response\r\n\r\n")["fault"] == "no length"
