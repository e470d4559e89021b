import base64
import gzip
import hashlib

import pytest

from lakesteward.llm.warc import (
    archived_pages, chunked, http_payload, join_segments, page_records, parse_records, read_payloads, unchunked, write_archives,
)

PAGE = "page_id BIGINT, url STRING, html STRING, block STRING, digest INT"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_chunked_framing_round_trip():
    for payload in (b"", b"x", b"0\r\n\r\n", bytes(range(256)) * 100):
        assert unchunked(chunked(payload, 7)) == payload
    assert unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    assert http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_segments_must_be_complete():
    assert join_segments([(1, None, b"ab"), (2, 3, b"c")]) == b"abc"
    for parts in ([(1, None, b"ab"), (3, 3, b"c")], [(1, None, b"ab"), (2, 4, b"c")], [(1, None, b"a"), (1, 2, b"b")]):
        with pytest.raises(ValueError):
            join_segments(parts)


def test_records_with_tricky_payloads_parse():
    payload = "WARC/1.1\r\n\r\n\r\nWARC-Type: response\r\n" * 50
    records = list(page_records(5, "http://a/ b", payload.encode(), "D", None, "s", 300))
    stream = b"".join(r + b"\r\n\r\n" for r in records)
    found = list(parse_records(iter([stream[i : i + 11] for i in range(0, len(stream), 11)])))
    assert len(found) == len(records) > 5
    assert {h["warc-type"] for h, _ in found[1:]} == {"continuation"}
    assert http_payload(b"".join(b for _, b in found)) == payload.encode()


def test_pages_round_trip(spark):
    long = "<p>\r\n\r\nWARC/1.1\r\n</p>é" * 3000
    rows = [(1, "u", "x"), (2, "u", "x"), (3, None, "x"), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "u", long), (None, "u", "y"), (8, "u", "z"), (8, "u", "z")]
    pages = spark.createDataFrame([(*r, "b", 1) for r in rows], PAGE)
    found = sorted(map(tuple, archived_pages(spark, pages).collect()), key=str)
    expected = []
    for page_id, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        leader = max(same) if same else None
        kind = "response" if page_id == leader else "revisit"
        expected.append((page_id, len((html or "").encode()), digest(html or ""), kind, None if page_id == leader else leader))
    assert found == sorted(expected, key=str)
    assert archived_pages(spark, pages.limit(0)).collect() == []


def test_small_segments_and_many_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " * (40 * i)) for i in range(60)], "page_id BIGINT, url STRING, html STRING")
    path = str(tmp_path / "archive")
    write_archives(pages, path, segment_bytes=200, archive_records=50)
    assert len(list((tmp_path / "archive").glob("part-*.gz"))) > 10
    with gzip.open(next((tmp_path / "archive").glob("part-*.gz"))) as f:
        assert f.read(8) == b"WARC/1.1"
    found = {r["page_id"]: r for r in read_payloads(spark, path).collect()}
    for i in range(60):
        assert found[i]["payload_digest"] == digest(f"{i} " * (40 * i)) == found[i]["digest"]
