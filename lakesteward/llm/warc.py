"""WARC archives with segmented records: writing, reading back, reassembly and payload digests.

A page becomes an HTTP response in chunked transfer framing. A record whose block is longer than
``segment_bytes`` is cut: its first part keeps the type and the headers, and each ``continuation``
record carries the origin's identifier, its number, and, in the last one, the total length.
Archives are gzip files of a bounded number of records, written by Spark's text sink with the record
end as line separator, and read as whole files, each as a stream of records.

Reassembly: records without segments are complete; the others are dealt by origin identifier, each
task sorts them by origin and number and streams through them, holding one record's text at a time.
A gap, a repeated number or a total that differs from the parts' lengths is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesteward.llm.common import saved, workspace

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: with segments of bounded size, this bounds an archive
ARCHIVE_RECORDS = 4096
RECORD_END = "\r\n\r\n"

RECORDS = (
    "record_id STRING, type STRING, target_uri STRING, refers_to STRING, digest STRING, page_id BIGINT, "
    "origin STRING, segment INT, total BIGINT, block BINARY"
)
PAYLOADS = (
    "page_id BIGINT, record_id STRING, record_type STRING, refers_to_id STRING, target_uri STRING, "
    "payload_bytes BIGINT, payload_digest STRING, digest STRING"
)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are passed over, anything else is an error."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter or longer than it says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP block without the end of its headers")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_text(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers if v is not None)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block])


def page_records(page_id, url, html: bytes, digest: str, refers_to, serial: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without their ends."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, serial)}>"
    uri = "".join((url or "").split()) or None
    head = [("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield record_text([*more, *head, ("X-Refers-To-Page", refers_to)], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    if len(block) <= segment_bytes:
        yield record_text([("WARC-Type", "response"), *head], block)
        return
    last = -(-len(block) // segment_bytes)
    for n in range(1, last + 1):
        piece = block[(n - 1) * segment_bytes : n * segment_bytes]
        if n == 1:
            yield record_text([("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1)], piece)
            continue
        part = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{serial}/{n}')}>"
        total = len(block) if n == last else None
        yield record_text(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", part), ("WARC-Segment-Origin-ID", own),
             ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)],
            piece,
        )


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write ``pages`` (page_id, url, html) as gzip WARC files below ``path``.

    Of pages with equal payloads, empty ones included, those with the largest page_id are written as
    responses and the others as revisits of it; a null page_id is smaller than any.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("html")))
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("leader"))
    # the big side is the left one, which a skewed join can split; it is the only time that html is shuffled
    chosen = rows.join(largest, "sha1", "left")
    chosen = chosen.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, body, sha, refers_to in zip(
                *(batch[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True
            ):
                n += 1
                out += page_records(page_id, url, body, base64.b32encode(sha).decode(), refers_to, f"{path}/{task}/{n}", segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = chosen.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(build, "value BINARY")
    writer = records.select(F.col("value").cast("string")).write.option("lineSep", RECORD_END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", archive_records).text(path)


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        machine, at = zlib.decompressobj(31), 0
        while at < len(content) and not machine.eof:
            piece = machine.decompress(content[at : at + step])
            at += step
            if piece:
                yield piece
        content = machine.unused_data + content[at:] if machine.eof else b""


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record of a stream."""
    held, more = bytearray(), True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            piece = next(pieces, None)
            more = piece is not None
            held.extend(piece or b"")
        return len(held) >= n

    while True:
        while fill(1) and held[:1] in b"\r\n":
            del held[:1]
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("an archive ends within a record's headers")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, size = end + 4, int(headers["content-length"])
        if not fill(begin + size):
            raise ValueError("an archive ends within a record's block")
        yield headers, bytes(held[begin : begin + size])
        del held[: begin + size]


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, continuation records as they are."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for h, block in parse_records(_inflated(content.as_py())):
                    get = h.get
                    rows.append((
                        get("warc-record-id"), get("warc-type"), get("warc-target-uri"), get("x-refers-to-page"),
                        (get("warc-payload-digest") or "").removeprefix("sha1:") or None, _number(get("x-page-id")),
                        get("warc-segment-origin-id"), _number(get("warc-segment-number")), _number(get("warc-segment-total-length")), block,
                    ))
                    held += len(block)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORDS)


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """One block out of its segments (number, total length or null, bytes), in order of number."""
    numbers = [n for n, _, _ in parts]
    if numbers != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments {numbers} do not count from 1 without gaps")
    block = b"".join(x for _, _, x in parts)
    if parts[-1][1] != len(block) or any(t is not None for _, t, _ in parts[:-1]):
        raise ValueError(f"the segments hold {len(block)} bytes, the last one says {parts[-1][1]}")
    return block


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per reassembled record: page_id, type, length and digest of the decoded payload.

    A revisit has no payload of its own; its length is null and its digest the one in its headers.
    """

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, int, int | None, bytes]] = []
        names = [c.split()[0] for c in PAYLOADS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def finished(first: dict, block: bytes) -> tuple:
            kept = first["page_id"], first["record_id"], first["type"], first["refers_to"], first["target_uri"]
            if first["type"] == "revisit":
                return (*kept, None, first["digest"], first["digest"])
            payload = http_payload(block)
            return (*kept, len(payload), base32_digest(payload), first["digest"])

        def closed() -> tuple:
            if held[0][0]["type"] == "continuation":
                raise ValueError(f"the first segment of {held[0][0]['origin']} is missing")
            return finished(held[0][0], join_segments([x[1:] for x in held]))

        for batch in batches:
            rows = []
            columns = [batch[c].to_pylist() for c in batch.schema.names]
            for values in zip(*columns, strict=True):
                r = dict(zip(batch.schema.names, values, strict=True))
                block = r.pop("block")
                if r["segment"] is None:
                    rows.append(finished(r, block))
                    continue
                if held and held[0][0]["whole"] != r["whole"]:
                    rows.append(closed())
                    held.clear()
                held.append((r, r["segment"], r["total"], block))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if held:
            x = closed()
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], names)

    records = read_records(spark, path).withColumn("whole", F.coalesce("origin", "record_id"))
    complete = records.filter("segment IS NULL").mapInArrow(payloads, PAYLOADS)
    parts = records.filter("segment IS NOT NULL").repartition("whole").sortWithinPartitions("whole", "segment")
    return complete.unionByName(parts.mapInArrow(payloads, PAYLOADS))


def archived_pages(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload;
    pages that share the largest page_id and the payload are all responses; a null or unusual url is
    kept without its blanks; other columns are ignored; an empty table gives no rows. A response whose
    payload does not have the digest that its headers state is an error.
    """
    path = path or workspace(spark, "warc")
    write_archives(pages, path)
    found = saved(read_payloads(spark, path), "warc-payloads")
    broken = found.filter("record_type = 'response' AND payload_digest <> digest").select("page_id").take(1)
    if broken:
        raise ValueError(f"page {broken[0][0]}: the payload does not have the stated digest")
    lengths = found.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("bytes"))
    joined = found.join(lengths, "payload_digest", "left")
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to_id").cast("bigint").alias("refers_to"),
    )
