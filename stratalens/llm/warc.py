"""WARC archives: writing with revisits and segments, and reading with reassembly.

Blocks above ``segment_bytes`` are split: the first segment keeps the record's type, the others are
``continuation`` records that name the first by ``WARC-Segment-Origin-ID``, and the last one states the
total length.  Reading groups segments by origin, orders them by number, checks that none is missing
and that the total length is right, and then undoes the chunked transfer framing of the HTTP message.

Files are written by Spark's text sink with CR LF CR LF as record end, which is the WARC record end, so
the job's commit protocol and any Hadoop file system work, and gzip is the sink's own option.  No record
is larger than a segment with its head, so a file's records also bound its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialise, new_path, ship_package

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = re.compile(r"<urn:page:([^#>]*)(?:#([^>]*))?>")


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Undo chunked framing; extensions and trailers are skipped, a broken frame is a ValueError."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk without size")
        size = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response message, transfer framing removed."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP head without end")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head) else body


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", "WARC-Date: 2024-01-01T00:00:00Z", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def record_name(page_id: int | None, uid: int | None) -> str:
    """The record's identifier; ``uid`` tells rows that share a page_id apart."""
    return f"<urn:page:{'' if page_id is None else page_id}{'' if uid is None else f'#{uid}'}>"


def page_records(page_id: int | None, uid: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The record of one page, or its segments; records end where the sink adds CR LF CR LF."""
    name = record_name(page_id, uid)
    about = [("WARC-Target-URI", re.sub(r"\s", "", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        more = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers_to), ("X-Payload-Length", str(len(payload)))]
        yield _record("revisit", name, about + more, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record("response", name, about, block)
        return
    last = (len(block) - 1) // segment_bytes
    for i in range(last + 1):
        part = block[i * segment_bytes : (i + 1) * segment_bytes]
        if i == 0:
            yield _record("response", name, [*about, ("WARC-Segment-Number", "1")], part)
        else:
            total = [("WARC-Segment-Total-Length", str(len(block)))] if i == last else []
            own = f"{name[:-1]}{'#' if uid is None else ''}.{i + 1}>"
            yield _record("continuation", own, [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i + 1)), *total], part)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = 16_384) -> None:
    """A record per row of ``pages`` (page_id, url, html; null html: empty payload) in gzip WARC files.

    Of rows with equal payloads of ``min_revisit_bytes`` or more, that of the least page_id is the
    response and the others revisit it.  Only digests with copies take part in the look-up, so that a
    digest shared by a large part of the rows is split by adaptive skew joins.  Records are named by
    page_id, with a number where page_ids are null or repeat; such a table is written once with its numbers.
    """
    ship_package(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    named = p.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 or page_id is null").isEmpty()
    p = p.withColumn("uid", F.lit(None).cast("long")) if named else materialise(p.withColumn("uid", F.monotonically_increasing_id()), "pages")
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    first = F.min_by("uid", F.struct(F.col("page_id").isNull(), "page_id", "uid")).alias("first_uid")
    copies = p.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), first, F.count("*").alias("n")).where("n > 1").drop("n")
    rows = p.join(materialise(copies, "copies"), ["digest", "size"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for page, uid, url, html, digest, first, first_uid in zip(*(b.column(c).to_pylist() for c in ("page_id", "uid", "url", "html", "digest", "first_id", "first_uid")), strict=True):
                payload = html.encode()
                mark = base64.b32encode(bytes.fromhex(digest)).decode()
                refers_to = None if first is None or first == page else record_name(first, first_uid)
                out += page_records(page, uid, url, payload, mark, refers_to, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = rows.select("page_id", "uid", "url", "html", "digest", "first_id", "first_uid").mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 4000).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:head].decode().split("\r\n")[1:])}
        end = head + 4 + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield fields, data[head + 4 : end]
        at = end + 4


def inflate(data: bytes) -> bytes:
    """Gzip members in a row, or plain bytes."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out) + data


def reassemble(segments: Iterable[tuple[int, bytes, int | None]]) -> bytes:
    """The block of (number, bytes, total length or None) segments in any order; repeats must agree.

    Missing numbers, no stated total or a wrong one is a ValueError.
    """
    by: dict[int, bytes] = {}
    total = None
    for number, part, stated in segments:
        if by.setdefault(number, part) != part:
            raise ValueError(f"segment {number} differs between copies")
        total = stated if stated is not None else total
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError("segments are missing")
    block = b"".join(by[i] for i in sorted(by))
    if total != len(block):
        raise ValueError(f"{len(block)} bytes, but the last segment states {total}")
    return block


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
_OUT_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
_OUT_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _page(name: str) -> int | None:
    m = _NAME.match(name or "")
    return int(m[1]) if m and m[1] else None


def _response(page: int | None, stated: str, block: bytes | None, problem: str | None = None) -> tuple:
    try:
        payload = http_payload(block) if problem is None else None
        if payload is not None and stated and b32_sha1(payload) != stated:
            problem = "payload digest differs"
    except ValueError as e:
        payload, problem = None, str(e)
    return (page, None if payload is None else len(payload), None if payload is None else b32_sha1(payload), "response", None, problem)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to and problem (null if whole).

    Unsegmented records are decoded where they are read; only segments are shuffled, by origin.  A
    broken record keeps its row, with null payload columns and the reason in ``problem``.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for f, block in parse_records(inflate(data)):
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    if f["warc-type"] == "revisit":
                        rows.append((_page(f["warc-record-id"]), int(f["x-payload-length"]), digest, "revisit", _page(f["warc-refers-to"]), None))
                    elif f["warc-type"] == "response" and "warc-segment-number" not in f:
                        rows.append(_response(_page(f["warc-record-id"]), digest, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, _OUT_TYPES, strict=True)], names=_OUT_NAMES)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["origin", "number", "total", "digest", "block"], (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for f, block in parse_records(inflate(data)):
                    if "warc-segment-number" in f:
                        total = f.get("warc-segment-total-length")
                        rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), total and int(total), f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, types, strict=True)], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by origin and number; one record's segments are held at a time."""
        held: list[tuple] = []

        def flush() -> tuple:
            page, stated = _page(held[0][0]), next((x[3] for x in held if x[3]), "")
            try:
                return _response(page, stated, reassemble((n, block, total) for _, n, total, _, block in held))
            except ValueError as e:
                return _response(page, stated, None, str(e))

        for b in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    rows.append(flush())
                    held.clear()
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, _OUT_TYPES, strict=True)], names=_OUT_NAMES)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(flush(), _OUT_TYPES, strict=True)], names=_OUT_NAMES)

    segments = files.mapInArrow(parts, "origin string, number int, total long, digest string, block binary")
    grouped = segments.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(join, _OUT)
    return files.mapInArrow(whole, _OUT).unionByName(grouped)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, segment_bytes: int = 16_384) -> DataFrame:
    """Write the archive of ``pages`` to the shared folder and read it back.

    One row per row of ``pages``, repeated ones too; equal payloads with the same least page_id are all
    responses.  A null page_id stays null and, unless it is the only holder, revisits the least id.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_revisit_bytes, segment_bytes)
    return read_archive(pages.sparkSession, path)
