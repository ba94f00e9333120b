"""WARC archives: records with revisits, segmented payloads and chunked transfer framing; and back.

Writing. Rows with equal payloads share one response, that of the largest id; the others become revisit records
that name it. A payload above SEGMENT_BYTES is split over a first record and continuation records
(WARC-Segment-Origin-ID, WARC-Segment-Number, and WARC-Segment-Total-Length on the last). An HTTP block
carries its payload with chunked transfer coding. Files are WARC, records one after another, as gzip streams.

Reading. Records are cut out of the files by their Content-Length, so that payloads may hold anything.
Continuation records are grouped by origin identifier wherever they lie, ordered by segment number, and
checked against the total length; then the chunked framing is decoded and the SHA-1 compared.

Cases: a null html is as an empty payload. A null url gives urn:page. Rows that repeat an id and payload are all
responses if theirs is the largest id, else all revisits; each keeps its own records, and revisits of a row that is itself repeated name its page id, not one of
its records (WARC-Refers-To is left out). A record that others refer to is named by page id and digest, so its name doesn't depend on how rows are spread. A null id is never the
largest, unless all of a group's are null. An empty table gives no records. Columns beside the named ones are dropped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

VERSION = b"WARC/1.1\r\n"
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
#: Payload bytes of an archive file, about: a task reads one file at a time whole.
FILE_BYTES = 16 << 20
MIN_BYTES = 0
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORD = "uid string, page_id long, kind string, digest string, refers_to long, origin string, segment int, total long, block binary"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + CHUNK_BYTES]), payload[i : i + CHUNK_BYTES]) for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunked framing")
        out.append(part)
        at = end + 4 + size


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return VERSION + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _key(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each row; their ends are the line separator that the text writer adds."""
    for batch in batches:
        out = []
        for page_id, url, html, holder, holders, copies, uid in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "holder", "holders", "copies", "uid")), strict=True):
            digest = base32_sha1(html)
            key = _key(page_id, digest)
            if copies > 1 and (page_id != holder or holders > 1):  # nobody refers to it by name
                key += f":{uid}"
            head = {"WARC-Type": "response", "WARC-Record-ID": f"<{key}>", "WARC-Date": _DATE, "WARC-Target-URI": re.sub(r"[\x00-\x20]", "%20", url or "urn:page"), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id, "X-Payload-Length": len(html)}
            if holder is not None and holder != page_id:
                out.append(_record(head | {"WARC-Type": "revisit", "WARC-Refers-To": f"<{_key(holder, digest)}>" if holders == 1 else None, "X-Refers-To-Page-ID": holder, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b"HTTP/1.1 200 OK\r\n\r\n"))
                continue
            block = _HTTP + chunked(html)
            parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
            if len(parts) == 1:
                out.append(_record(head, block))
                continue
            out.append(_record(head | {"WARC-Segment-Number": 1}, parts[0]))
            for number, part in enumerate(parts[1:], 2):
                out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{key}:{number}>", "WARC-Date": _DATE, "WARC-Segment-Origin-ID": f"<{key}>", "WARC-Segment-Number": number, "WARC-Segment-Total-Length": len(block) if number == len(parts) else None}, part))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_bytes: int = MIN_BYTES) -> None:
    html = F.coalesce(pages[html_column].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].alias("url"), html.alias("html")).withColumns({"digest": F.unhex(F.sha1("html")), "n": F.length("html")})
    # of each payload that more than one row has: the largest id, and how many rows have that; counted before the shuffle
    each = rows.where(F.col("n") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("k"))
    shared = each.groupBy("digest").agg(F.max(F.struct("page_id", "k")).alias("x"), F.sum("k").alias("copies")).where("copies > 1").select("digest", F.col("x.page_id").alias("holder"), F.col("x.k").alias("holders"), "copies")
    rows = rows.join(shared, "digest", "left")
    # payloads below min_bytes are all responses: they count as repeated, without a holder
    big = F.col("n") >= min_bytes
    rows = rows.select("page_id", "url", "html", F.when(big, F.col("holder")).alias("holder"), F.when(big, F.coalesce("holders", F.lit(1))).otherwise(2).alias("holders"), F.when(big, F.coalesce("copies", F.lit(1))).otherwise(2).alias("copies"))
    records = rows.withColumn("uid", F.monotonically_increasing_id().cast("string")).mapInArrow(_records, "record binary")
    # raw bytes as they are: the writer copies a string's bytes
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_BYTES // SEGMENT_BYTES).text(path)


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if data[at : at + len(VERSION)] != VERSION:
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at + len(VERSION) : end].decode().split("\r\n"))
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at byte {at}")
        yield head, block
        at = end + 8 + size


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _RECORD.split(", ")]
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for head, block in _parsed(gzip.decompress(data.as_py())):
                number = lambda k, h=head: int(h[k]) if k in h else None
                rows.append((head["WARC-Record-ID"], number("X-Page-ID"), head["WARC-Type"], head.get("WARC-Payload-Digest", "")[5:], number("X-Refers-To-Page-ID"), head.get("WARC-Segment-Origin-ID"), number("WARC-Segment-Number"), number("WARC-Segment-Total-Length") or number("X-Payload-Length"), block))
            for i in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 500], strict=True), kinds, strict=True)], names)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole HTTP blocks to payloads, checked against the digest."""
    for batch in batches:
        found = []
        for kind, digest, blocks, total in zip(*(batch.column(n).to_pylist() for n in ("kind", "digest", "blocks", "total")), strict=True):
            block = b"".join(blocks)
            if total is not None and len(block) != total:
                raise ValueError("a segment is missing")
            head, _, body = block.partition(b"\r\n\r\n")
            payload = None
            if kind == "response":
                payload = dechunked(body) if b"Transfer-Encoding: chunked" in head else body
                if base32_sha1(payload) != digest:
                    raise ValueError("a payload differs from its digest")
            found.append(payload)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "kind", "digest", "refers_to", "length")), pa.array(found, pa.binary())], ["page_id", "kind", "digest", "refers_to", "length", "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, kind, digest, refers_to, length, payload (null for revisits, whose length their header gives)."""
    records = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_files, _RECORD)
    single = records.where("segment is null").select("page_id", "kind", "digest", "refers_to", F.col("total").alias("length"), F.array("block").alias("blocks"), F.lit(None).cast("long").alias("total"))
    # one record's segments meet in one row; their number is bounded by that record's size
    segments = records.where("segment is not null").select(F.coalesce("origin", "uid").alias("origin"), "segment", "page_id", "digest", "kind", "total", "block")
    joined = segments.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("page_id").alias("page_id"),
        F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("segment") == 1, F.col("total"))).alias("length"),
        F.max(F.when(F.col("kind") == "continuation", F.col("total"))).alias("total"),
        F.max("segment").alias("most"),
    )
    whole = F.when(F.col("total").isNotNull() & (F.size("parts") == F.col("most")), F.col("parts.block")).otherwise(F.raise_error(F.lit("a segment is missing")).cast("array<binary>"))
    joined = joined.select("page_id", F.lit("response").alias("kind"), "digest", F.lit(None).cast("long").alias("refers_to"), "length", whole.alias("blocks"), "total")
    return single.unionByName(joined).mapInArrow(_payloads, "page_id long, kind string, digest string, refers_to long, length long, payload binary")


def archive_and_read(pages: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
