"""WARC archives: writing records in segments, and putting segments together again.

A record whose block is long is written as a first segment and continuation records. Reading groups continuations by
origin identifier, orders them by segment number, verifies the total length and decodes chunked transfer framing.
Archives are written and read by Spark's own file sources, so any store will do.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlake.llm.common import Scratch, table

#: Block bytes of a segment, and records of a file: so a file has bounded size.
SEGMENT_BYTES, FILE_RECORDS = 1 << 12, 4096
CHUNK_BYTES = 1 << 13
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
# Fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
RECORD = "record_id string, warc_type string, page_id long, uri string, payload_digest string, refers_to_id string, origin_id string, segment int, total_length long, block binary"
PAYLOAD = "record_id string, warc_type string, page_id long, uri string, payload_digest string, refers_to_id string, payload binary, error string"


def record_id(page_id: int | None, digest: str, row_no: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}|{row_no}'.encode()).digest())}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in HTTP chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Undo the framing; ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without its closing blank lines."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers if v is not None)
    return b"%b\r\n%bContent-Length: %d\r\n\r\n%b" % (VERSION, head, len(block), block)


def segments(page_id, uri, payload: bytes, digest: str, row_no: int, first: dict | None, limit: int) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response's first segment and its continuations."""
    rid = record_id(page_id, digest, row_no)
    uri = None if uri is None else "".join(c for c in uri if c >= " ")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-ID", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        refers = [("WARC-Refers-To", record_id(first["page_id"], digest, first["row_no"])), ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha256:{digest}")]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, *refers], http)]
    block = http + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    parts = [block[i : i + limit] for i in range(0, len(block), limit)]
    if len(parts) == 1:
        return [record(head, block)]
    out = [record([*head, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{rid}|{n}'.encode()).digest())}>"
        last = len(block) if n == len(parts) else None
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last)], part))
    return out


def payload_bytes(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write gzipped WARC files to the folder ``path``, a record or more for each row.

    Of rows with equal payloads of at least REVISIT_BYTES, those with the smallest key are responses and the others
    revisit them. A null payload is empty; a null or odd URI is left out or stripped of control characters; a null key
    is written without one and never referred to. Every row is a record with an id of its own (made of key, digest and
    place in the input), so rows equal in key and payload are two. An empty table gives an archive without records.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(uri).alias("uri"), payload_bytes(payload).alias("payload"), F.monotonically_increasing_id().alias("row_no"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row_no")))
    firsts = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(firsts, "digest", "left")
    rows = rows.withColumn("first", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id")), F.col("first")))

    def build(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += segments(row["page_id"], row["uri"], row["payload"], row["digest"], row["row_no"], row["first"], segment_bytes)
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 256], pa.binary())], ["value"])

    # the closing blank lines are the line separator; a string column keeps the bytes as they are
    made = rows.select("page_id", "uri", "payload", "digest", "row_no", "first").mapInArrow(build, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes):
    """The records of one archive as dicts of headers and block; ValueError where one is broken."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"record at {at} has no end of headers")
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) < n or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record is cut short")
        at += 4
        yield headers, block


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file, or the bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, segments apart."""

    def read(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for h, block in parse(gunzip(content)):
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), number("x-page-id"), h.get("warc-target-uri"), digest, h.get("warc-refers-to"), h.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block))
                for i in range(0, len(rows), 256):
                    yield arrow(rows[i : i + 256], RECORD)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(read, RECORD)


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records with their decoded payload; ``error`` says why a payload is null.

    Segments meet by origin identifier, are ordered by number and must be gapless and make up the total length that
    the last one states. Equal segments (same origin and number) count once. A revisit has no payload of its own, and
    no error. Continuations without their first segment give a row with an error.
    """
    segment = F.struct("segment", "block", "total_length", "warc_type", "page_id", "uri", "payload_digest", "refers_to_id")
    whole = records.where("segment is null")
    parts = records.where("segment is not null").groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(F.array_sort(F.collect_list(segment)).alias("parts"))
    head = F.get("parts", F.lit(0))
    joined = parts.select("record_id", *(head[c].alias(c) for c in ("warc_type", "page_id", "uri", "payload_digest", "refers_to_id")), F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks"), F.array_max("parts.total_length").alias("total_length"))
    single = whole.select("record_id", "warc_type", "page_id", "uri", "payload_digest", "refers_to_id", F.array(F.lit(1)).alias("numbers"), F.array("block").alias("blocks"), F.length("block").cast("long").alias("total_length"))

    def decode(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload, error = None, None
                if r["warc_type"] != "revisit":
                    blocks = dict(zip(r["numbers"], r["blocks"], strict=True))
                    block = b"".join(blocks[n] for n in sorted(blocks))
                    if sorted(blocks) != list(range(1, len(blocks) + 1)):
                        error = "a segment is missing"
                    elif r["total_length"] is None or len(block) != r["total_length"]:
                        error = "segments don't make up the total length"
                    else:
                        head, _, body = block.partition(b"\r\n\r\n")
                        try:
                            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                        except ValueError as e:
                            error = str(e)
                rows.append((r["record_id"], r["warc_type"], r["page_id"], r["uri"], r["payload_digest"], r["refers_to_id"], payload, error))
            for i in range(0, len(rows), 64):
                yield arrow(rows[i : i + 64], PAYLOAD)

    return single.union(joined).mapInArrow(decode, PAYLOAD)


def captures(scratch: Scratch, records: DataFrame) -> DataFrame:
    """A row for each record of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, error.

    A revisit has the length of the response with its payload digest, whose smallest page it refers to. Broken records,
    payloads that are not what their digest says, and revisits without a response stay, with an ``error`` and without
    what is not known.
    """
    read = reassemble(records).select("page_id", "warc_type", F.col("payload_digest").alias("stated"), F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), "error")
    read = scratch.save(read, "read")
    read = read.withColumn("error", F.coalesce("error", F.when((F.col("warc_type") != "revisit") & (F.col("digest") != F.col("stated")), "payload has another digest")))
    whole = F.col("error").isNull()
    responses = read.where("warc_type is null or warc_type <> 'revisit'")
    target = responses.where(whole).groupBy(F.col("digest").alias("stated")).agg(F.min("page_id").alias("refers_to"), F.first("n").alias("payload_bytes"))
    revisits = read.where("warc_type = 'revisit'").select("page_id", "warc_type", "stated", "error").join(target, "stated", "left")
    lost = F.coalesce("error", F.when(F.col("payload_bytes").isNull(), "no response has this payload"))
    revisits = revisits.select("page_id", "payload_bytes", F.col("stated").alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to", lost.alias("error"))
    own = responses.select("page_id", F.when(whole, F.col("n")).alias("payload_bytes"), F.when(whole, F.col("digest")).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "error")
    return own.union(revisits)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives: length and digest of its whole payload, and what it revisits."""
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    with scratch.cleaning():
        write_archives(table(spark, sf_dir, "pages"), path)
    return captures(scratch, read_records(spark, path))


OP6_SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisits THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, coalesce(strlen(coalesce(html, '')) >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first), false) AS revisits
      FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""
