"""WARC archives: writing with segments, reading back with segment reassembly.

Records are written through Spark's text sink, whose line separator ends each record, so the files are plain WARC 1.1
(gzip) on any store that Spark can write, and a lost task leaves nothing behind. Blocks longer than a segment go on in
continuation records. Reading parses each file as a stream; records without segments are decoded where they are, and
only segments are shuffled: grouped by origin identifier, ordered by segment number, checked against the total length.
Payloads are framed by chunked transfer coding and decoded from it.

Defined results: a null html is an empty payload; a null page_id or url leaves its field out; of records with equal
payloads of MIN_REVISIT bytes or more, all rows with the largest page_id are responses, so repeated rows of it are too;
null page_ids are never the largest; rows are written one by one, so repeated rows come back as often; extra columns are
ignored; an empty table gives an empty result. A record that is incomplete or does not match its digest comes back with
its error and without payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import checkpoint_dir, mapped

MIN_REVISIT = 1000
SEGMENT = 16 << 10
CHUNK = 4 << 10
FILE_RECORDS = 1000
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, origin string, segment int, total long, refers_to long, digest string, block binary"
WHOLE = "page_id long, record_type string, refers_to long, digest string, block binary, error string"
DECODED = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record but for its last line end."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def uri(url: str | None) -> str | None:
    """The address with the bytes escaped that would end a header line."""
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, name: str, segment: int = SEGMENT) -> Iterator[bytes]:
    sha = hashlib.sha1(payload).digest()
    fields = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha).decode()), ("X-Page-ID", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", uri(refers_url)), ("X-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http;msgtype=response")]
        yield record([("WARC-Type", "revisit"), *fields], http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    fields.append(("Content-Type", "application/http;msgtype=response"))
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *fields], block)
        return
    yield record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], block[:segment])
    for k, a in enumerate(range(segment, len(block), segment), 2):
        total = len(block) if a + segment >= len(block) else None
        own = uuid.uuid5(uuid.UUID(name), str(k))
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<urn:uuid:{name}>"), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], block[a : a + segment])


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, segment: int = SEGMENT) -> None:
    """Writes a response or revisit for each row of pages (page_id, url, html) to gzip files under path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    large = F.octet_length("payload") >= min_revisit
    # the largest of its equals: narrow rows only, summed before they are dealt out
    same = rows.where(large).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1 AND top.page_id IS NOT NULL").select("sha", "top")
    rows = rows.join(same, "sha", "left").withColumn("top", F.when(large & ~F.col("top.page_id").eqNullSafe(F.col("page_id")), F.col("top")))
    rows = rows.select("page_id", "url", "payload", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for values in zip(*batch.columns, strict=True):
                page_id, url, payload, refers_to, refers_url = (v.as_py() for v in values)
                out += page_records(page_id, url, payload, refers_to, refers_url, str(uuid.uuid4()), segment)
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = mapped(rows, written, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Stream:
    """Reads a gzip or plain file held in memory piece by piece."""

    def __init__(self, content: bytes):
        self.rest, self.buffer, self.at = memoryview(content), bytearray(), 0
        self.inflate = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if not len(self.rest):
            return False
        part, self.rest = bytes(self.rest[: 1 << 20]), self.rest[1 << 20 :]
        if self.at > 1 << 22:
            del self.buffer[: self.at]
            self.at = 0
        while part:
            if self.inflate is None:
                self.buffer += part
                break
            self.buffer += self.inflate.decompress(part)
            part = self.inflate.unused_data
            if self.inflate.eof:  # members follow each other
                self.inflate = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self.more():
                return None
        out = bytes(self.buffer[self.at : end]).rstrip(b"\r")
        self.at = end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self.more():
            pass
        out = bytes(self.buffer[self.at : self.at + n])
        self.at += len(out)
        return out


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name, and the block, of each record of a file."""
    stream = Stream(content)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.line()):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.take(int(fields.get("content-length", 0)))


def row(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields.get("warc-payload-digest", "")
    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    segment = number("warc-segment-number")
    origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id")) if segment is not None else None
    return number("x-page-id"), fields.get("warc-type"), origin, segment, number("warc-segment-total-length"), number("x-refers-to-page-id"), digest, block


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The records under path that are segments, or those that are whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for fields, block in parse(content.as_py()):
                    if ("warc-segment-number" in fields) != segmented or fields.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    out.append(row(fields, block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield arrow(out, RECORD)
                        out, size = [], 0
                if out:
                    yield arrow(out, RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return mapped(files, read, RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from their segments; error says what is missing."""
    by = segments.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "record_type", "refers_to", "digest")),
    )
    by = by.select("page_id", "record_type", "refers_to", "digest", "total", F.col("s.segment").alias("numbers"), F.col("s.block").alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a record at a time, since each may be large
                page_id, kind, refers_to, digest, total, numbers, blocks = (c[i].as_py() for c in batch.columns)
                block = b"".join(blocks)
                whole = numbers == list(range(1, len(numbers) + 1)) and total == len(block)
                yield arrow([(page_id, kind, refers_to, digest, block, None if whole else "segments do not add up to the total length")], WHOLE)

    return mapped(by, run, WHOLE)


def decode(record_type: str, digest: str | None, block: bytes) -> tuple[int | None, str | None, bytes | None, str | None]:
    """Length, digest and bytes of the payload, and the error."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    if record_type == "revisit":
        return int(fields.get(b"content-length", 0)), digest, None, None
    try:
        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    except ValueError as e:
        return None, None, None, str(e)
    own = hashlib.sha1(payload).hexdigest()
    if digest not in (None, own):
        return None, None, None, "the payload does not match its digest"
    return len(payload), own, payload, None


def decoded(whole: DataFrame, payloads: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in zip(*batch.columns, strict=True):
                page_id, kind, refers_to, digest, block, error = (v.as_py() for v in values)
                n, sha, payload, bad = (None, None, None, error) if error else decode(kind, digest, block)
                out.append((page_id, kind, refers_to, n, sha, payload if payloads else None, bad))
            yield arrow(out, DECODED)

    return mapped(whole, run, DECODED)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each page that the archives under path hold."""
    whole = records(spark, path, False).select("page_id", "record_type", "refers_to", "digest", "block", F.lit(None).cast("string").alias("error"))
    joined = reassembled(records(spark, path, True))
    out = decoded(whole, payloads).unionByName(decoded(joined, payloads))
    return out if payloads else out.drop("payload")


def archive_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
