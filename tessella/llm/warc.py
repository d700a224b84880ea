"""WARC archives by way of a chunked record table.

Writing: every page becomes rows (record, chunk number, part of the payload), cut
inside the JVM, so Python never holds more than parts.  A row is written as a WARC
segment of its own, with the SHA-1 of the payload up to and with this part: the
first part as a response record, the others as continuation records.  Every input
row gets a record id of its own; page_id is data and travels in a header, so
repeated page_ids stay apart.  A page whose payload another record holds is written
as a revisit record without a payload.

Reading: files are parsed to the same rows.  Payloads of one part are checked at
once; for others, the parts of a record are brought together in order and a
running digest is carried from part to part and compared with each part's own.
Archives of others are read too: header names in any case, one gzip member a record,
HTTP headers before the payload, records of other types (left out of the result).

Files are written and read by Spark alone, so any store that Spark reaches will do.
A file holds at most FILE_SEGMENTS * PART bytes of payload, 128 MB, before compression.
"""

from __future__ import annotations

import base64
import binascii
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Table, columns_or_null, new_path, small_batches

#: Bytes of a part.
PART = 65_536
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Segments of a file.
FILE_SEGMENTS = 2_000
#: Bytes of rows that a batch gathers before it is handed on.
BATCH_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, body, payload_bytes, payload_digest, record_type, refers_to, refers_url) of pages (page_id, url, html).

    Of equal payloads of at least `least` bytes the largest page_id responds, the others revisit it;
    rows that repeat the largest page_id all respond, as do rows without one.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select("page_id", "url", body.alias("body")).withColumns({"payload_bytes": F.octet_length("body").cast("long"), "payload_digest": F.sha1("body")})
    heads = sized.where(f"payload_bytes >= {least}").groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("head"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    heads = Table(heads, "heads").df
    again = F.col("page_id") < F.col("head.page_id")
    refers = [F.when(again, F.col("head.page_id")).alias("refers_to"), F.when(again, F.col("head.url")).alias("refers_url")]
    return sized.join(heads, "payload_digest", "left").select("page_id", "url", "body", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), *refers)


def chunked(records: DataFrame, part: int = PART) -> DataFrame:
    """The chunk rows of decide()'s records, in order within each: chunk (from 1), chunks, and data instead of body; a revisit is one row without data."""
    n = F.when(F.col("record_type") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / part)))
    counted = records.withColumn("chunks", n.cast("int"))
    rows = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("chunk"))
    data = F.when(F.col("record_type") != "revisit", F.substring("body", (F.col("chunk") - 1) * part + 1, F.lit(part)))
    return rows.withColumn("data", data).drop("body")


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _sha1_hex(value: str | None) -> str | None:
    """The SHA-1 of a digest header in bare hex; None for none, or for another algorithm."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()
    except binascii.Error:
        return None


def _clean(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace").replace("\r", "%0D").replace("\n", "%0A")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of rows (..., weight); the weight in bytes bounds each batch."""

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    held, weight = [], 0
    for *row, size in rows:
        held.append(row)
        weight += size + 64
        if weight >= limit:
            yield batch(held)
            held, weight = [], 0
    if held:
        yield batch(held)


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one binary column as strings; the bytes are passed on as they are, whether UTF-8 or not."""
    for batch in batches:
        column = batch.column(0)
        yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset)], names=batch.schema.names)


def _segments(archive: str, date: str):
    """One string per chunk row: the WARC headers, an empty line, and the part of the payload."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        made, origin, running = 0, "", hashlib.sha1()
        task = TaskContext.get()
        for batch in batches:
            plain = batch.drop_columns(["data"]).to_pylist()
            for k, r in enumerate(plain):
                data = batch.column("data")[k]
                data = data.as_buffer() if data.is_valid else b""
                made += 1
                own = uuid.UUID(bytes=hashlib.sha1(f"{archive}/{task.partitionId() if task else 0}/{made}".encode()).digest()[:16], version=5)
                lines = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Target-URI: {_clean(r['url'])}", f"WARC-Date: {date}"]
                if r["chunk"] == 1:
                    origin, running = own, hashlib.sha1()
                    lines += [f"WARC-Type: {r['record_type']}", f"WARC-Payload-Digest: {_base32(r['payload_digest'])}"]
                else:
                    lines += ["WARC-Type: continuation", f"WARC-Segment-Origin-ID: <urn:uuid:{origin}>"]
                if r["page_id"] is not None:
                    lines.append(f"X-Page-ID: {r['page_id']}")
                if r["record_type"] == "revisit":
                    lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Target-URI: {_clean(r['refers_url'])}", f"X-Refers-To-Page-ID: {r['refers_to']}"]
                else:
                    running.update(data)
                    lines += ["Content-Type: text/html; charset=utf-8", f"X-Running-Digest: {_base32(running.hexdigest())}"]
                    if r["chunks"] > 1:
                        lines.append(f"WARC-Segment-Number: {r['chunk']}")
                        if r["chunk"] == r["chunks"]:
                            lines.append(f"WARC-Segment-Total-Length: {r['payload_bytes']}")
                head = "\r\n".join([*lines, f"Content-Length: {len(data)}", "", ""]).encode("utf-8", "replace")
                yield b"".join((head, data)), len(head) + len(data)

    return lambda batches: _text(_batches(rows(batches), ["value"], [pa.binary()]))


def write_warc(pages: DataFrame, path: str | None = None, part: int = PART, least: int = LEAST_REVISIT, date: datetime.datetime | None = None) -> str:
    """Writes pages (page_id, url, html) as gzip-compressed WARC files and returns their folder; date: when they were got, now if not given."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    path = path or new_path(spark, "warc")
    stamp = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = columns_or_null(pages, page_id="long", url="binary", html="string")
    records = chunked(decide(pages, least), part).mapInArrow(_segments(uuid.uuid4().hex, stamp), "value string")
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)
    return path


class _Stream:
    """Reads a file, gzip-compressed (in one member or many) or plain, forwards and a piece at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.zip = zlib.decompressobj(47) if bytes(data[:2]) == b"\x1f\x8b" else None

    def fill(self, n: int) -> bool:
        while len(self.held) < n and self.at < len(self.data):
            piece = self.data[self.at : self.at + 65_536]
            self.at += len(piece)
            if self.zip is None:
                self.held += piece
                continue
            self.held += self.zip.decompress(piece)
            if self.zip.eof:
                self.at -= len(self.zip.unused_data)
                self.zip = zlib.decompressobj(47)
        return len(self.held) >= n

    def until(self, mark: bytes) -> bytes:
        n = 4096
        while (k := self.held.find(mark)) < 0:
            if not self.fill(n := max(2 * n, len(self.held) + 1)) and self.held.find(mark) < 0:
                raise ValueError("a WARC header does not end")
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("a WARC record is cut short")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by their names in lower case, block) of each record of a gzip-compressed or plain WARC file."""
    s = _Stream(data)
    while s.fill(1):
        lines = s.until(b"\r\n\r\n")[:-4].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = s.take(int(head["content-length"]))
        s.take(4)
        yield head, block


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


_CHUNKS = "record string, page_id long, url string, record_type string, segmented boolean, chunk long, total long, digest string, running string, refers_to long, data binary"


def read_chunks(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """The chunk table of WARC files: a row per record or segment.  record: id of the record or, in a continuation, of its first segment; total: the record's bytes, in its last segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column("content"):
                for head, block in parse_warc(content.as_buffer()):
                    kind, segment = head["warc-type"], head.get("warc-segment-number")
                    if kind == "response" and head.get("content-type", "").startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    record = head.get("warc-segment-origin-id") or head["warc-record-id"]
                    total = len(block) if segment is None else int(head.get("warc-segment-total-length", "-1"))
                    digest, running = _sha1_hex(head.get("warc-payload-digest")), _sha1_hex(head.get("x-running-digest"))
                    yield record, _whole(head.get("x-page-id")), head.get("warc-target-uri"), kind, segment is not None, int(segment or 1), total, digest, running, _whole(head.get("x-refers-to-page-id")), block, len(block)

    names, types = [c.split()[0] for c in _CHUNKS.split(", ")], [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in _CHUNKS.split(", ")]
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
    return found.select("content").mapInArrow(lambda batches: _batches(rows(batches), names, types), _CHUNKS)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record of several parts, from parts in order; the digest is carried on, the payload is not kept."""

    def rows() -> Iterator[tuple]:
        now, page, sha, size, ok, want, next_, open_ = None, None, hashlib.sha1(), 0, True, None, 1, False
        for batch in batches:
            for record, page_id, chunk, total, digest, running, data in zip(*(batch.column(c) for c in ("record", "page_id", "chunk", "total", "digest", "running", "data")), strict=True):
                record, chunk, total, running = record.as_py(), chunk.as_py(), total.as_py(), running.as_py()
                if record != now:
                    if open_:
                        yield page, size, sha.hexdigest(), False, 64
                    now, page, sha, size, ok, want, next_, open_ = record, page_id.as_py(), hashlib.sha1(), 0, True, digest.as_py(), 1, True
                ok = ok and open_ and chunk == next_
                next_ += 1
                sha.update(data.as_buffer())
                size += len(data.as_buffer())
                ok = ok and (running is None or sha.hexdigest() == running)
                if total >= 0 and open_:
                    open_ = False
                    yield page, size, sha.hexdigest(), ok and size == total and sha.hexdigest() == (want or sha.hexdigest()), 64
        if open_:
            yield page, size, sha.hexdigest(), False, 64

    yield from _batches(rows(), ["page_id", "payload_bytes", "payload_digest", "ok"], [pa.int64(), pa.int64(), pa.string(), pa.bool_()])


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, ok.

    Digests and sizes are measured on the payload read; a revisit has those of the
    response it refers to.  ok: the digests of the archive, where it has them, agree
    with them and no segment is missing.
    """
    whole = chunks.where("record_type = 'response' and not segmented")
    single = whole.select("page_id", F.octet_length("data").cast("long").alias("payload_bytes"), F.sha1("data").alias("payload_digest"), (F.sha1("data") == F.coalesce("digest", F.sha1("data"))).alias("ok"))
    parts = chunks.where("record_type in ('response', 'continuation') and segmented").select("record", "page_id", "chunk", "total", "digest", "running", "data")
    several = parts.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_carried, "page_id long, payload_bytes long, payload_digest string, ok boolean")
    responses = single.unionAll(several)
    again = chunks.where("record_type = 'revisit'").select("page_id", "refers_to", "digest")
    referred = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes", F.col("ok").alias("held"))
    referred = referred.join(again.select("refers_to", "digest").distinct(), ["refers_to", "digest"], "left_semi").groupBy("refers_to", "digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("held").alias("held"))
    referred = Table(referred, "referred").df
    revisits = again.join(referred, ["refers_to", "digest"], "left").select("page_id", "payload_bytes", F.when(F.col("held").isNotNull(), F.col("digest")).alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", F.coalesce("held", F.lit(False)).alias("ok"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "ok").unionAll(revisits)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table with payloads: record, page_id, url, chunk, data; a long payload stays in parts, in bytes, as a part may end inside a character."""
    return read_chunks(spark, path).where("record_type in ('response', 'continuation')").select("record", "page_id", "url", "chunk", "data")


def archive_and_read(pages: DataFrame, part: int = PART, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the pages as WARC files, reads these, and gives the records read, as read_records() does.

    Null html counts as empty; html that is no valid UTF-8 is kept byte by byte.  Each
    row is a record of its own, also where it repeats a page_id, with an equal payload
    or another; a row without page_id is written and read like others and never a
    revisit.  Other columns are ignored.  An empty table gives no rows.
    """
    path = write_warc(pages, part=part, least=least)
    chunks = Table(read_chunks(pages.sparkSession, path).drop("url"), "chunks")
    return read_records(chunks.df)


def op3_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("ok")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to FROM m
"""
