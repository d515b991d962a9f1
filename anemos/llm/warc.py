"""WARC archives: writing pages as segmented records and reassembling them (operator 8)."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anemos.llm._common import stored

END = b"\r\n\r\n"
PARSED = "record_id string, type string, origin string, segment int, total long, refers_to string, digest string, uri string, sound boolean, block binary"
PAGES = "page_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, complete boolean"


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            n = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            return None
        if n < 0 or len(body) < line + 2 + n + 2 * (n > 0):
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        if body[line + 2 + n : line + 4 + n] != b"\r\n":
            return None
        at = line + 4 + n


def record_name(page_id: str, digest: str) -> str:
    return f"<urn:page:{page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"


def records(page_id: str | None, url: str | None, payload: bytes | None, length: int, digest: str, first: str | None, segment_bytes: int, again: bool = False) -> Iterator[bytes]:
    """The WARC records of one page without their final blank lines: a revisit, or a response in one or several segments. A page's record is named by its id and payload, so that a
    revisit can tell the name of the response it refers to; `again`: rows before have the same id and payload, and the name."""
    name = f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else record_name(page_id, f"{digest}/{uuid.uuid4()}" if again or first is not None else digest)
    target = f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '_', url)}\r\n" if url else ""
    shared = f"WARC-Date: 2024-01-01T00:00:00Z\r\n{target}WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http;msgtype=response\r\n"
    if first is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        head = f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {name}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {record_name(first, digest)}\r\n{shared}Content-Length: {len(block)}\r\n\r\n"
        yield head.encode() + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload or b"")
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    number = "WARC-Segment-Number: 1\r\n" if len(pieces) > 1 else ""
    yield f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\n{number}{shared}Content-Length: {len(pieces[0])}\r\n\r\n".encode() + pieces[0]
    for k, piece in enumerate(pieces[1:], 2):
        total = f"WARC-Segment-Total-Length: {len(block)}\r\n" if k == len(pieces) else ""
        yield f"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Segment-Origin-ID: {name}\r\nWARC-Segment-Number: {k}\r\n{total}Content-Length: {len(piece)}\r\n\r\n".encode() + piece


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 100, segment_bytes: int = 16 << 10, file_bytes: int = 32 << 20) -> None:
    """Write a WARC record for each row to gzipped files of about file_bytes under path. Of rows with equal payloads of at
    least least_revisit bytes, those with the smallest id are responses and the others revisit it. Null html is an empty
    payload, a null url has no target. A row without an id revisits one that has an id, and is a response where none has. Rows that repeat
    an id and payload are alike. An empty table makes no record. Only (id, digest, length) is grouped and joined to find
    revisits; a payload is shuffled once, by id and digest. Rows that lie in more partitions
    than there are files to write are put together, with as many tasks as cores at least: Hadoop's local file system starts three processes for a file, each of which
    shows the executor's memory a second time for a moment.

    A record ends with an empty line twice, which is the line separator of Spark's text writer.
    """
    key, nameless = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull()
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).alias("id"), key.alias("key"), nameless.alias("nameless"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    total = slim.agg(F.sum("n")).first()[0] or 0
    firsts = slim.where(F.col("n") >= least_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1 AND first IS NOT NULL")
    revisits = slim.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("key", "nameless", "digest").agg(F.min(F.col("first").cast("string")).alias("first"))
    parts = max(1, -(-total // file_bytes))
    rows = pages.select(key.alias("key"), nameless.alias("nameless"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    rows = rows.repartition(parts, "key", "nameless", "digest").join(revisits, ["key", "nameless", "digest"], "left")
    rows = rows.withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")))
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("key", "nameless", "digest").orderBy(F.col("n"))) > 1)  # dealt by these keys already

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in range(batch.num_rows):
                key_, url, payload_, digest, n, first, again = (c[r].as_py() for c in batch.columns)
                for record in records(key_, url, payload_, n, digest, first, segment_bytes, again):
                    out.append(record)
                    size += len(record)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = rows.coalesce(max(parts, pages.sparkSession.sparkContext.defaultParallelism))
    made = rows.select(F.when(~F.col("nameless"), F.col("key")).alias("key"), "url", "payload", "digest", "n", "first", "again").mapInArrow(build, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").text(path)


def inflated(data: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """The content of a file, some at a time: of all members if it is gzipped, as far as they are sound."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + piece] for i in range(0, len(data), piece))
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while data and not member.eof:
                yield member.decompress(data, piece)
                data = member.unconsumed_tail
            yield member.flush()
        except zlib.error:
            return
        data = member.unused_data.lstrip(b"\0") if member.eof else b""


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"[0-9]{1,18}", value) else None


def parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of an archive, in PARSED's columns, with no more than a record and a piece held. A record is not `sound` if its
    content is cut short or a number in its header can't be read; after a length that can't be read, the next record begins at the next
    place that names the format."""
    held, more = bytearray(), True

    def fill() -> None:
        nonlocal more
        piece = next(pieces, None)
        more = piece is not None
        held.extend(piece or b"")

    while True:
        while (at := held.find(b"WARC/")) < 0 and more:
            del held[: max(0, len(held) - 4)]
            fill()
        if at < 0:
            return
        del held[:at]
        while (stop := held.find(END)) < 0 and more:
            fill()
        if stop < 0:
            return
        head = {}
        for line in bytes(held[:stop]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        n = _number(head.get(b"content-length"))
        del held[: stop + 4]
        while n is not None and len(held) < n and more:
            fill()
        block = b"" if n is None else bytes(held[:n])
        del held[: len(block)]
        segment, total = head.get(b"warc-segment-number"), head.get(b"warc-segment-total-length")
        number, whole = _number(segment), _number(total)
        number = number if (number or 0) < 1 << 31 else None
        sound = n == len(block) and (segment is None) == (number is None) and (total is None) == (whole is None)
        yield (head.get(b"warc-record-id"), head.get(b"warc-type"), head.get(b"warc-segment-origin-id"), number, whole, head.get(b"warc-refers-to"), head.get(b"warc-payload-digest"), head.get(b"warc-target-uri"), sound, block)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path, plain or gzipped in one or many members, in PARSED's columns. Spark hands over a file as one
    value; it is unzipped and parsed a piece at a time."""
    schema = T.StructType.fromDDL(PARSED)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for row in parse(inflated(batch.column(0)[i].as_py() or b"")):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(per_batch, schema)


def reassemble(parsed: DataFrame) -> DataFrame:
    """Records with the blocks of their segments in order (`blocks`): grouped by origin, ordered by segment number. `whole` is
    false where a number is missing or repeated or a segment isn't sound; `total` is the length that the last one tells, -1 if none does. A group is the
    segments of one record."""
    cols = ["type", "refers_to", "digest", "uri"]
    plain = parsed.where(F.col("segment").isNull()).select(F.col("record_id").alias("name"), *cols, F.array("block").alias("blocks"), F.lit(None).cast("long").alias("total"), F.col("sound").alias("whole"))
    segments = parsed.where(F.col("segment").isNotNull()).withColumn("name", F.coalesce("origin", "record_id"))
    lead = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = segments.groupBy("name").agg(*[lead(c) for c in cols], F.max(F.coalesce("total", F.lit(-1))).alias("total"), F.min("sound").alias("sound"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"))
    in_turn = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("s"))
    return plain.unionByName(joined.select("name", *cols, F.transform("s", lambda x: x["block"]).alias("blocks"), "total", (in_turn & F.col("sound")).alias("whole")))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The pages of the archives under path, in PAGES' columns: those of responses, resources and revisits, payloads reassembled, unchunked
    and held against their digest (`complete`). A page's id is null where its record doesn't tell one. A revisit has no payload
    of its own; its length and digest are held against those of the page it refers to. Records cut short or with a header that can't
    be read are not complete; other kinds of records are left out. Without `payloads` they are not returned, and files are read
    once rather than twice."""
    schema = T.StructType.fromDDL(PAGES)

    def named(record: str | None) -> str | None:
        return record.removeprefix("<urn:page:").removesuffix(">").rsplit(":", 1)[0] if record and record.startswith("<urn:page:") else None

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                name, kind, refers, digest, uri, blocks, total, whole = (c[i].as_py() for c in batch.columns)
                block = b"".join(blocks)
                whole = bool(whole) and (total is None or total == len(block))
                head, _, body = block.partition(END)
                lower = head.lower()
                digest = (digest or "").removeprefix("sha256:")
                page = named(name)
                if kind == "revisit":
                    length = re.search(rb"content-length: *(\d{1,18})\b", lower)
                    rows.append((page, uri, kind, named(refers), None, int(length[1]) if length else None, digest, bool(whole and length)))
                else:
                    payload = unchunked(body) if b"transfer-encoding: chunked" in lower else body
                    found = None if payload is None else hashlib.sha256(payload).hexdigest()
                    rows.append((page, uri, kind, None, payload if payloads else None, None if payload is None else len(payload), found or digest, whole and found == digest))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    kept = reassemble(read_records(spark, path)).where(F.col("type").isin("response", "resource", "revisit"))
    pages = kept.select("name", "type", "refers_to", "digest", "uri", "blocks", "total", "whole").mapInArrow(per_batch, schema)
    if not payloads:
        pages = stored(pages.drop("payload"), "warc-pages")
    held = pages.where("record_type <> 'revisit' AND complete").select(F.col("page_id").alias("refers_to"), "payload_digest", F.lit("revisit").alias("record_type"), F.col("payload_bytes").alias("held_bytes")).distinct()
    out = pages.join(held, ["refers_to", "payload_digest", "record_type"], "left")
    sound = F.col("complete") & ((F.col("record_type") != "revisit") | F.coalesce(F.col("held_bytes") == F.col("payload_bytes"), F.lit(False)))
    return out.select(*[sound.alias(c) if c == "complete" else c for c in pages.columns])
