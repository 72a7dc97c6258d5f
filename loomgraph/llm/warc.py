"""WARC archives as a chunked record table.

A payload becomes rows (record, chunk number, bytes, digest so far), so no step holds more than a
chunk besides the source row.  Spark's own text writer lays the archives out: one row is one WARC
record, and what ends a record ends the row.  Payloads longer than a chunk are written as the
segments that the WARC format has for this (a first record and continuations).  The reader splits files
at the start of a record, in Spark again, and runs over each record's chunks in order.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import discard, new_path, stage, table

#: Every record starts so; no chunk may contain it, since the reader splits there.
RECORD_START = "WARC/1.1\r\nWARC-Type: "
RECORD_END = "\r\n\r\n"
CHUNK_BYTES = 1 << 16

CHUNK_SCHEMA = "page_id long, url string, record_id string, chunk_no int, last boolean, offset long, size int, coded boolean, chunk string, digest string"


#: What a response's block has before the payload.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK_CODING = "X-Chunk-Encoding"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def pieces(payload: memoryview, size: int, mark: bytes):
    """(start, bytes) of chunks of at most ``size`` bytes, between characters, none of which contains ``mark``.

    Only a chunk at a time is copied.
    """
    at, n = 0, len(payload)
    while at < n or n == 0:
        end = min(at + size, n)
        while end < n and end > at + 4 and payload[end] & 0xC0 == 0x80:
            end -= 1
        chunk = bytes(payload[at:end])
        found = chunk.find(mark)
        if found >= 0:
            chunk = chunk[: found + len(mark) // 2]
        yield at, chunk
        at += len(chunk)
        if n == 0:
            return


def as_text(chunk: bytes) -> tuple[bool, str]:
    """(coded, text): the chunk as it is, or in base64 if its bytes aren't UTF-8, since archives are laid out as text."""
    try:
        return False, chunk.decode()
    except UnicodeDecodeError:
        return True, base64.b64encode(chunk).decode()


def chunk_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = CHUNK_BYTES) -> DataFrame:
    """Rows of each payload's chunks; ``digest`` is the SHA-256 of all bytes up to the chunk's end.

    Null payloads are empty and have one empty chunk.  Each row of ``pages`` is a record of its own, repeated or not, and
    null ids stay null; a payload of any length is read where it lies, a chunk at a time.  ``size`` counts the payload's bytes; a chunk
    that isn't UTF-8 is ``coded`` in base64, so any bytes come through.
    """

    def chunks(batches):
        mark, names = RECORD_START.encode(), [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        rows, held = [], 0
        for batch in batches:
            ids, urls, serials = (batch.column(i).to_pylist() for i in (0, 1, 3))
            payloads = batch.column(2).cast(pa.binary())
            for i, (page, url, serial) in enumerate(zip(ids, urls, serials, strict=True)):
                buffer = payloads[i].as_buffer() if payloads[i].is_valid else None
                view = memoryview(buffer) if buffer is not None else memoryview(b"")
                state, name = hashlib.sha256(), hashlib.md5(f"{page}/{serial}".encode()).hexdigest()
                for no, (at, chunk) in enumerate(pieces(view, size, mark)):
                    state.update(chunk)
                    rows.append((page, url, name, no, at + len(chunk) == len(view), at, len(chunk), *as_text(chunk), state.hexdigest()))
                    held += len(chunk)
                    if held >= 64 * size or len(rows) >= 10_000:
                        yield _batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, names)

    given = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col), F.monotonically_increasing_id())
    return given.toDF("page_id", "url", "payload", "serial").mapInArrow(chunks, CHUNK_SCHEMA)


def _batch(rows, names):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def revisits_of(chunks: DataFrame, least: int) -> DataFrame:
    """(record_id, first_page, first_record, bytes, sha) of records whose payload an earlier page has; only last chunks' ids,
    lengths and digests are compared."""
    ends = chunks.where("last").select("record_id", "page_id", (F.col("offset") + F.col("size")).alias("bytes"), F.col("digest").alias("sha"))
    same = (
        ends.where(F.col("bytes") >= least).groupBy("sha", "bytes")
        .agg(F.min("page_id").alias("first_page"), F.min_by("record_id", F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("record_id"))).alias("first_record"), F.count("*").alias("n"))
        .where("n > 1 and first_page is not null")
    )
    return ends.join(same, ["sha", "bytes"]).where("page_id is null or page_id != first_page").select("record_id", "first_page", "first_record", "bytes", "sha")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, size: int = CHUNK_BYTES) -> None:
    """Write one record, or its segments, for each row of ``pages`` under ``path``, gzipped.

    Of payloads of ``least`` bytes or more that are equal, that of the smallest page id is written as a response and the others
    as revisits of it, without a payload.  Payloads become chunks where they are read; after that no row is longer than a
    chunk.  Null payloads are empty, null ids are left out of the record's own field, rows that share an id are records each.
    """
    chunks = stage(chunk_records(pages, id_col, url_col, payload_col, size), "chunks")
    again = stage(revisits_of(chunks, least), "revisits")
    decided = chunks.join(again, "record_id", "left")
    uri = lambda c: F.concat(F.lit("<urn:md5:"), c, F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))
    maybe = lambda test, column: F.when(test, column).otherwise(F.lit(""))
    revisit, first, last = F.col("first_page").isNotNull(), F.col("chunk_no") == 0, F.col("last")
    whole = first & last
    own = F.when(first, F.col("record_id")).otherwise(F.md5(F.concat_ws("/", "record_id", "chunk_no")))
    target = field("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "))
    top = [F.when(first, F.lit("response")).otherwise(F.lit("continuation")), field("WARC-Record-ID", uri(own)), field("WARC-Date", F.lit("1970-01-01T00:00:00Z")), target, field("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))]
    segment = maybe(~whole, F.concat(field("WARC-Segment-Number", F.col("chunk_no") + 1), maybe(~first, field("WARC-Segment-Origin-ID", uri(F.col("record_id")))), maybe(last, field("WARC-Segment-Total-Length", F.col("offset") + F.col("size") + len(HTTP_HEAD)))))
    digest = F.when(last, field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))).otherwise(field("X-Digest-So-Far", F.concat(F.lit("sha256:"), "digest")))
    body = F.concat(maybe(first, F.lit(HTTP_HEAD)), F.col("chunk"))
    kind = maybe(first, field("Content-Type", F.lit("application/http; msgtype=response")))
    response = F.concat(F.lit(RECORD_START), *top, segment, digest, kind, maybe(F.col("coded"), field(CHUNK_CODING, F.lit("base64"))), field("Content-Length", F.octet_length(body)), F.lit(RECORD_END), body)
    copy = F.concat(
        F.lit(RECORD_START), F.lit("revisit"), *top[1:], field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", uri(F.col("first_record"))), field("X-Refers-To-Page", F.col("first_page")),
        field("X-Payload-Length", F.col("bytes")), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "sha")), field("Content-Length", F.lit(0)), F.lit(RECORD_END),
    )
    lines = decided.where(~revisit | first).select(F.when(revisit, copy).otherwise(response).alias("value"))
    # small files stay whole when read again: gzip can't be split
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)
    discard(chunks)


def read_archives(spark, path: str) -> DataFrame:
    """Chunk rows of the archives: record_type, record_id, chunk_no, page_id, refers_to, length, digest, content_length, segmented, coded, chunk."""
    lines = spark.read.option("lineSep", RECORD_START).text(path).where("value != ''")
    cut = F.instr("value", RECORD_END)
    parts = lines.select(
        F.expr("substring(value, 1, instr(value, '\\r\\n\\r\\n') - 1)").alias("head"),
        F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4, length(value) - instr(value, '\\r\\n\\r\\n') - 7)").alias("chunk"),
        cut.alias("cut"),
    )
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ?([^\r]*)", 1), F.lit(""))
    kind, length = F.regexp_extract("head", "^([a-z]+)", 1), field("Content-Length").cast("long")
    origin, own = (F.nullif(F.regexp_extract("head", rf"\r\n{n}: <urn:md5:([0-9a-f]+)>", 1), F.lit("")) for n in ("WARC-Segment-Origin-ID", "WARC-Record-ID"))
    http = (kind == "response") & F.startswith("chunk", F.lit(HTTP_HEAD))
    return parts.select(
        kind.alias("record_type"),
        F.coalesce(origin, own).alias("record_id"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("chunk_no"),
        field("X-Page-Id").cast("long").alias("page_id"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"),
        field("X-Payload-Length").cast("long").alias("length"),
        F.nullif(F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)", 1), F.lit("")).alias("digest"),
        F.when(http, length - len(HTTP_HEAD)).otherwise(length).alias("content_length"),
        F.contains("head", F.lit("\r\nWARC-Segment-Number: ")).alias("segmented"),
        F.contains("head", F.lit(f"\r\n{CHUNK_CODING}: base64")).alias("coded"),
        F.when(http, F.substring("chunk", len(HTTP_HEAD) + 1, 2**31 - 1)).otherwise(F.col("chunk")).alias("chunk"),
    )


def checked_records(chunks: DataFrame) -> DataFrame:
    """One row a record, from its chunks in order: bytes and digest as read, and ``problem``, null for a sound record.

    A record in one piece is checked where it was read.  The chunks of segmented records are dealt out by record and sorted; a
    digest is carried from chunk to chunk, so memory holds one batch of chunks however long a record is.  No chunks give no row.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def run(batches):
        now, state, size, number, wrong = None, None, 0, 0, None

        def done():
            if now["record_type"] == "revisit":
                return now["page_id"], now["length"], now["digest"], "revisit", now["refers_to"], wrong
            ended = wrong or (None if state.hexdigest() == now["digest"] else "the digest doesn't agree with the payload, or the end is missing")
            return now["page_id"], size, state.hexdigest(), now["record_type"], None, ended

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if now is None or row["record_id"] != now["record_id"] or row["chunk_no"] == 1:
                    if now is not None:
                        rows.append(done())
                    state, size, number, kind, wrong = hashlib.sha256(), 0, 0, row["record_type"], None
                number += 1
                chunk = (row.pop("chunk") or "").encode()
                if row["chunk_no"] != number or row["content_length"] != len(chunk):
                    wrong = wrong or f"chunk {row['chunk_no']} is out of place or cut short"
                if row["coded"]:
                    chunk = base64.b64decode(chunk)
                state.update(chunk)
                size += len(chunk)
                now = row | {"record_type": kind}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), kinds, strict=True)], names)

    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
    dealt = chunks.where("segmented").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return chunks.where("not segmented").mapInArrow(run, shape).unionAll(dealt.mapInArrow(run, shape))


def verified_records(chunks: DataFrame) -> DataFrame:
    """``checked_records`` that are sound, without ``problem``; the others are ``unsound_records``."""
    return checked_records(chunks).where("problem is null").drop("problem")


def unsound_records(chunks: DataFrame) -> DataFrame:
    """``checked_records`` whose chunks, lengths or digests don't agree."""
    return checked_records(chunks).where("problem is not null")


def op6_warc_records(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written as a WARC record and read back; cases as in ``write_archives``.

    Here a record that doesn't read back whole is an error, as it must not pass for a page.
    """
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    read = checked_records(read_archives(spark, path))
    return read.withColumn("record_type", F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error("problem").cast("string"))).drop("problem")
