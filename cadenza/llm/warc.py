"""WARC archives: write responses, find payloads that repeat, write revisits, read back.

Archives are written by Spark's text writer: a row is one record and the line
separator is the blank lines that end a WARC record, so files are committed by
Spark and a lost executor only repeats its own file. Records that are written
again get ids of their own. Headers are shuffled by
payload digest; payloads never are more than once, on the record id.

Defined cases: a null page is an empty payload; null ids are written as an
empty header and read back as null; rows that repeat are records of their own,
of which the last in (page id, record id) order is the response; an empty table
gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import picked

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a file, about, and records at most; a file is read by one task, record by record.
FILE_BYTES, FILE_RECORDS, HEADER_BYTES = 64 << 20, 20_000, 700
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = "record_id string, record_type string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + END + block.decode()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _uri(url: str | None) -> str:
    return "" if url is None else "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url)


def response(record_id: str, page_id: int | None, uri: str | None, payload: bytes, date: str = DATE, payload_digest: str | None = None) -> str:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(uri)), ("X-Page-Id", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{payload_digest or digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, _http(len(payload)) + payload)


def revisit(record_id: str, page_id: int | None, uri: str | None, size: int, payload_digest: str, refers_to: int | None, refers_to_record: str, refers_to_uri: str | None, date: str = DATE) -> str:
    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(uri)), ("X-Page-Id", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to_record}>"), ("WARC-Refers-To-Target-URI", _uri(refers_to_uri)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", "" if refers_to is None else refers_to), ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, _http(size))


def parse(raw: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (keys in lower case) and block of each record of an archive, by content lengths."""
    while first := raw.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers: dict[str, str] = {}
        while (line := raw.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        yield headers, raw.read(int(headers["content-length"]))
        raw.read(len(END))


def _write(records: DataFrame, path: str, sizes: DataFrame) -> None:
    """Records (value) in files of about FILE_BYTES, given the sizes of all of them."""
    mean = sizes.agg(F.coalesce(F.avg("size"), F.lit(0.0))).first()[0]
    most = int(min(FILE_RECORDS, max(1, FILE_BYTES // (mean + HEADER_BYTES))))
    records.write.option("lineSep", END).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


def fresh(record_id: str) -> str:
    """The id of a record that is written again."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, record_id + '/deduplicated')}"


def write_responses(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """An archive with a response record for each row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for page, url, html in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    out.append(response(f"urn:uuid:{uuid.uuid5(_SPACE, f'{part}/{n}/{page}')}", page, url, (html or "").encode()))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows = picked(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string").alias("html"))
    _write(rows.mapInArrow(build, "value string"), path, rows.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")))


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record; payload is null if payloads is False, and for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    full = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    kind, page, to = h["warc-type"], h.get("x-page-id"), h.get("x-refers-to-page-id")
                    keep = payloads and kind == "response"
                    rows.append((h["warc-record-id"].strip("<>"), kind, int(page) if page else None, h.get("warc-target-uri"), full, h["warc-payload-digest"].removeprefix("sha1:"), int(to) if to else None, h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, payload.decode() if keep else None))
                    size += len(payload) if keep else 0
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """From the archive source, the archive target with a revisit record for each payload that repeats.

    Of records with equal payloads of least_bytes or more, that with the largest
    page id stays a response. Headers are grouped by digest with partial
    aggregation, so that a digest of a third of all pages is a few rows a task.
    """
    headers = read_archive(spark, source, payloads=False).filter(F.col("payload_bytes") >= least_bytes).select("record_id", "page_id", "uri", "payload_digest", "payload_bytes")
    last = F.max(F.struct("page_id", "record_id", "uri")).alias("last")
    originals = headers.groupBy("payload_digest", "payload_bytes").agg(last, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = headers.join(originals, ["payload_digest", "payload_bytes"]).filter("record_id != last.record_id")
    links = again.select("record_id", F.col("last.page_id").alias("to_page"), F.col("last.record_id").alias("to_record"), F.col("last.uri").alias("to_uri"))
    joined = read_archive(spark, source).join(links, "record_id", "left").select("record_id", "page_id", "uri", "payload_bytes", "payload_digest", F.when(F.col("to_record").isNull(), F.col("payload")).alias("payload"), "to_page", "to_record", "to_uri")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = [response(fresh(rid), page, uri, payload.encode(), DATE, sha) if record is None else revisit(fresh(rid), page, uri, size, sha, to, fresh(record), to_uri) for rid, page, uri, size, sha, payload, to, record, to_uri in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    _write(joined.mapInArrow(build, "value string"), target, headers.select(F.col("payload_bytes").alias("size")))
