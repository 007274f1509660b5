"""WARC archives as a PySpark data source, ``format("warc")``: reading and writing.

Reading plans partitions of whole files by size, takes equality predicates on the record type and
on headers, parses a record's headers first and seeks past payloads that nobody asked for. Payloads
are stored as HTTP responses with gzip content encoding. Files are reached through pyarrow's file
systems, so any store that it knows can hold them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import materialize, scratch_path, small, small_batches

SCHEMA = "page_id long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary, digest_ok boolean"
#: Column -> header by which its predicates are pushed down.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}
#: Bytes of an archive before the next begins, bytes of a read partition, records of a batch.
ROLL, SPLIT, ROWS = 64 << 20, 128 << 20, 200
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value without line breaks."""
    return " ".join(value.split("\r\n")).replace("\n", " ").replace("\r", " ")


def record(page_id: int | None, url: str | None, payload: bytes | None, kind: str, refers_to: int | None) -> bytes:
    """A record: a response holds its payload, a revisit only the length and digest of the one that it refers to."""
    payload = payload or b""
    body = gzip.compress(payload, 6, mtime=0) if kind == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\nX-Payload-Length: {len(payload)}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {one_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in lines}


def page_of(value: str | None) -> int | None:
    digits = (value or "").strip("<>").removeprefix(URN)
    return int(digits) if digits.lstrip("-").isdigit() else None


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = file_system(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True)) if f.is_file and f.path.endswith(".warc"))
        parts, held = [], SPLIT
        for path, size in found:
            if held + size > SPLIT:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(path)
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows: list[tuple] = []
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                stream = io.BufferedReader(raw, 1 << 20)
                for row in self.records(stream):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield self.batch(rows)
                        rows = []
        if rows:
            yield self.batch(rows)

    def records(self, stream) -> Iterator[tuple]:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = [line]
            while (line := stream.readline()) not in (b"\r\n", b""):
                head.append(line)
            h = headers(b"".join(head))
            values = {c: h.get(k) for c, k in HEADERS.items()}
            values["payload_digest"] = (values["payload_digest"] or "").removeprefix("sha1:") or None
            length = int(h.get("content-length", 0))
            if any(values[c] not in some for c, some in self.wanted):
                stream.seek(length, 1)
                continue
            http, used = [], 0
            while used < length:
                line = stream.readline()
                used += len(line)
                if line in (b"\r\n", b""):
                    break
                http.append(line)
            inner = headers(b"".join(http))
            payload = ok = None
            if self.payload and values["record_type"] == "response":
                payload = stream.read(length - used)
                if inner.get("content-encoding") == "gzip":
                    payload = gzip.decompress(payload)
                ok = sha1_base32(payload) == values["payload_digest"]
            else:
                stream.seek(length - used, 1)
            size = inner.get("x-payload-length", inner.get("content-length"))
            yield page_of(values["record_id"]), values["record_id"], values["record_type"], values["target_uri"], values["payload_digest"], int(size) if size else None, page_of(h.get("warc-refers-to")), payload, ok

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class WarcWriter(DataSourceArrowWriter):
    """Columns page_id, url, payload, record_type, refers_to. Files appear in the folder once all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        folder = f"{root}/{self.staging}"
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                    if out is None or size >= ROLL:
                        if out:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc")
                        out, size = fs.open_output_stream(f"{folder}/{files[-1]}"), 0
                    data = record(*row)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.is_file:
                    fs.delete_file(f.path)
        for name in (n for m in messages if m for n in m.files):
            fs.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class WarcDataSource(DataSource):
    """Options: ``path``; ``payload`` (default true): whether payloads are read and held against their digests."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def planned(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response and the
    others revisit it; a row without an id revisits too, and all are responses if none has an id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("payload", 256)))
    copied = rows.filter(F.octet_length("payload") >= least).groupBy("_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("_digest", "first")
    rows = rows.join(small(materialize(copied, "copied"), 100_000), "_digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"))


def archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each row of ``pages`` to WARC files in the folder ``path``; null html is an empty payload."""
    register(pages.sparkSession)
    small_batches(pages.sparkSession, 500)
    planned(pages, least).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok) as read back from archives of ``pages``."""
    path = scratch_path(pages.sparkSession, "warc")
    archive(pages, path, least)
    return read_archive(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


#: The op9 query in DuckDB's SQL: SHA-1 in hex, five digits of which give four of base 32.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT // [32768, 1024, 32, 1][1 + i % 4]) % 32)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN first END AS refers_to, TRUE AS digest_ok FROM h
"""
