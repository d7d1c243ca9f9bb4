"""WARC archives with revisit records: capture, revisit resolution, deduplicated archives, reading back.

1. `capture` writes a response record for each page, task by task, and returns an index: one header row a record, with the place of
   its bytes. No page moves between tasks.
2. `resolved` shuffles these headers by payload digest. Of equal payloads of `least` bytes or more the record of the largest id
   stays the response; the others are joined to it and become revisits. A digest that a third of the pages share is summed in each task
   before it is shuffled, and its headers are a skewed side of a merge join, which adaptive execution splits.
3. `deduplicated` sends the headers back to where their records were captured. Each task walks its captured archives in order,
   copies the payloads of responses and leaves out those of revisits, and writes every record with fresh headers.
4. `read` parses archives (these, or others of WARC/1.0 and 1.1, plain or gzip), as streams, and checks payloads against their digests.

So payloads are read and written in place, one after the other, and only headers are shuffled. Archives are rolled at `most_bytes`; each
record is a gzip member of its own. Files get a new name in every attempt of a task, and the index says which of them count: a lost
executor costs a repeated task, and files of lost attempts are removed at the end. Tasks reach the folder through pyarrow's file systems
(local or mounted, HDFS, S3).

Results for odd input: a null body counts as empty; a null id is smaller than every id; rows with the same id and payload are records each for
itself and of the same type; a null or blank url is written as a urn of the id, and line breaks, white space and control characters in a url are
percent-encoded; bodies of any length are single records; an empty table gives no archives and an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm.common import scratch, scratch_folder, written

#: Payloads of fewer bytes are never revisits: their headers would be about as long.
LEAST = 1000
#: An archive is closed at this many bytes.
ARCHIVE_BYTES = 64 << 20

# Names and profile of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"

INDEX = "part int, archive string, number long, offset long, length long, id string, url string, n_bytes long, digest string, record_id string, date string"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
    files.create_dir(path, recursive=True)
    return files, path


def _uri(url: str | None, page: str | None) -> str:
    """A url that fits on a header's line."""
    url = (url or "").strip()
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or f"urn:page:{page}"


def _head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in fields), b"Content-Length: %d" % length, b"", b""]
    return b"\r\n".join(lines)


def _http(length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def _about(row: dict, kind: str) -> list[tuple[str, str]]:
    """The header fields that all records of pages have."""
    own = [("X-Page-ID", row["id"])] if row["id"] is not None else []
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    return [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", _uri(row["url"], row["id"])), ("WARC-Payload-Digest", f"sha1:{digest}"), *own]


class _Writer:
    """Archives in a folder, each closed at about `most_bytes`."""

    def __init__(self, folder: str, most_bytes: int, level: int):
        self.files, self.path = _opened(folder)
        self.most_bytes, self.level = most_bytes, level
        self.name, self.stream, self.offset = "", None, 0

    def add(self, head: bytes, block: bytes) -> tuple[str, int, int]:
        """Where the record went: archive, offset, length."""
        if self.stream is None or self.offset >= self.most_bytes:
            self.close()
            self.name, self.offset = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.files.open_output_stream(f"{self.path}/{self.name}", compression=None)
            now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            about = b"format: WARC File Format 1.1\r\n"
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", now), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(_head(info, len(about)), about)
        return self.name, *self._put(head, block)

    def _put(self, head: bytes, block: bytes) -> tuple[int, int]:
        member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = b"".join((member.compress(head), member.compress(block), member.compress(b"\r\n\r\n"), member.flush()))
        self.stream.write(data)
        self.offset += len(data)
        return self.offset - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, in order: header fields (names in lower case) and block. A record that is cut short is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins here: {line[:40]!r}")
        fields, last = {}, ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:  # a folded line
                fields[last] += " " + line.decode().strip()
            else:
                name, _, value = line.decode().partition(":")
                last = name.strip().lower()
                fields[last] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends inside a record")
        yield fields, block


def payload(fields: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of a response; else the whole block."""
    if fields.get("content-type", "").replace(" ", "") == HTTP and b"\r\n\r\n" in block:
        return block[block.index(b"\r\n\r\n") + 4 :]
    return block


def capture(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a response record for each row; returns the index (columns INDEX). Run it once: write the result out."""
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, _Writer(folder, most_bytes, 1)
        for batch in batches:
            rows = []
            for page, url, body in zip(*(batch.column(c) for c in ("id", "url", "body")), strict=True):
                body = body.as_py() or b""
                row = {"part": part, "number": number, "id": page.as_py(), "url": url.as_py(), "n_bytes": len(body), "digest": hashlib.sha1(body).hexdigest(), "record_id": f"<{uuid.uuid4().urn}>", "date": date}
                http = _http(len(body))
                head = _head([*_about(row, "response"), ("Content-Type", HTTP)], len(http) + len(body))
                row["archive"], row["offset"], row["length"] = out.add(head, http + body)
                rows.append(row)
                number += 1
            yield pa.RecordBatch.from_pylist(rows, _INDEX)
        out.close()

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("binary").alias("body")).mapInArrow(run, INDEX)


_INDEX = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[kind]) for name, kind in (c.split() for c in INDEX.split(", "))])


def resolved(index: DataFrame, id_type: str = "bigint", least: int = LEAST) -> DataFrame:
    """`index` with original: id, record_id, url and date of the record that this one revisits, null for responses."""
    order = F.struct(F.col("id").cast(id_type).alias("by"), "record_id", "id", "url", "date")
    originals = index.where(F.col("n_bytes") >= least).groupBy(F.col("digest").alias("of")).agg(F.max(order).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = index.join(originals.hint("merge"), (F.col("digest") == F.col("of")) & (F.col("n_bytes") >= least), "left")
    own = F.col("original").isNull() | F.col("original.id").eqNullSafe(F.col("id"))
    return found.select(*index.columns, F.when(~own, F.struct("original.id", "original.record_id", "original.url", "original.date")).alias("original"))


def deduplicated(decided: DataFrame, captured: str, folder: str, parts: int, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of `resolved` to `folder`; returns archive and number of records of each archive that counts. Run it once.

    `parts` is the number of tasks that captured. Each record has a fresh header: responses keep id and date of their capture, revisits name the response they refer to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(captured)
        out, held, source, counts = _Writer(folder, most_bytes, 6), "", None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["original"] is None:
                    if row["archive"] != held:
                        held = row["archive"]
                        if source is not None:
                            source.close()
                        source = files.open_input_file(f"{path}/{held}")
                    stream = io.BytesIO(zlib.decompress(source.read_at(row["length"], row["offset"]), 31))
                    _, block = next(records(stream))
                    fields = [*_about(row, "response"), ("Content-Type", HTTP)]
                else:
                    first, block = row["original"], _http(row["n_bytes"])
                    refers = [("WARC-Refers-To", first["record_id"]), ("WARC-Refers-To-Target-URI", _uri(first["url"], first["id"])), ("WARC-Refers-To-Date", first["date"])]
                    fields = [*_about(row, "revisit"), ("WARC-Profile", PROFILE), *refers, ("Content-Type", HTTP)]
                archive, _, _ = out.add(_head(fields, len(block)), block)
                counts[archive] = counts.get(archive, 0) + 1
        out.close()
        if source is not None:
            source.close()
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["archive", "n_records"])

    dealt = decided.repartitionById(parts, F.col("part")).sortWithinPartitions("archive", "number")
    return dealt.mapInArrow(run, "archive string, n_records long")


RECORDS = "archive string, record_id string, record_type string, id string, url string, digest string, n_bytes long, refers_to string"


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives in `folder` (columns RECORDS, and payload if asked for), without those that are about archives.

    n_bytes is null for revisits, whose payload is elsewhere; digest is lower-case hex. A response whose payload differs from its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column("path").to_pylist():
                files, path = fs.FileSystem.from_uri(where.replace("s3a://", "s3://"))
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)
                    for fields, block in records(stream):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit", "resource"):
                            continue
                        body = payload(fields, block)
                        told = fields.get("warc-payload-digest", "")
                        told = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else ""
                        here = told if kind == "revisit" else hashlib.sha1(body).hexdigest()
                        if told and here != told:
                            raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
                        row = {"archive": where, "record_id": fields.get("warc-record-id"), "record_type": kind, "id": fields.get("x-page-id"), "url": fields.get("warc-target-uri"), "digest": here, "refers_to": fields.get("warc-refers-to")}
                        row["n_bytes"] = None if kind == "revisit" else len(body)
                        if with_payload:
                            row["payload"] = None if kind == "revisit" else body
                        rows.append(row)
                        size += with_payload * len(body)
                        if len(rows) == 10_000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([(name, {"string": pa.string(), "long": pa.int64()}[kind]) for name, kind in (c.split() for c in RECORDS.split(", "))] + ([("payload", pa.binary())] if with_payload else []))
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
    return paths.mapInArrow(run, RECORDS + (", payload binary" if with_payload else ""))


def _without(spark: SparkSession, folder: str, counting: set[str]) -> None:
    """Removes files of lost attempts: those whose name the index does not have."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(where) if files.exists(where) else ():
        if status.getPath().getName() not in counting:
            files.delete(status.getPath(), True)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST, most_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes deduplicated archives of `pages` to `folder`, which must be new or empty; returns how many. The driver sees one name an archive."""
    spark = pages.sparkSession
    with scratch(spark):
        captured = scratch_folder(spark, "captured")
        index = written(capture(pages, captured, id_col, url_col, body_col, most_bytes), "headers")
        parts = index.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0] + 1
        if not parts:
            return 0
        decided = resolved(index, dict(pages.dtypes)[id_col], least)
        archives = written(deduplicated(decided, captured, folder, parts, most_bytes), "archives").collect()
        _without(spark, folder, {r["archive"] for r in archives})
        return len(archives)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes archives, reads them back and resolves revisits: id, payload_bytes, payload_digest, record_type, refers_to (an id).

    The archives are scratch here; `write` and `read` are for those that stay.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    with scratch(spark):
        folder = scratch_folder(spark, "archives")
        if not write(pages, folder, id_col, url_col, body_col, least):
            return spark.createDataFrame([], f"`{id_col}` {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
        found = written(read(spark, folder), "records")
        originals = found.where("record_type = 'response'").select(F.col("record_id").alias("of"), F.col("id").alias("first_id"), F.col("n_bytes").alias("first_bytes"))
        both = found.join(originals.hint("merge"), (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("of")), "left")
        rows = both.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_bytes", "first_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("first_id").cast(kind).alias("refers_to"))
        return written(rows, "round_trip", keep=True)


ORACLE = """
WITH t AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), u AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_id FROM t
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last_id IS NULL OR page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM u
"""
