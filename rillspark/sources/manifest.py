"""Files as rows: manifests with digests, and evidence of what was expected, found, changed or missing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this size are read as one value; larger ones are read by the tasks as streams.
WHOLE_BYTES = 64 << 20
STREAM_BYTES = 4 << 20


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of large files, a few megabytes at a time."""
    for batch in batches:
        digests = []
        for where in batch.column("path").to_pylist():
            files, path = fs.FileSystem.from_uri(where.replace("s3a://", "s3://"))
            digest = hashlib.sha256()
            with files.open_input_stream(path, compression=None) as stream:
                while part := stream.read(STREAM_BYTES):
                    digest.update(part)
            digests.append(digest.hexdigest())
        yield pa.record_batch([batch.column("path"), batch.column("bytes"), pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])


def manifest(spark: SparkSession, folder: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A row for each file under a folder: path (below the folder), bytes, sha256. Names that begin with _ or . are not read, and
    empty files are not there for Spark's file sources, so they count as missing.

    Files are spread over tasks by their sizes. Small ones are digested from their content as Spark reads it; large ones by streams, so that no
    task holds a large file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    small = files.where(F.col("length") <= whole_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select("path", F.col("length").alias("bytes")).mapInArrow(_streamed, "path string, bytes long, sha256 string")
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.element_at(F.split(F.col("path"), f"\\Q/{root}/\\E", 2), -1)
    return small.unionByName(large).withColumn("path", below)


def evidence(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Outcome of each file that is expected or found: PRESENT, CHANGED (with what differs), MISSING or EXTRA.

    expected: path, bytes, sha256; where its bytes or digest are null, the file only has to be there.
    """
    f = found.select(F.col("path").alias("f_path"), F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha256"))
    both = expected.hint("merge").join(f, F.col("path") == F.col("f_path"), "full")
    size, digest = F.col("bytes") != F.col("f_bytes"), F.col("sha256") != F.col("f_sha256")
    outcome = F.when(F.col("f_path").isNull(), "MISSING").when(F.col("path").isNull(), "EXTRA").when(F.coalesce(size, F.lit(False)) | F.coalesce(digest, F.lit(False)), "CHANGED").otherwise("PRESENT")
    why = F.when(F.col("f_path").isNull(), "not found").when(F.col("path").isNull(), "not expected").when(size, "other size").when(digest, "other digest")
    return both.select(F.coalesce("path", "f_path").alias("path"), outcome.alias("outcome"), F.col("f_bytes").alias("bytes"), F.col("f_sha256").alias("sha256"), why.alias("reason"))


def evidence_summary(rows: DataFrame) -> DataFrame:
    """One row: how many files of each outcome, bytes found, and whether the set is as expected (nothing missing or changed)."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    found = rows.agg(*(n(x).alias(x.lower()) for x in ("PRESENT", "CHANGED", "MISSING", "EXTRA")), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return found.withColumn("accepted", (F.col("changed") == 0) & (F.col("missing") == 0))
