"""Shared pieces: tables written to the shared folder, and Arrow helpers."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may do without (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one stage at most, and gives later joins true sizes. Inside `scratch`, the table
    is removed at the end, unless `keep`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillspark-{name}-{uuid.uuid4().hex}"
    open_scope = _SCRATCH.get()
    if open_scope is not None and not keep:
        open_scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the open `scratch`."""
    path = f"{shared_dir(spark)}/rillspark-{name}-{uuid.uuid4().hex}"
    open_scope = _SCRATCH.get()
    if open_scope is not None:
        open_scope.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what is returned from inside must be written with `keep`."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hash of `key` (all, if fewer), the same however the rows are partitioned.

    A first filter by the hash leaves little more than `most` rows in all, so that the final top-k does not gather `most` rows
    from every task. Should the filter leave too few, by an odd chance, it is left out.
    """
    n, spread = df.count(), F.pmod(F.xxhash64(key), F.lit(1 << 32))
    few = df.where(spread < int((1 << 32) * min(1.0, (1.2 * most + 200) / max(n, 1))))
    if n > most and few.count() < most:
        few = df
    return few.orderBy(spread, F.xxhash64(key), key).limit(most)


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(ends):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most_bytes` of text at most (one row at least), so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(byte_column(batch.column(text))[1])
        block = np.cumsum(sizes) // most_bytes
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
