"""Tables written to the folder that the driver and all executors share, broadcasts of a checked size, and tiles for windows."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast after its size was checked.
MOST_BROADCAST = 100_000
#: Cells of a tile along a line of cells.
TILE = 512


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local session may leave that unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


def buckets(spark: SparkSession) -> int:
    """Buckets of tables whose rows of the same key lie side by side: as many as a shuffle has partitions, so that joins with what was shuffled by the key move neither."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame, name: str, *by: str) -> DataFrame:
    """`df`, written to the shared folder and read back: iterations keep a short lineage. Rows of the same `by` go to one bucket, so that joins and groups by it need no shuffle."""
    spark, table = df.sparkSession, f"rillspark_{name}_{uuid.uuid4().hex}"
    if by:
        found = added(df, table, *by)
        spark.sql(f"DROP TABLE {table}")  # only the name: the files stay until `dropped`
        return found
    path = f"{shared_root(spark)}/{table}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def added(df: DataFrame, table: str, *by: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """`df`, added to a table of the shared folder in buckets of `by` (and folders of some columns), and all that the table then has. One table, as a union of several would lose its buckets."""
    spark = df.sparkSession
    writer = df.write.mode("append")
    writer = writer.partitionBy(*folders) if folders else writer
    writer.bucketBy(buckets(spark), *by).option("path", f"{shared_root(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def dropped(*tables: DataFrame) -> None:
    """Removes tables written by `settled` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows, else with one for a product dealt over all tasks."""
    few = df.limit(most + 1).count() <= most
    return F.broadcast(df) if few else df.hint("shuffle_replicate_nl")


def looked_up(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Each of `rows` with all rows of `found` of the same keys (null equals null); a row without any is left out.

    What is found for a key travels as one array, so that many rows of the same key are moved and matched once each, and unfolded last.
    """
    names = [f"_{k}" for k in keys]
    packed = found.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.collect_list(F.struct(*(c for c in found.columns if c not in keys))).alias("_found"))
    met = rows.join(packed.hint("merge"), reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True))))
    return met.select(*rows.columns, F.inline("_found"))


def tiled(cells: DataFrame, place: str, halo: int, size: int = TILE) -> DataFrame:
    """Cells dealt into tiles of `size` along `place`, each with `halo` cells of its neighbours (own is false), so that a window needs one tile only."""
    own = F.floor(F.col(place) / size)
    near = F.array_distinct(F.array(own, F.floor((F.col(place) - halo) / size), F.floor((F.col(place) + halo) / size)))
    return cells.withColumn("tile", F.explode(near)).withColumn("own", F.col("tile") == own)
