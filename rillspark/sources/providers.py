"""Providers of observations: one interface for many sources, and a source that reads drops of files as they come.

A provider says who it is and gives a DataFrame; `Providers` asks all of them at once: the newest observation of each, that nearest to a time, and their
health are single queries over the union. None stands in for another, and an observation that is not of the wanted time says so.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from rillspark.operators import gauges

#: What a provider gives.
OBSERVATIONS = "obs_id long, observation_time timestamp, product_type string, raw_value double"
# What a provider's data are.
SOURCE_TYPES = ("REAL", "SYNTHETIC", "FIXTURE")


@dataclasses.dataclass(frozen=True)
class Provider:
    """A source of observations (columns OBSERVATIONS), batch or stream."""

    provider_id: str
    source_type: str
    source_name: str
    load: Callable[[SparkSession], DataFrame]
    minutes: int = 15

    def __post_init__(self) -> None:
        if self.source_type not in SOURCE_TYPES:
            raise ValueError(f"{self.source_type} is not one of {', '.join(SOURCE_TYPES)}")


class Providers:
    """The providers of a job, by id."""

    def __init__(self, *providers: Provider):
        self._by_id: dict[str, Provider] = {}
        for p in providers:
            self.register(p)

    def register(self, provider: Provider) -> None:
        if provider.provider_id in self._by_id:
            raise ValueError(f"there is a provider {provider.provider_id} already")
        self._by_id[provider.provider_id] = provider

    def chosen(self, *ids: str) -> list[Provider]:
        """Those of the ids (all, if none are given); an unknown one is an error."""
        unknown = [i for i in ids if i not in self._by_id]
        if unknown:
            raise KeyError(f"unknown providers: {', '.join(unknown)}")
        return [self._by_id[i] for i in ids or sorted(self._by_id)]

    def observations(self, spark: SparkSession, *ids: str) -> DataFrame:
        """provider_id, source_type and the observations of the providers, one below the other."""
        names = [c.split()[0] for c in OBSERVATIONS.split(", ")]
        parts = [p.load(spark).select(F.lit(p.provider_id).alias("provider_id"), F.lit(p.source_type).alias("source_type"), *names) for p in self.chosen(*ids)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def latest(self, spark: SparkSession, *ids: str) -> DataFrame:
        """The newest observation of each provider; one without any has no row. Observations without a time are left out."""
        return gauges.latest(self.observations(spark, *ids).where("observation_time IS NOT NULL"), "provider_id")

    def at_time(self, spark: SparkSession, times: DataFrame, *ids: str) -> DataFrame:
        """provider_id, t, obs_id, gap_seconds, fallback: for each time (column t) the nearest observation of each provider within its minutes, else its newest (fallback)."""
        found = None
        for p in self.chosen(*ids):
            named = p.load(spark).where("observation_time IS NOT NULL").select(F.lit(p.provider_id).alias("sensor_id"), "obs_id", "observation_time")
            part = gauges.nearest_in_time(times.select(F.lit(p.provider_id).alias("sensor_id"), "t"), named, p.minutes).withColumnRenamed("sensor_id", "provider_id")
            found = part if found is None else found.unionByName(part)
        return found

    def health(self, spark: SparkSession, now: Column, *ids: str) -> DataFrame:
        """provider_id, source_name, observations, last_observation, status, message; a provider without observations is UNCONFIGURED."""
        known = spark.createDataFrame([(p.provider_id, p.source_name) for p in self.chosen(*ids)], "provider_id string, source_name string")
        listed = known.select("provider_id").withColumns({"observation_time": F.lit(None).cast("timestamp")})
        every = self.observations(spark, *ids).select("provider_id", "observation_time").unionByName(listed)
        return gauges.health(every, now, "provider_id").join(F.broadcast(known), "provider_id")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _listed(folder: str) -> list[str]:
    files, path = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _rows(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    """The observations of a file of JSON lines; a line that is none is left out."""
    files, path = fs.FileSystem.from_uri(folder)
    kinds = pa.schema([("obs_id", pa.int64()), ("observation_time", pa.timestamp("us", "UTC")), ("product_type", pa.string()), ("raw_value", pa.float64())])
    held: list[dict] = []
    with files.open_input_stream(f"{path}/{name}") as lines:
        rest = b""
        while True:
            block = lines.read(1 << 20)
            *whole, rest = (rest + block).split(b"\n") if block else [rest, b""]
            for line in whole:
                try:
                    o = json.loads(line)
                    at = dt.datetime.fromisoformat(o["observation_time"])
                    value = o.get("raw_value")
                    held.append({"obs_id": int(o["obs_id"]), "observation_time": at if at.tzinfo else at.replace(tzinfo=dt.UTC), "product_type": str(o["product_type"]), "raw_value": None if value is None else float(value)})
                except (ValueError, KeyError, TypeError):
                    continue
            if len(held) >= 10_000 or (held and not block):
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
            if not block:
                return


class _DropReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(n) for n in _listed(self.folder)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # there is one without a file if there are no files
            yield from _rows(self.folder, partition.path)


class _DropStreamReader(DataSourceStreamReader):
    """An offset is the name of the last file; files come in order of their names."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"last": max(_listed(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_File(n) for n in _listed(self.folder) if start["last"] < n <= end["last"]]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # there is one without a file if there are no files
            yield from _rows(self.folder, partition.path)


class ObservationDrops(DataSource):
    """Format `observation_drops`: a folder (option path) of files of JSON lines, read whole or as a stream; each file is a task.

    The folder is reached through pyarrow's file systems. A stream takes files in order of their names, so a new file must have a later name than all before it.
    """

    @classmethod
    def name(cls) -> str:
        return "observation_drops"

    def schema(self) -> str:
        return OBSERVATIONS

    def reader(self, schema) -> DataSourceReader:
        return _DropReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _DropStreamReader(self.options["path"])


def drops(spark: SparkSession, folder: str) -> DataFrame:
    """The observations of a folder of drops."""
    spark.dataSource.register(ObservationDrops)
    return spark.read.format("observation_drops").option("path", folder).load()


def drop_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(ObservationDrops)
    return spark.readStream.format("observation_drops").option("path", folder).load()
