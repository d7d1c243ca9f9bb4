"""Streams of gauge observations: ingest, intervals, late data, duplicates, latest values, alerts.

Each function takes and gives a streaming (or batch) DataFrame; the caller starts the query. State is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.operators import gauges

#: Observations older than this, against the newest seen, are dropped.
LATE = "120 minutes"

TELEMETRY = "obs_id long, sensor_id long, observation_time timestamp, product_type string, raw_value double"


def ingest(spark: SparkSession, folder: str, kind: str = "parquet", files_a_batch: int = 8) -> DataFrame:
    """Observations as they arrive as files in a folder (Parquet or JSON)."""
    return spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", files_a_batch).format(kind).load(folder)


def parsed(messages: DataFrame, column: str = "value") -> DataFrame:
    """Observations from JSON messages (of a message queue, for instance); what cannot be read gives no row."""
    return messages.select(F.from_json(F.col(column).cast("string"), TELEMETRY).alias("o")).where("o.obs_id IS NOT NULL AND o.observation_time IS NOT NULL").select("o.*")


def fresh(observations: DataFrame) -> DataFrame:
    """With a watermark, so that what is beyond the stale limit is dropped by stateful operators."""
    return observations.withWatermark("observation_time", LATE)


def without_repeats(observations: DataFrame) -> DataFrame:
    """Each observation once; identities are forgotten when the watermark has passed them."""
    return fresh(observations).dropDuplicatesWithinWatermark(["obs_id"])


def intervals(observations: DataFrame, minutes: int = 15) -> DataFrame:
    """Mean rate and depth per sensor and half-open interval; an interval is emitted when it can no longer change."""
    rates = gauges.standardised(fresh(observations)).where("rate_mmh IS NOT NULL")
    found = rates.groupBy("sensor_id", F.window("observation_time", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("rate_mmh").alias("rate_mmh"))
    return found.select("sensor_id", F.col("w.start").alias("valid_from"), F.col("w.end").alias("valid_to"), "n", "rate_mmh", (F.col("rate_mmh") * minutes / 60.0).alias("depth_mm"))


def latest(observations: DataFrame) -> DataFrame:
    """The newest observation of each sensor whenever it changes (update mode); of equal times, the one of the larger id."""
    newest = F.max(F.struct("observation_time", "obs_id", "raw_value")).alias("o")
    return observations.groupBy("sensor_id").agg(newest).select("sensor_id", "o.*")


def alerts(events: DataFrame) -> DataFrame:
    """Batch view of an alert ledger: every alert with whether it is active, and for each first cancel a record `<id>-CANCEL`.

    events: alert_id, action (issue or cancel), at. A cancel without an issue, or a second one, changes nothing.
    """
    issued = events.where("action = 'issue'").groupBy("alert_id").agg(F.min("at").alias("issued_at"))
    cancelled = events.where("action = 'cancel'").groupBy("alert_id").agg(F.min("at").alias("cancelled_at"))
    both = issued.join(cancelled, "alert_id", "left")
    own = both.select("alert_id", F.col("issued_at").alias("at"), F.col("cancelled_at").isNull().alias("active"))
    return own.unionByName(both.where("cancelled_at IS NOT NULL").select(F.concat("alert_id", F.lit("-CANCEL")).alias("alert_id"), F.col("cancelled_at").alias("at"), F.lit(False).alias("active")))


def screened(limits: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: joins each batch with static limits (product_type, alert_mmh) and hands what exceeds them to `sink`."""

    def each(batch: DataFrame, number: int) -> None:
        rates = gauges.standardised(batch)
        sink(rates.join(F.broadcast(limits), "product_type").where("rate_mmh >= alert_mmh").select("obs_id", "sensor_id", "observation_time", "rate_mmh"), number)

    return each
