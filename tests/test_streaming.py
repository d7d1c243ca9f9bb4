"""Streams over small files, driven to their end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rillspark.streaming import telemetry

T0 = dt.datetime(2024, 1, 1)


def observations(spark, folder):
    rows = [(k, k % 3, T0 + dt.timedelta(minutes=4 * k), "RAIN_RATE_MMH", float(k % 7)) for k in range(60)]
    spark.createDataFrame(rows + rows[:10], telemetry.TELEMETRY).coalesce(1).write.parquet(folder)
    return rows


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return df.sparkSession.table(name)


def test_repeats_and_intervals(spark, tmp_path):
    rows = observations(spark, str(tmp_path / "in"))
    assert drained(telemetry.without_repeats(telemetry.ingest(spark, str(tmp_path / "in"))), "once").count() == len(rows)
    found = drained(telemetry.intervals(telemetry.ingest(spark, str(tmp_path / "in"))), "intervals", "append").collect()
    assert found and all(r.valid_to - r.valid_from == dt.timedelta(minutes=15) for r in found)


def test_latest(spark, tmp_path):
    rows = observations(spark, str(tmp_path / "in"))
    found = drained(telemetry.latest(telemetry.ingest(spark, str(tmp_path / "in"))), "latest", "update").groupBy("sensor_id").agg(F.max("obs_id").alias("id")).collect()
    assert {r.sensor_id: r.id for r in found} == {s: max(k for k, x, *_ in rows if x == s) for s in range(3)}


def test_parsed_messages(spark):
    found = telemetry.parsed(spark.createDataFrame([('{"obs_id": 1, "sensor_id": 2, "observation_time": "2024-01-01T00:00:00", "raw_value": 3.5}',), ("junk",), (None,)], "value string"))
    assert [(r.obs_id, r.raw_value) for r in found.collect()] == [(1, 3.5)]


def test_alert_ledger(spark):
    events = spark.createDataFrame([("a", "issue", 1), ("b", "issue", 2), ("a", "cancel", 3), ("a", "cancel", 4), ("c", "cancel", 5)], "alert_id string, action string, at int")
    assert sorted(tuple(r) for r in telemetry.alerts(events).collect()) == [("a", 1, False), ("a-CANCEL", 3, False), ("b", 2, True)]


def test_screened_batches(spark):
    limits = spark.createDataFrame([("RAIN_RATE_MMH", 5.0)], "product_type string, alert_mmh double")
    seen = []
    batch = spark.createDataFrame([(1, 1, T0, "RAIN_RATE_MMH", 9.0), (2, 1, T0, "RAIN_RATE_MMH", 1.0)], telemetry.TELEMETRY)
    telemetry.screened(limits, lambda df, n: seen.extend(r.obs_id for r in df.collect()))(batch, 0)
    assert seen == [1]
