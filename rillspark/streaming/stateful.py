"""Streams with state of their own: storm motion from frame to frame, the life cycle of alerts, screening of frames, ages of observations.

Each function takes and gives a streaming DataFrame; the caller starts the query. State needs the RocksDB provider (`prepared`). Events may
come late, twice and out of order: they are put in order by event time before they act, and act when the watermark has passed them, so the result
does not depend on how they arrived, and a query that restarts from its checkpoint goes on where it was. What is behind the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rillspark.operators import roads
from rillspark.operators.gauges import FRESH, STALE

#: How long a radar's last frame, and an alert, are remembered (event time).
FRAME_HOURS, ALERT_HOURS = 3, 48
# m/s along columns and rows if either frame is dry, and the sum of rates that makes a frame wet.
DRY_U, DRY_V, WET = 3.0, 2.0, 1.0

FRAMES = "radar_id string, frame_time timestamp, r int, c int, rate_mmh double"
MOTION = "radar_id string, from_time timestamp, to_time timestamp, u_mps double, v_mps double"
EVENTS = "alert_id string, action string, at timestamp, headline string, reason string"
LEDGER = "record_id string, alert_id string, kind string, at timestamp, active boolean, refers_to string, headline string, description string"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _millis(micros: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-micros // 1000)


class FrameMotion(StatefulProcessor):
    """Per radar: the time, mass and centre of its last frame; each later frame gives the motion between the two."""

    def __init__(self, cell_m: float):
        self.cell_m = cell_m

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, mass double, cx double, cy double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802,N803  names of the interface
        before = self.last.get()
        for row in sorted(rows, key=lambda r: r.at):
            if before is not None and row.at > before[0]:
                at, mass, cx, cy = before
                wet = mass > WET and row.mass > WET
                seconds = max((row.at - at) / 1e6, 1.0)
                u, v = ((row.cx - cx) * self.cell_m / seconds, (row.cy - cy) * self.cell_m / seconds) if wet else (DRY_U, DRY_V)
                yield Row(radar_id=key[0], from_us=at, to_us=row.at, u_mps=float(u), v_mps=float(v))
            if before is None or row.at > before[0]:
                before = (row.at, row.mass, row.cx, row.cy)
        self.last.update(before)
        self.handle.registerTimer(_millis(before[0]) + FRAME_HOURS * 3_600_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802,N803
        last = self.last.get()
        if last is not None and _millis(last[0]) + FRAME_HOURS * 3_600_000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def storm_motions(cells: DataFrame, cell_m: float = 30.0, late: str = "30 minutes") -> DataFrame:
    """Motion of the storm's centre between consecutive frames of each radar (columns MOTION), from a stream of cells (columns FRAMES).

    A frame is summed up as its cells come, and counts when the watermark has passed it; so frames reach the state in order of time. Motion is that of
    `nowcast.storm_motion`; after FRAME_HOURS without a frame the last one is forgotten.
    """
    rate, wet = F.coalesce("rate_mmh", F.lit(0.0)), F.sum(F.coalesce("rate_mmh", F.lit(0.0)))
    sums = cells.withWatermark("frame_time", late).groupBy("radar_id", "frame_time").agg(wet.alias("mass"), F.sum(F.col("c") * rate).alias("sc"), F.sum(F.col("r") * rate).alias("sr"))
    centre = lambda c: F.when(F.col("mass") > 0, F.col(c) / F.col("mass")).otherwise(0.0)
    frames = sums.select("radar_id", "frame_time", F.unix_micros("frame_time").alias("at"), "mass", centre("sc").alias("cx"), centre("sr").alias("cy"))
    found = frames.groupBy("radar_id").transformWithState(FrameMotion(cell_m), "radar_id string, from_us long, to_us long, u_mps double, v_mps double", "append", "eventTime")
    return found.select("radar_id", F.timestamp_micros("from_us").alias("from_time"), F.timestamp_micros("to_us").alias("to_time"), "u_mps", "v_mps")


class AlertLedger(StatefulProcessor):
    """Per alert: events that wait for the watermark, and what the alert is now. Issue, then one cancel; anything else changes nothing."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, action string, headline string, reason string")
        self.now = handle.getValueState("now", "issued long, active boolean, headline string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802,N803
        for r in rows:
            x = (r.at_us, r.action, r.headline, r.reason)
            self.waiting.appendValue(x)
            self.handle.registerTimer(_millis(x[0]) + 1)
        yield from ()

    def _acted(self, alert: str, event: tuple) -> Iterator[Row]:
        at, action, headline, reason = event
        now = self.now.get()
        if action == "issue" and now is None:
            self.now.update((at, True, headline))
            self.handle.registerTimer(_millis(at) + ALERT_HOURS * 3_600_000)
            yield Row(record_id=f"REC-{alert}", alert_id=alert, kind="Alert", at_us=at, active=True, refers_to=None, headline=headline, description=None)
        elif action == "cancel" and now is not None and now[1]:
            issued, _, first = now
            self.now.update((issued, False, first))
            # what was active is shown again, inactive; the notice of its end refers to it
            yield Row(record_id=f"REC-{alert}", alert_id=alert, kind="Alert", at_us=at, active=False, refers_to=None, headline=first, description=None)
            yield Row(record_id=f"REC-{alert}-CANCEL", alert_id=f"{alert}-CANCEL", kind="Cancel", at_us=at, active=False, refers_to=alert, headline=f"CANCELLED: {first}", description=reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802,N803
        passed = expiredTimerInfo.getExpiryTimeInMs()
        events = list(self.waiting.get())
        due = sorted((tuple(e) for e in events if _millis(e[0]) + 1 <= passed), key=lambda e: (e[0], e[1] != "issue", e[2] or "", e[3] or ""))
        rest = [tuple(e) for e in events if _millis(e[0]) + 1 > passed]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            for event in due:
                yield from self._acted(key[0], event)
        now = self.now.get()
        if now is not None and _millis(now[0]) + ALERT_HOURS * 3_600_000 <= passed:
            self.now.clear()

    def close(self) -> None:
        pass


def alert_ledger(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Records of an alert ledger (columns LEDGER) from a stream of events (columns EVENTS; action is issue or cancel).

    An issue gives a record; the first cancel after it gives the record once more, inactive, and a notice `<id>-CANCEL`. A cancel before its issue, a second cancel and a second issue
    give nothing. Of equal times the issue comes first. ALERT_HOURS after its issue an alert is forgotten: a cancel then gives nothing. Events without id or time are left out.
    """
    timed = events.where("alert_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    found = timed.withColumn("at_us", F.unix_micros("at")).groupBy("alert_id").transformWithState(AlertLedger(), LEDGER.replace("at timestamp", "at_us long"), "append", "eventTime")
    return found.select(*("at_us" if c == "at" else c for c in (x.split()[0] for x in LEDGER.split(", ")))).withColumn("at_us", F.timestamp_micros("at_us")).withColumnRenamed("at_us", "at")


def screened(depth: DataFrame, impact: DataFrame, late: str = "30 minutes", cell_m: float = 30.0) -> DataFrame:
    """Screened frames (as `roads.screened_frames`, with valid_time) from two streams: depth by cell, and impact by road.

    Each stream is summed up by frame; a frame's sums meet when the watermark of both streams has passed it. A frame without roads is screened by its
    depths alone. depth: scenario_id, lead_minutes, valid_time, r, c, depth_m; impact: scenario_id, lead_minutes, valid_time, road_id, classification.
    """
    keys = ["scenario_id", "lead_minutes", "valid_time"]
    grid = roads.frame_extent(depth.withWatermark("valid_time", late), *keys, cell_m=cell_m)
    shut = roads.shut_and_slow(impact.withWatermark("valid_time", late), *keys)
    return roads.graded(grid.join(shut, keys, "left"))


def age_class(at: Column, now: Column) -> Column:
    """FRESH to 30 minutes (also that far ahead), STALE to 120, LATE to 240, then MISSING; INVALID further ahead or without a time."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 6e7
    return F.when(age.isNull() | (age < -FRESH), "INVALID").when(age <= FRESH, "FRESH").when(age <= STALE, "STALE").when(age <= 2 * STALE, "LATE").otherwise("MISSING")


def dealt_by_age(folder: str, now: Column | None = None, time: str = "observation_time") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: writes each batch to `folder`, by age class at its arrival and by batch, in one pass.

    A batch that is done again, after a restart, replaces what it wrote before. `now` is the time of processing, unless given.
    """

    def each(batch: DataFrame, number: int) -> None:
        aged = batch.withColumn("age_class", age_class(F.col(time), F.current_timestamp() if now is None else now)).withColumn("batch", F.lit(number))
        aged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "age_class").parquet(folder)

    return each
