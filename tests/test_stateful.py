"""Streams with state: late, repeated and out-of-order events, expiry, restarts; results are those of the batch operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillspark.operators import nowcast, roads
from rillspark.streaming import stateful

T0 = dt.datetime(2024, 6, 1)
FAR = T0 + dt.timedelta(days=30)


def minutes(k):
    return T0 + dt.timedelta(minutes=k)


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    stateful.prepared(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # many small batches
    yield
    for n in names:
        spark.conf.set(n, before[n])


def put(spark, folder, number, rows, schema):
    """One more file: the files of a folder are read one a batch, in order of their names' times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number:03d}")


def driven(spark, source, schema, build, out, checkpoint, at_once=1):
    """Everything that is there now goes through the query, a file a batch; the query then ends, and can go on later."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", "true").parquet(source)
    query = build(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    assert query.awaitTermination(300)
    return spark.read.parquet(out)


def frame(radar, at, cells):
    return [(radar, at, r, c, v) for r, c, v in cells]


def test_motion_equals_batch(spark, tmp_path):
    """Frames that come out of order, in parts and for two radars, with a dry one and a gap; one comes too late."""
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    shown = {k: [(k % 5 + r, 2 * (k % 4) + c, float(r + c + 1)) for r in range(3) for c in range(2)] for k in range(8)}
    shown[5] = [(1, 1, 0.2)]
    for number, part in enumerate(([1, 0], [3, 2], [4], [5, 6], [7])):
        rows = [x for k in part for radar in ("a", "b") for x in frame(radar, minutes(15 * k), shown[k] if radar == "a" else [(r, c, 2 * v) for r, c, v in shown[k]])]
        put(spark, folder, number, rows[::-1], stateful.FRAMES)
    build = lambda s: stateful.storm_motions(s, late="20 minutes")
    driven(spark, folder, stateful.FRAMES, build, out, mark)
    put(spark, folder, 8, frame("a", minutes(15), [(0, 0, 99.0)]), stateful.FRAMES)  # behind the watermark
    put(spark, folder, 9, frame("z", FAR, [(0, 0, 1.0)]), stateful.FRAMES)
    put(spark, folder, 10, frame("z", FAR + dt.timedelta(hours=1), [(0, 0, 1.0)]), stateful.FRAMES)
    found = {(r.radar_id, r.to_time): r for r in driven(spark, folder, stateful.FRAMES, build, out, mark).where("radar_id <> 'z'").collect()}
    assert len(found) == 2 * 7
    for k in range(1, 8):
        cells = [(f, r, c, v) for f in (k - 1, k) for r, c, v in shown[f]]
        want = nowcast.storm_motion(spark.createDataFrame(cells, "frame int, r int, c int, rate_mmh double"), k - 1, k).first()
        row = found["a", minutes(15 * k)]
        assert row.from_time == minutes(15 * k - 15) and abs(row.u_mps - want.u_mps) < 1e-9 and abs(row.v_mps - want.v_mps) < 1e-9


def test_last_frame_is_forgotten(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    hours = stateful.FRAME_HOURS
    for number, (radar, at) in enumerate((("a", 0), ("x", 60 * hours + 120), ("x", 60 * hours + 180), ("a", 60 * hours + 240), ("a", 60 * hours + 255), ("x", 60 * hours + 600), ("x", 60 * hours + 700))):
        put(spark, folder, number, frame(radar, minutes(at), [(number, number, 5.0)]), stateful.FRAMES)
    found = driven(spark, folder, stateful.FRAMES, lambda s: stateful.storm_motions(s, late="5 minutes"), out, mark).where("radar_id = 'a'").collect()
    assert [(r.from_time, r.to_time) for r in found] == [(minutes(60 * hours + 240), minutes(60 * hours + 255))]


EVENTS = [
    ("a", "issue", 0, "flood"), ("b", "cancel", 1, None), ("b", "issue", 5, "rain"), ("a", "cancel", 9, None), ("a", "cancel", 12, None), ("c", "issue", 20, "x"), ("c", "issue", 21, "y"),
    ("c", "cancel", 20, None), ("d", "issue", 30, "late"), ("d", "cancel", 30 + 60 * stateful.ALERT_HOURS + 1, None),
]


def ledger_rows(order):
    return [(a, what, minutes(at), head, "water has gone") for a, what, at, head in (EVENTS[k] for k in order)]


EXPECTED = {("a", "Alert", 0, True), ("a", "Alert", 9, False), ("a-CANCEL", "Cancel", 9, False), ("b", "Alert", 5, True), ("c", "Alert", 20, True), ("c", "Alert", 20, False), ("c-CANCEL", "Cancel", 20, False), ("d", "Alert", 30, True)}


@pytest.mark.parametrize("order", [[[0, 1, 2, 3, 4, 5, 6, 7, 8], [9]], [[3, 2], [0, 1, 4], [7, 8, 5], [6], [9]]])
def test_alerts_in_any_order(spark, tmp_path, order):
    """A cancel may arrive before its issue; a second cancel, one before the issue and one after the alert is forgotten give nothing."""
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for number, part in enumerate(order):
        put(spark, folder, number, ledger_rows(part), stateful.EVENTS)
    for number in (50, 51, 52):
        put(spark, folder, number, [("z", "none", FAR + dt.timedelta(days=number), "", "")], stateful.EVENTS)
    found = driven(spark, folder, stateful.EVENTS, lambda s: stateful.alert_ledger(s, late="60 minutes"), out, mark).collect()
    assert {(r.alert_id, r.kind, (r.at - T0).total_seconds() / 60, r.active) for r in found} == EXPECTED and len(found) == len(EXPECTED)
    assert {r.refers_to for r in found if r.kind == "Cancel"} == {"a", "c"}


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    """Stopped after every file and started again from its checkpoint, the ledger is the same; nothing comes twice."""
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    build = lambda s: stateful.alert_ledger(s, late="60 minutes")
    for number, part in enumerate([[0, 3], [1, 2, 4], [5, 6, 7, 8], [9]]):
        put(spark, folder, number, ledger_rows(part), stateful.EVENTS)
        driven(spark, folder, stateful.EVENTS, build, out, mark)
    for number in (50, 51):
        put(spark, folder, number, [("z", "none", FAR + dt.timedelta(days=number), "", "")], stateful.EVENTS)
        found = driven(spark, folder, stateful.EVENTS, build, out, mark).collect()
    assert sorted((r.alert_id, r.kind, (r.at - T0).total_seconds() / 60, r.active) for r in found) == sorted(EXPECTED)


def test_screened_frames_equal_batch(spark, tmp_path):
    """Depths and roads come in parts, the roads of a frame before or after its depths; a frame without roads is screened too."""
    keyed = lambda s: F.make_interval(mins=F.col("lead_minutes"))
    depth = [(s, lead, r, c, ((r * 7 + c * 3 + lead) % 11) / 15 if s == "S1" else 0.06) for s in ("S1", "S2") for lead in (0, 15, 30) for r in range(4) for c in range(4)] + [("S3", 0, 0, 0, 0.01)]
    impact = [("S1", lead, k, ("DRY", "IMPASSABLE", "CAUTION")[(k + lead // 15) % 3]) for lead in (0, 15, 30) for k in range(4)]
    d = spark.createDataFrame(depth, "scenario_id string, lead_minutes int, r int, c int, depth_m double")
    i = spark.createDataFrame(impact, "scenario_id string, lead_minutes int, road_id int, classification string")
    at = lambda df: df.withColumn("valid_time", F.lit(T0) + keyed(df))
    for k, part in enumerate(("lead_minutes = 15", "lead_minutes = 0", "lead_minutes = 30")):
        at(d).where(part).coalesce(1).write.parquet(str(tmp_path / f"depth/{k}"))
        at(i).where(part).coalesce(1).write.parquet(str(tmp_path / f"impact/{2 - k}"))
    for k in (8, 9):
        later = F.lit(FAR + dt.timedelta(days=k))
        at(d).limit(1).withColumn("valid_time", later).write.parquet(str(tmp_path / f"depth/{k}"))
        at(i).limit(1).withColumn("valid_time", later).write.parquet(str(tmp_path / f"impact/{k}"))
    read = lambda name, like: spark.readStream.schema(at(like).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
    query = stateful.screened(read("depth", d), read("impact", i), late="40 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(300)
    batch = roads.screened_frames(d, i)
    columns = batch.columns
    found = spark.read.parquet(str(tmp_path / "out")).where(F.col("valid_time") < FAR).select(columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, batch.collect()), key=str) and len(found) == 6


def test_ages(spark, tmp_path):
    ages = {-31: "INVALID", -30: "FRESH", 0: "FRESH", 30: "FRESH", 31: "STALE", 120: "STALE", 121: "LATE", 240: "LATE", 241: "MISSING"}
    rows = [(k, minutes(-a)) for k, a in enumerate(ages)] + [(99, None)]
    batch = spark.createDataFrame(rows, "obs_id long, observation_time timestamp")
    write = stateful.dealt_by_age(str(tmp_path / "out"), F.lit(T0))
    for number in (0, 1, 0, 1):  # done again after a restart
        write(batch, number)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 2 * len(rows)
    assert {r.obs_id: r.age_class for r in found.collect()} == {**dict(enumerate(ages.values())), 99: "INVALID"}
