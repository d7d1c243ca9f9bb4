"""The result store, manifests, bundles, and providers."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from rillspark.operators import bundles
from rillspark.sources import manifest, providers
from rillspark.sources.results import MissingResultsError, ResultStore, summaries

ROWS = [("S1", 1, 0.5), ("S1", 2, 0.25), ("S2", 1, 1.0), ("S/3", 7, None)]


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"))


def as_set(df):
    return {tuple(r) for r in df.collect()}


def rows(spark, data=ROWS):
    return spark.createDataFrame(data, "scenario_id string, lead int, depth_m double")


def test_store_and_required_keys(spark, store):
    with pytest.raises(MissingResultsError, match="nothing"):
        store.load()
    store.write(rows(spark), "scenario_id")
    assert as_set(store.load(("S1", "S2"))) == set(ROWS)
    assert as_set(store.load(("S1",), only=True)) == set(ROWS[:2])
    with pytest.raises(MissingResultsError, match="S9"):
        store.load(("S1", "S9"))
    store.write(rows(spark, [("S2", 5, 9.0)]), "scenario_id")  # replaces one key, leaves the others
    assert as_set(store.load()) == {*ROWS[:2], ROWS[3], ("S2", 5, 9.0)}
    assert as_set(summaries(store).select("key", "rows")) == {("S1", 2), ("S2", 1), ("S/3", 1)}
    assert len(store.entries(0)) == 3 and store.entries(0)["S2"].rows == 1 and store.entries(0)["S2"].path != store.entries()["S2"].path
    assert store.swept() == 0  # the first folder still holds two keys
    store.write(rows(spark, [x for x in ROWS if x[0] != "S2"]), "scenario_id")
    assert store.swept() == 1 and as_set(store.load()) == {*ROWS[:2], ROWS[3], ("S2", 5, 9.0)}


def test_cut_short_writes_are_not_read(spark, store, monkeypatch):
    store.write(rows(spark), "scenario_id")
    monkeypatch.setattr(ResultStore, "_commit", lambda self, number, entries: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.write(rows(spark, [("S1", 9, 9.0)]), "scenario_id")
    monkeypatch.undo()
    assert as_set(store.load()) == set(ROWS) and store.swept() == 1 and as_set(store.load()) == set(ROWS)
    bad = rows(spark).withColumn("depth_m", F.when(F.col("lead") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("depth_m")))
    with pytest.raises(Exception, match="broken"):
        store.write(bad, "scenario_id")
    assert as_set(store.load()) == set(ROWS)
    with pytest.raises(Exception, match="without a key"):
        store.write(rows(spark, [(None, 1, 1.0)]), "scenario_id")


def test_the_same_write_again_changes_nothing(spark, store):
    first = store.write(rows(spark), "scenario_id", {k: f"f-{k}" for k in ("S1", "S2", "S/3", "S4")})
    assert first["S4"].rows == 0
    assert store.write(rows(spark), "scenario_id", {k: f"f-{k}" for k in ("S1", "S2", "S/3", "S4")}) == first and store.swept() == 0
    assert as_set(store.load(("S4",))) == set(ROWS)


def test_two_writers(spark, store):
    """A writer whose number is taken reads what the other committed, and commits after it."""
    store.write(rows(spark), "scenario_id")
    honest, raced = store._commit, []

    def late(number, entries):
        if not raced:
            raced.append(number)
            ResultStore(spark, store.root).write(rows(spark, [("S5", 1, 1.0)]), "scenario_id")
        return honest(number, entries)

    store._commit = late
    store.write(rows(spark, [("S1", 4, 4.0)]), "scenario_id")
    assert as_set(store.load()) == {("S1", 4, 4.0), *ROWS[2:], ("S5", 1, 1.0)} and store._numbers() == [0, 1, 2]


def test_manifest_and_evidence(spark, tmp_path):
    files = {"a.bin": b"x" * 10, "b/c.bin": os.urandom(300_000), "b/d.txt": b"", "b/e.bin": b"same"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for whole in (1, 1000, 1 << 20):  # by streams, mixed, as values
        found = manifest.manifest(spark, str(tmp_path), whole_bytes=whole)
        assert as_set(found) == {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items() if d}
    assert manifest.manifest(spark, str(tmp_path), "*.bin").count() == 3
    digest = lambda n: hashlib.sha256(files[n]).hexdigest()
    expected = spark.createDataFrame([("a.bin", 10, digest("a.bin")), ("b/c.bin", 300_000, "0" * 64), ("b/d.txt", 1, None), ("b/e.bin", 5, None), ("gone", None, None)], "path string, bytes long, sha256 string")
    rows = manifest.evidence(found, expected)
    assert {(r.path, r.outcome, r.reason) for r in rows.collect()} == {("a.bin", "PRESENT", None), ("b/c.bin", "CHANGED", "other digest"), ("b/d.txt", "MISSING", "not found"), ("gone", "MISSING", "not found"), ("b/e.bin", "CHANGED", "other size")}
    assert tuple(manifest.evidence_summary(rows).first()) == (1, 2, 2, 0, 300_014, False)
    assert tuple(manifest.evidence_summary(manifest.evidence(found, expected.where("path = 'a.bin'"))).first())[2:4] == (0, 2)


def test_fingerprints():
    assert bundles.config_fingerprint({"a": 1, "b": [2]}) == bundles.config_fingerprint({"b": [2], "a": 1}) != bundles.config_fingerprint({"a": 1, "b": [3]})
    one = bundles.step_fingerprint("x", "rain", {"k": 1})
    assert len({one, bundles.step_fingerprint("y", "rain", {"k": 1}), bundles.step_fingerprint("x", "flood", {"k": 1}), bundles.step_fingerprint("x", "rain", {"k": 2})}) == 4


def test_only_changed_leads_are_built(spark, store):
    depth = spark.createDataFrame([(s, lead, r, c, 0.1 * (r + c) + lead / 100) for s in ("A", "B") for lead in (0, 15) for r in range(4) for c in range(4)], "scenario_id string, lead_minutes int, r int, c int, depth_m double")
    roads = spark.createDataFrame([(1, 0, 0, 3, 3, "local", 90.0), (2, 0, 3, 3, 0, "primary", 90.0)], "road_id long, r1 int, c1 int, r2 int, c2 int, road_class string, length_m double")
    built = []

    def build(frames, network):
        built.append({r[0] for r in frames.select(F.concat_ws("/", "scenario_id", "lead_minutes")).distinct().collect()})
        return bundles.flood_and_roads(frames, network)

    run = lambda d=depth, n=roads, c=(("k", 1),): bundles.refreshed(store, d, n, dict(c), build)
    first, again = run()
    every = {"A/0", "A/15", "B/0", "B/15"}
    assert set(again) == every and built == [every] and {r.bundle for r in first.collect()} == every
    before = as_set(first)
    assert run(depth.repartition(3).select(*reversed(depth.columns)))[1] == [] and len(built) == 1  # order of rows and columns says nothing
    changed, again = run(depth.withColumn("depth_m", F.col("depth_m") + F.when(F.expr("scenario_id = 'B' AND lead_minutes = 15 AND r = 0 AND c = 0"), 1.0).otherwise(0.0)))
    assert again == ["B/15"] and built[-1] == {"B/15"} and len(as_set(changed) - before) == 1
    assert run(depth.where("scenario_id = 'A'"))[1] == [] and {r.bundle for r in run(depth.where("scenario_id = 'A'"))[0].collect()} == {"A/0", "A/15"}
    assert set(run(n=roads.where("road_id = 1"))[1]) == every
    assert set(run(c=(("k", 2),))[1]) == every


T0 = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def put(folder, name, obs):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"obs_id": i, "observation_time": (T0 + dt.timedelta(minutes=m)).isoformat(), "product_type": "RAIN_RATE_MMH", "raw_value": v}) for i, m, v in obs]
    (folder / name).write_text("\n".join([*lines, "not json", '{"obs_id": 1}', ""]))


def test_drops_as_table_and_as_stream(spark, tmp_path):
    folder = tmp_path / "drops"
    put(folder, "001.jsonl", [(1, 0, 1.0), (2, 5, None)])
    put(folder, "002.jsonl", [(3, 9, 2.0)])
    put(folder, "_hidden", [(9, 9, 9.0)])
    assert {(r.obs_id, r.raw_value) for r in providers.drops(spark, str(folder)).collect()} == {(1, 1.0), (2, None), (3, 2.0)}
    assert providers.drops(spark, str(tmp_path / "none")).count() == 0

    def drained():
        query = providers.drop_stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
        return sorted(r.obs_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drained() == [1, 2, 3]
    put(folder, "003.jsonl", [(4, 20, 3.0)])
    assert drained() == [1, 2, 3, 4] and drained() == [1, 2, 3, 4]


def test_providers(spark, tmp_path):
    put(tmp_path / "a", "1.jsonl", [(1, 0, 1.0), (2, 10, 2.0), (3, 10, 2.5)])
    table = spark.createDataFrame([(7, T0 + dt.timedelta(minutes=50), "SATELLITE_QPE", 4.0)], providers.OBSERVATIONS)
    known = providers.Providers(
        providers.Provider("drops", "REAL", "Drops", lambda s: providers.drops(s, str(tmp_path / "a")), 5), providers.Provider("table", "FIXTURE", "Table", lambda s: table), providers.Provider("empty", "SYNTHETIC", "None", lambda s: table.limit(0))
    )
    assert {(r.provider_id, r.source_type, r.obs_id) for r in known.latest(spark).collect()} == {("drops", "REAL", 3), ("table", "FIXTURE", 7)}
    times = spark.createDataFrame([(T0 + dt.timedelta(minutes=m),) for m in (4, 30)], "t timestamp")
    minute = lambda t: (t.replace(tzinfo=dt.UTC) - T0).total_seconds() / 60
    assert {(r.provider_id, minute(r.t), r.obs_id, r.fallback) for r in known.at_time(spark, times, "drops", "table").collect()} == {("drops", 4, 1, False), ("drops", 30, 3, True), ("table", 4, 7, True), ("table", 30, 7, True)}
    health = {r.provider_id: (r.status, r.observations) for r in known.health(spark, F.lit(T0 + dt.timedelta(minutes=70))).collect()}
    assert health == {"drops": ("DEGRADED", 3), "table": ("HEALTHY", 1), "empty": ("UNCONFIGURED", 0)}
    with pytest.raises(KeyError, match="nobody"):
        known.latest(spark, "nobody")
    with pytest.raises(ValueError, match="already"):
        known.register(known.chosen("table")[0])
    with pytest.raises(ValueError, match="not one of"):
        providers.Provider("x", "GUESSED", "x", lambda s: table)
