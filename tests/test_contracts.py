"""Boundary cases of checks, feeds, fields, balances and names."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from rillspark.functions.shared import small, tiled
from rillspark.operators import audit, contracts, fields, gauges, graph, ledger, nowcast, summaries
from rillspark.sources import feeds


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names_and_labels(spark):
    names = {" car ": "LIGHT_VEHICLE", "4x4": "RESCUE_4X4", "Ambulance": "AMBULANCE", "boat": "LIGHT_VEHICLE", None: "LIGHT_VEHICLE", "WALK": "PEDESTRIAN", "": "LIGHT_VEHICLE"}
    for name, profile in names.items():
        assert one(spark, contracts.profile_of(F.lit(name).cast("string")).alias("p")).p == profile
    assert one(spark, contracts.result_labels(F.lit("BLOCKED"), F.lit("REAL")).alias("l")).l == ["BLOCKED", "REAL", "NO_DATA"]
    assert one(spark, contracts.result_labels(F.lit("VALIDATED"), F.lit("FIXTURE")).alias("l")).l[2] == "SYNTHETIC"
    assert [one(spark, contracts.interval_index(F.lit(x), 15, 12).alias("k")).k for x in (0, 14, 15, 999)] == [0, 0, 1, 11]


def test_frames_and_forecasts(spark):
    cells = spark.createDataFrame([(k, r, c, v) for k in range(4) for r in range(2) for c in range(2) for v in [[1.0, -1.0, float("nan"), 1.0][k] if (r, c) == (1, 1) else 0.0]], "k int, r int, c int, rate_mmh double")
    heads = spark.createDataFrame([(0, 2, 2, "mm/h", True, 0, 1), (1, 2, 2, "mm", True, 0, 1), (2, 2, 2, "mm/h", False, 1, 1), (3, 3, 2, "mm/h", True, 0, 1), (9, 2, 2, "mm/h", True, 0, 1)], "k int, width int, height int, units string, zoned boolean, valid_from int, valid_to int")
    found = {r.k: r.errors for r in contracts.checked_frames(cells, heads, "k").collect()}
    assert found == {0: "", 1: "UNITS_NOT_MM_PER_HOUR; RATE_BELOW_ZERO", 2: "TIME_WITHOUT_ZONE; EMPTY_INTERVAL; RATE_NOT_FINITE", 3: "CELLS_DO_NOT_FILL_GRID", 9: "CELLS_DO_NOT_FILL_GRID"}
    rows = [(1, x, "mm/h", 5, 5, "a", 30.0) for x in (0, 15, 30, 45, 60)] + [(2, x, "mm/h", 5, 5, "a", 30.0) for x in (0, 15, 30, 45)] + [(3, x, "mm/h", 5 + x, 5, "a", 30.0) for x in (0, 15, 30, 45, 60)]
    frames = spark.createDataFrame(rows, "f int, lead_minutes int, units string, width int, height int, reference string, resolution_m double")
    assert {r.f: r.accepted for r in contracts.checked_forecasts(frames, "f").collect()} == {1: True, 2: False, 3: False}
    assert contracts.forcing(frames, 60, "f").groupBy("f").count().where("count = 4").count() == 3
    with pytest.raises(ValueError):
        contracts.forecast_intervals(frames, 50, 15)


def test_conditioning_keeps_valid_cells(spark):
    cells = spark.createDataFrame([(1, 0, 5.0), (1, 1, -9999.0), (1, 2, None), (1, 3, 9000.0), (1, 4, 7.0), (2, 0, -9999.0)], "g int, c int, z double")
    done = contracts.conditioned(cells, "g")
    assert {(r.g, r.c): (r.z_out, r.filled) for r in done.collect()} == {(1, 0): (5.0, False), (1, 1): (5.0, True), (1, 2): (5.0, True), (1, 3): (5.0, True), (1, 4): (7.0, False), (2, 0): (None, True)}
    assert {r.g: (r.nodata_cells, r.all_nodata) for r in contracts.conditioning_report(done, "g").collect()} == {1: (3, False), 2: (1, True)}


def test_feeds_with_missing_parts(spark):
    docs = [(1, json.dumps({"current": {"precipitation": 2.5}, "minutely_15": {"time": ["a", "b"], "precipitation": [1.0]}})), (2, "{}"), (3, "not json"), (4, None)]
    frame = spark.createDataFrame(docs, "k int, feed string")
    assert {r.k: (r.rate_mmh, r.temperature_c) for r in feeds.current_weather(frame, "k").collect()} == {1: (2.5, 28.5), 2: (0.0, 28.5), 3: (0.0, 28.5), 4: (0.0, 28.5)}
    assert [(r.k, r.time, r.precipitation) for r in feeds.series(frame, "minutely_15", ("precipitation",), "k").orderBy("place").collect()] == [(1, "a", 1.0), (1, "b", None)]
    marine = spark.createDataFrame([(1, json.dumps({"hourly": {"sea_level_height_msl": [None, 2.6] + [0.1] * 30 + [9.0]}})), (2, "{}")], "k int, feed string")
    assert {r.k: (r.hours, r.highest_m, r.tide_m, r.surge) for r in feeds.tides(marine, "k").where("k = 1").collect()} == {1: (23, 2.6, 2.6, True)}
    lines = json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}}, {"geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"waterway": "canal"}}, {"geometry": {"type": "LineString", "coordinates": [[1, 2]]}}]})
    found = feeds.geojson_lines(spark.createDataFrame([(1, lines)], "k int, feed string"), "k").collect()
    assert [(r.feature, r.points, r.waterway) for r in found] == [(1, [[1.0, 2.0], [3.0, 4.0]], "canal")]
    elements = spark.createDataFrame([("node", 1, 0.0, 0.0, None), ("node", 2, 1.0, 1.0, None), ("way", 9, None, None, [2, 7, 1, 2]), ("way", 8, None, None, [1, 7])], "type string, id long, lon double, lat double, nodes array<long>")
    assert [(r.way, r.points) for r in feeds.way_lines(elements).collect()] == [(9, [[1.0, 1.0], [0.0, 0.0], [1.0, 1.0]])]


def test_balance_status(spark):
    names = "run_id, rain_m3, ext_in_m3, losses_m3, surf_out_m3, s2d_m3, d2s_m3, flood_export_m3, outfall_m3, s_s0, s_s1, s_d0, s_d1".replace(",", " double,") + " double"
    rows = [(1.0, 100.0, 0.0, 10.0, 0.0, 20.0, 0.0, 0.0, 15.0, 0.0, 70.0, 0.0, 5.0), (2.0, 100.0, 0.0, 10.0, 0.0, 20.0, 0.0, 0.0, 15.0, 0.0, 67.0, 0.0, 5.0), (3.0, 100.0, 0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 50.0, 0.0, 0.0), (4.0, *[0.0] * 12), (5.0, None, *[0.0] * 11)]
    assert {r.run_id: r.balance_status for r in ledger.residuals(spark.createDataFrame(rows, names)).collect()} == {1.0: "pass", 2.0: "warning", 3.0: "fail", 4.0: "pass", 5.0: "fail"}


def test_conduit_rules(spark):
    raw = [(1, "river", 1, 2, 100.0, 10.0, 12.0), (2, "ditch", 1, 2, 5.0, 0.6, 0.6), (3, None, 1, 2, 100.0, 10.0, 9.0)]
    found = {r.conduit_id: r for r in audit.conduits(spark.createDataFrame(raw, "conduit_id int, waterway string, from_node int, to_node int, length_raw_m double, z_in double, z_out double")).collect()}
    assert (found[1].diameter_m, found[1].z_low, found[1].slope) == (4.0, 9.8, 0.002)
    assert (found[2].diameter_m, found[2].z_low, found[2].length_m) == (2.0, 0.5, 10.0) and found[3].diameter_m == 1.2
    area, n = math.pi * 0.36, 0.015
    assert math.isclose(found[3].capacity_m3s, area * 0.3 ** (2 / 3) * math.sqrt(0.01) / n, abs_tol=1e-3)


@pytest.mark.parametrize(("minutes", "status"), [(45, "HEALTHY"), (46, "DEGRADED"), (90, "DEGRADED"), (91, "UNAVAILABLE")])
def test_provider_health(spark, minutes, status):
    obs = spark.sql(f"SELECT 1 AS p, TIMESTAMP '2024-01-01 00:00:00' AS observation_time, {minutes} AS m")
    assert gauges.health(obs, F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes)), "p").first().status == status
    assert gauges.health(spark.sql("SELECT 1 AS p, CAST(NULL AS TIMESTAMP) AS observation_time"), F.current_timestamp(), "p").first().status == "UNCONFIGURED"


def test_waypoint_limits_are_strict(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.20, 1.75), (1, 0.0, 0.0, 0.21, 0.0), (2, 0.0, 0.0, 0.1, 4.0)], "i int, x double, y double, depth_m double, velocity_ms double")
    found = [(r.blocked, r.x_out, r.y_out) for r in summaries.waypoint_hazard(points, spark.createDataFrame([("c", 0.20, 0.36)], "profile string, max_depth_m double, max_dv double")).orderBy("i").collect()]
    assert found[0] == (False, 0.0, 0.0) and found[1][0] and math.isclose(found[1][1], -20.8, abs_tol=1e-6) and math.isclose(found[2][2], 6.0, abs_tol=1e-6)


def test_long_node_ids_stay_apart(spark):
    edges = [(1234561, 1234562, 1, 100.0, 36.0, 0.0), (1234562, 1234569, 2, 100.0, 36.0, 0.6), (1234561, 1234569, 3, 900.0, 36.0, 0.0)]
    costs = graph.flood_costs(graph.both_ways(spark.createDataFrame(edges, "n1 long, n2 long, road_id int, length_m double, speed_kmh double, depth_m double")))
    paths = graph.shortest_paths(costs, spark.createDataFrame([("baseline", 1234561), ("flood_aware", 1234561)], "mode string, origin long"))
    text = {(r.mode, r.node): r.p for r in paths.select("mode", "node", graph.path_text(F.col("path")).alias("p")).collect()}
    assert text["baseline", 1234569] == "1234561>1234562>1234569" and text["flood_aware", 1234569] == "1234561>1234569"
    gone = graph.avoided_edges(paths, costs.where("mode = 'baseline'")).collect()
    assert {(r.node, r.a, r.b, r["class"]) for r in gone} == {(1234569, 1234561, 1234562, "DRY"), (1234569, 1234562, 1234569, "IMPASSABLE")}


def test_tiles_change_no_window(spark):
    cells = spark.createDataFrame([(0, r, c, float((r * 7 + c * 3) % 11)) for r in range(9) for c in range(10)], "frame int, r int, c int, rate_mmh double")
    whole = {(r.r, r.c): (r.gx, r.gy) for r in nowcast.gradients(cells).collect()}
    assert tiled(cells, "c", 2, size=4).where("own").count() == 90
    patched = tiled(cells, "r", 1, size=3)
    assert patched.groupBy("tile").agg(F.countDistinct("r").alias("n")).agg(F.max("n")).first()[0] == 5 and len(whole) == 90


def test_parameters_and_sweep(spark):
    least, most, usual = F.lit(1.0), F.lit(3.0), F.lit(2.0)
    assert [one(spark, fields.clipped(F.lit(x).cast("double"), least, most, usual).alias("v")).v for x in (0.0, 2.5, 9.0, None, float("nan"))] == [1.0, 2.5, 3.0, 2.0, 2.0]
    names = spark.createDataFrame([("a", 1.0, 3.0), ("b", 0.0, 0.5)], "name string, least double, most double")
    points = fields.random_sweep(spark.range(2000).withColumnRenamed("id", "candidate"), names).collect()
    by = {n: [r.value for r in points if r.name == n] for n in "ab"}
    assert all(1 <= v <= 3 for v in by["a"]) and all(0 <= v <= 0.5 for v in by["b"]) and abs(sum(by["a"]) / 2000 - 2) < 0.06 and len(set(by["a"])) > 1990


def test_broadcasts_are_checked(spark):
    assert "BroadcastNestedLoopJoin" in spark.range(5).crossJoin(small(spark.range(3)))._jdf.queryExecution().toString()
    assert "CartesianProduct" in spark.range(5).crossJoin(small(spark.range(30), most=10))._jdf.queryExecution().toString()
