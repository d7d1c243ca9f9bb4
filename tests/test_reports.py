"""Reports on edge cases: frames that lack parts, fits that do not vary, boxes that overlap, sites and roads of wards."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from rillspark.operators import fields, frames, reports, roads, scores
from rillspark.sources import feeds

DEPTH = "scenario_id string, lead_minutes int, r int, c int, depth_m double"
LEDGER = "scenario_id string, rain_m3 double, ext_in_m3 double, losses_m3 double, surf_out_m3 double, outfall_m3 double, s_s0 double, s_s1 double, s_d0 double, s_d1 double"


def test_dossiers_of_frames_that_lack_parts(spark):
    depth = spark.createDataFrame([("S1", 0, 0, 0, 0.2), ("S1", 0, 0, 1, 0.04), ("S1", 15, 0, 0, 0.2), ("S2", 0, 0, 0, 0.01)], DEPTH)
    impact = spark.createDataFrame([("S1", 0, 1, "IMPASSABLE"), ("S1", 0, 2, None), ("S1", 0, 3, "DRY")], "scenario_id string, lead_minutes int, road_id int, classification string")
    ledger = spark.createDataFrame([("S1", 100.0, 0.0, 10.0, 0.0, 40.0, 0.0, 50.0, 0.0, 0.0), ("S1", 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.99999, 0.0, 0.0)], LEDGER)
    alerts = spark.createDataFrame([("S1", 0, "FLOOD-S1-000", "water", "Severe", "stay")], "scenario_id string, lead_minutes int, alert_id string, headline string, severity string, instruction string")
    found = {r.dossier_id: r for r in reports.dossiers(depth, impact, ledger, alerts).collect()}
    assert set(found) == {"DOSSIER-S1-000", "DOSSIER-S1-015", "DOSSIER-S2-000"}
    a, b, c = (found[k] for k in sorted(found))
    assert (a.severity_level, a.total_roads, a.impassable_roads, a.dry_roads, a.alert_id, a.closed_balance) == ("SEVERE ORANGE", 3, 1, 1, "FLOOD-S1-000", True)
    assert (b.severity_level, b.total_roads, b.alert_id, b.peak_lead_minutes) == ("MODERATE AMBER", 0, None, 0)
    assert (c.severity_level, c.relative_error_pct, c.closed_balance, c.rainfall_m3) == ("MINOR GREEN", None, False, None)
    assert a.inundated_pct == 50.0 and a.residual_m3 == 0.0 and "1 roads closed" in a.summary_text
    assert [tuple(r) for r in reports.closed_roads(impact).collect()] == [("DOSSIER-S1-000", 1)]


def test_validation_fits_that_do_not_vary(spark):
    rows = {"same": [(1, 1.0), (2, 2.0)], "flat_met": [(3, 3.0), (3, 3.0)], "flat_missed": [(1, 3.0), (2, 3.0)], "zero_mean": [(1, -1.0), (2, 1.0)], "flat_model": [(2, 1.0), (2, 3.0)]}
    frame = spark.createDataFrame([(k, float(s), float(o)) for k, x in rows.items() for s, o in x], "k string, s double, o double")
    found = {r.k: r for r in reports.validation_fit(frame, "k").collect()}
    assert (found["same"].nse, found["same"].kge) == (1.0, 1.0) and (found["flat_met"].nse, found["flat_met"].kge, found["flat_met"].alpha) == (1.0, 1.0, 1.0)
    assert found["flat_missed"].nse == -math.inf and (found["flat_missed"].r, found["flat_missed"].alpha, found["flat_missed"].beta) == (0.0, 0.0, 0.5)
    assert found["zero_mean"].beta == 1.5 and (found["flat_model"].r, found["flat_model"].alpha, found["flat_model"].nse) == (0.0, 0.0, 0.0)


def test_wards(spark):
    depth = spark.createDataFrame([("S", 0, r, c, 0.4 if c < 2 else 0.0) for r in range(4) for c in range(4)], DEPTH)
    segments = spark.createDataFrame([(1, 0, 0, 0, 3), (2, 3, 3, 3, 3)], "road_id long, r1 int, c1 int, r2 int, c2 int")
    impact = spark.createDataFrame([("S", 0, 1, "IMPASSABLE"), ("S", 0, 2, "DRY")], "scenario_id string, lead_minutes int, road_id long, classification string")
    assets = spark.createDataFrame([("b", 0, 0), ("a", 1, 1), ("dry", 3, 3)], "name string, r int, c int")
    found = {(r.ward_r, r.ward_c): r for r in reports.ward_report(depth, roads.road_cells(segments), impact, assets, side=2).collect()}
    assert len(found) == 4 and found[0, 0].facilities_at_risk == "a, b" and found[1, 1].facilities_at_risk == ""
    assert [found[k].impassable_roads for k in ((0, 0), (0, 1), (1, 0), (1, 1))] == [1, 1, 0, 0]


def test_costs_and_losses(spark):
    effects = spark.createDataFrame([("S", 0, "p", 10.0, 20.0, 2, 1)], "scenario_id string, lead_minutes int, package string, area_reduction_m2 double, volume_reduction_m3 double, reopened_roads long, protected_assets long")
    packages = spark.createDataFrame([("p", 0.1, 100.0, 2.0, True)], "package string, lid double, basin_m3 double, pump_m3s double, unblock boolean")
    r = reports.itemised(effects, packages).first()
    assert (r.lid_cost_inr, r.basin_cost_inr, r.pump_cost_inr, r.desilting_cost_inr) == (18e6, 45e3, 5e6, 1.5e6) and r.capex_inr == 24_545_000
    assert (r.property_inr, r.volume_inr, r.traffic_inr, r.assets_inr, r.avoided_inr) == (12e3, 3600, 5e6, 5e6, 10_015_600)
    grids = spark.createDataFrame([("S", 0, "p", 0, 0, 0.5, 0.1), ("S", 0, "p", 0, 1, 0.5, 0.4), ("S", 0, "p", 1, 1, 0.1, 0.0)], "scenario_id string, lead_minutes int, package string, r int, c int, base_m double, depth_m double")
    assets = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.3), (1, 1, 0.3)], "r int, c int, critical_depth_m double")
    assert reports.protected_assets(grids, assets).first().protected_assets == 1


def test_messages_are_json(spark):
    alert = spark.sql("""SELECT 'FLOOD-S-000' AS alert_id, 'Exercise' AS status, 'a "quoted" line' AS headline, 'd' AS description, 'i' AS instruction, 'Immediate' AS urgency, 'Severe' AS severity, 'Observed' AS certainty,
      TIMESTAMP_NTZ '2026-01-01 00:00:00' AS valid_from, TIMESTAMP_NTZ '2026-01-01 02:00:00' AS expires, 'x' AS area, map('b', '2', 'a', '1') AS parameters""")
    ring = F.transform(reports.ring(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), 10.0, 20.0, 1.0), lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    r = reports.alert_messages(alert.withColumn("ring", ring), "desk").first()
    message = json.loads(r.message)
    assert r.polygon == "20.000000,10.000000 20.000000,13.000000 18.000000,13.000000 18.000000,10.000000 20.000000,10.000000"
    assert message["info"][0]["headline"] == 'a "quoted" line' and message["info"][0]["area"]["polygon"] == r.polygon and [p["name"] for p in message["info"][0]["parameters"]] == ["a", "b"]


def test_catalogs_labels_and_gates(spark):
    cities = spark.createDataFrame([("b", 0.0, 0.0, 10.0, 10.0), ("a", 5.0, 5.0, 20.0, 20.0)], "city_id string, west double, south double, east double, north double")
    sites = spark.createDataFrame([(1, "p", 7.0, 7.0), (2, "q", 1.0, 1.0), (3, "r", 50.0, 1.0), (4, "s", None, 1.0)], "site_id int, name string, x double, y double")
    assert {(r.site_id, r.city_id) for r in reports.in_boxes(reports.united(("one", sites)), cities).collect()} == {("1", "a"), ("2", "b")}
    runs = spark.createDataFrame([(1, " real_terrain_real_drainage", "x", None), (2, None, " ", "office"), (3, "?", None, "")], "run int, mode string, crs string, authority string")
    assert {(r.run, r.content_label, r.crs_provenance) for r in reports.labelled(runs, "authority").collect()} == {(1, "REAL_TERRAIN+REAL_DRAINAGE_GEOMETRY", "EMBEDDED"), (2, "SYNTHETIC", "AUTHORITATIVE_EXTERNAL"), (3, "SYNTHETIC", "UNVERIFIED")}
    accepted = spark.createDataFrame([("A", True), ("B", True), ("C", False)], "scenario_id string, accepted boolean")
    balances = spark.createDataFrame([("A", "pass"), ("C", "pass"), ("D", "pass")], "scenario_id string, overall_status string")
    assert {(r.scenario_id, r.accepted, r.balance_status) for r in reports.acceptance(accepted, balances).collect()} == {("A", True, "pass"), ("B", False, "missing"), ("C", False, "pass"), ("D", False, "pass")}


@pytest.mark.parametrize(("start", "want"), [((0, 0), (0, 2)), ((0, 3), (1, 2)), ((1, 3), (2, 0)), ((2, 1), (2, 1)), ((3, 4), None)])
def test_windows_from_an_offset(spark, start, want):
    bad = {(0, 0), (0, 1), (1, 4), (1, 1)}
    cells = spark.createDataFrame([(r, c, (r, c) in bad) for r in range(5) for c in range(5)], "r int, c int, bad boolean")
    found = frames.clear_window(cells, 2, start).collect()
    assert [tuple(r) for r in found] == ([] if want is None else [want])


def test_rivers(spark):
    docs = spark.createDataFrame([(1, '{"daily": {"river_discharge": [null, 3.5], "river_discharge_mean": [2.0]}}'), (2, "{}"), (3, "x"), (4, None)], "k int, feed string")
    assert {tuple(r) for r in feeds.rivers(docs, "k").collect()} == {(1, 1, 0.0, 3.5, 2.0), (2, 0, 0.0, None, None), (3, 0, 0.0, None, None), (4, 0, 0.0, None, None)}


def test_culverts_and_water(spark):
    dem = spark.createDataFrame([(r, c, 5.0 + r, int(c > 0)) for r in range(4) for c in range(4)], "r int, c int, z double, land int")
    steps = spark.createDataFrame([("S", 90, 0.0, 1.0, 0.5)], "scenario_id string, lead_minutes int, rate_mmh double, drained double, culvert_m double")
    found = {(r.r, r.c): r.depth_m for r in fields.city_ponding(dem, steps, half=1).collect()}
    assert {k for k, d in found.items() if d > 0} == {(1, 1), (1, 2), (2, 1), (2, 2)} and found[1, 1] == 0.5


def test_members_side_by_side(spark):
    grids = spark.createDataFrame([("S", 0, 1, 0, 0, 0.5), ("S", 0, 2, 0, 1, 0.7), ("S", 0, 1, 0, 1, 0.1)], "scenario_id string, lead_minutes int, member_id int, r int, c int, depth_m double")
    wide = scores.side_by_side(grids, [1, 2])
    assert {(r.r, r.c, r.m1, r.m2) for r in wide.collect()} == {(0, 0, 0.5, None), (0, 1, 0.1, 0.7)}
    assert {(r.r, r.c, r.member_id, r.d) for r in scores.one_by_one(wide, [1, 2], "r", "c").collect()} == {(0, 0, 1, 0.5), (0, 1, 1, 0.1), (0, 1, 2, 0.7)}


def test_roads_without_known_cells(spark):
    """A road outside of the grid, and one that a frame does not meet, have rows of nulls; roads of equal ends have equal values."""
    depth = spark.createDataFrame([("S", 0, 0, 0, 0.6), ("S", 15, 5, 5, 0.2), ("T", 0, 0, 1, 0.1)], DEPTH)
    segments = spark.createDataFrame([(1, 0, 0, 0, 1, 30.0), (2, 9, 9, 9, 9, 30.0), (3, 0, 0, 0, 1, 60.0)], "road_id long, r1 int, c1 int, r2 int, c2 int, length_m double")
    found = {(r.scenario_id, r.lead_minutes, r.road_id): r for r in roads.road_impact(segments, depth).collect()}
    assert set(found) == {(s, lead, k) for s, lead in (("S", 0), ("S", 15), ("T", 0)) for k in (1, 2, 3)}
    assert found["S", 0, 1].classification == "IMPASSABLE" and found["S", 0, 1].missing_cells == 1 and found["S", 0, 3].impacted_length_m == 2 * found["S", 0, 1].impacted_length_m
    for key in (("S", 15, 1), ("S", 0, 2), ("T", 0, 2)):
        assert found[key].max_depth_m is None and found[key].classification is None and found[key].passability is None and found[key].n_cells == 0
    assert roads.road_impact(segments, depth.limit(0)).count() == 0


def test_ponding_against_steps(spark):
    """Water that stands, slot by slot, with dry slots and a store that fills up; blocks on a full side are lost."""
    import random

    from rillspark.operators import storms

    rng = random.Random(2)
    rows = [(k, t, rng.choice([0.0, 5.0, 40.0, 90.0]), 15) for k in range(5) for t in range(12)]
    found = {(r.storm_id, r.slot): r for r in storms.ponded(spark.createDataFrame(rows, "storm_id int, slot int, rate_mmh double, minutes int")).collect()}
    for k in range(5):
        store, wet, stands = 2.0, 0, 0.0
        for _, t, rate, minutes in (r for r in rows if r[0] == k):
            rain = rate * minutes / 60
            fill = min(store, rain)
            store, wet = store - fill, wet + (minutes if rate > 0 else 0)
            taken = min(stands + rain - fill, (2 + 23 * math.exp(-wet * 60 / 1800)) * minutes / 60)
            stands += rain - fill - taken
            assert abs(found[k, t].ponded_mm - stands) < 2e-6 and abs(found[k, t].infiltrated_mm - taken) < 2e-6
    blocks = storms.blocks_around_peak(spark.createDataFrame([(1, 60.0, 4, 15), (2, 60.0, 1, 15)], "storm_id int, total_mm double, n int, minutes int")).orderBy("storm_id", "slot").collect()
    share = [round(240 * ((k + 1) / 4) ** 0.4 - 240 * (k / 4) ** 0.4 + 1e-9, 2) for k in range(4)]
    assert [r.rate_mmh for r in blocks] == [0.0, share[2], share[0], share[1], 240.0]
