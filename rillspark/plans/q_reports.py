"""Queries on reports, costs, messages, fits, catalogs and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.policy import catalog, values
from rillspark.functions.shared import settled
from rillspark.operators import fields, frames, ledger, reports, roads, scores
from rillspark.plans import q_assets, q_geometry, q_nowcast, q_scores
from rillspark.plans.q_frames import ORACLES as FRAME_SQL
from rillspark.plans.q_frames import _alerts, _dense
from rillspark.plans.q_roads import CELLS_SQL, IMPACT_SQL, _impact
from rillspark.plans.testbed import SIDE, view, with_views
from rillspark.sources import feeds
from rillspark.sources.tables import table

# The culverts of the scenarios: depth that the box in the middle has more (m).
CULVERTS = (("S1", 15.0, 0.0, 1.0, 0.0), ("S2", 38.0, 0.0, 1.0, 0.0), ("S3", 72.0, 0.25, 0.35, 0.45), ("S4", 72.0, 0.45, 0.95, 0.08))
CULVERT_COLUMNS = "scenario_id, rate_mmh, surcharge_m, drained, culvert_m"
# Boxes of the test data, in cells; the second and third overlap.
CITIES = (("north", 0.0, 0.0, 66.0, 20.0), ("mid", 10.0, 21.0, 50.0, 45.0), ("centre", 20.0, 30.0, 66.0, 60.0))
CITY_COLUMNS = "city_id, west, south, east, north"
RUNS = "SELECT p_partkey AS run, CASE p_partkey % 4 WHEN 0 THEN 'REAL_TERRAIN_SYNTHETIC_HYDRAULICS' WHEN 1 THEN ' real_terrain_real_drainage ' WHEN 2 THEN 'OTHER' ELSE NULL END AS mode, CASE WHEN p_partkey % 3 = 0 THEN 'EPSG:32645' WHEN p_partkey % 3 = 1 THEN ' ' END AS crs, CASE WHEN p_partkey % 2 = 0 THEN 'survey office' END AS authority FROM {part}"


def _river_feed(spark, sf):
    """A feed for each customer: some empty, some broken, some without values."""
    k = F.col("c_custkey")
    full = F.concat(F.lit('{"daily": {"time": ["a", "b", "c"], "river_discharge": ['), (k % 90).cast("string"), F.lit(".5, null, "), (k % 70).cast("string"), F.lit('], "river_discharge_mean": ['), (k % 30).cast("string"), F.lit("]}}"))
    return table(spark, sf, "customer").select("c_custkey", F.when(k % 5 == 0, "{}").when(k % 5 == 1, "broken").when(k % 5 == 2, '{"daily": {"river_discharge": []}}').otherwise(full).alias("feed"))


def _dossiers(spark, sf):
    return reports.dossiers(view(spark, sf, "depth"), settled(_impact(spark, sf), "impact"), view(spark, sf, "ledger"), _alerts(spark, sf))


def _wards(spark, sf):
    return reports.ward_report(view(spark, sf, "depth"), roads.road_cells(view(spark, sf, "segment")), _impact(spark, sf), view(spark, sf, "asset"))


def _itemised(spark, sf):
    grids = settled(q_assets._grids(spark, sf), "grids")
    saved = reports.protected_assets(grids, view(spark, sf, "asset"))
    found = q_assets._effects(spark, sf, grids).join(saved.hint("merge"), ["scenario_id", "lead_minutes", "package"], "left").fillna(0, ["protected_assets"])
    return reports.itemised(found, q_assets._packages(spark))


def _messages(spark, sf):
    """The alerts with rings around their wet cells, a cell a unit, the latitude falling with the row."""
    depth = view(spark, sf, "depth").where("depth_m > 0.05").groupBy("scenario_id", "lead_minutes").agg(*(f(x).cast("double").alias(f"{n}_{x}") for n, f in (("min", F.min), ("max", F.max)) for x in ("r", "c")))
    ring = F.transform(reports.ring(F.col("min_r"), F.col("min_c"), F.col("max_r"), F.col("max_c"), 88.0, 23.0, 0.001), lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    named = _alerts(spark, sf).join(depth.hint("merge"), ["scenario_id", "lead_minutes"]).withColumns({"ring": ring, "parameters": F.create_map(F.lit("max_depth_m"), F.format_string("%.3f", F.col("max_depth_m")), F.lit("color"), F.col("color_band"))})
    return reports.alert_messages(named, "flood-desk")


def _validation(spark, sf):
    pairs = q_scores._extent_pairs(spark, sf)
    dry = pairs.where("r % 9 = 0").select((F.col("lead_minutes") + 1000).alias("lead_minutes"), F.lit(0.0).alias("s"), F.lit(0.0).alias("o"))
    flat = pairs.where("r % 9 = 1").select((F.col("lead_minutes") + 2000).alias("lead_minutes"), "s", F.lit(0.0).alias("o"))
    return reports.validation_fit(pairs.select("lead_minutes", "s", "o").unionByName(dry).unionByName(flat), "lead_minutes")


def _composite(spark, sf):
    """Fits of all scenarios; depths are compared with scenario N for A only."""
    pairs = q_scores._extent_pairs(spark, sf)
    e = F.col("s") - F.col("o")
    spatial = pairs.agg(F.sqrt(F.avg(e * e)).alias("spatial_rmse"), F.max("o").alias("max_observed")).withColumn("scenario_id", F.lit("A"))
    fits = scores.hydrograph_fit(q_scores._series(spark, sf), "scenario_id")
    return reports.with_spatial_loss(fits, spatial, "scenario_id").select("scenario_id", "loss", "spatial_rmse", "composite_loss")


def _gate(spark, sf):
    found = frames.accepted(view(spark, sf, "depth"), 7)
    return reports.acceptance(found, ledger.accepted_runs(ledger.residuals(view(spark, sf, "ledger"))))


def _unresolved(spark, sf):
    features = q_geometry._features(spark, sf)
    return reports.unresolved_types(q_geometry._mapped(spark, sf), features)


def _catalogs(spark, sf):
    """Assets and suppliers as shelters, each with its city by its box."""
    asset = view(spark, sf, "asset").select(F.col("asset_id").alias("site_id"), "name", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    shelter = table(spark, sf, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("name"), (F.col("c_custkey") * 3 % 90).cast("double").alias("x"), (F.col("c_custkey") * 7 % 80).cast("double").alias("y"))
    return reports.in_boxes(reports.united(("asset", asset), ("shelter", shelter)), catalog(spark, CITIES, CITY_COLUMNS))


def _city_frames(spark):
    return catalog(spark, CULVERTS, CULVERT_COLUMNS).crossJoin(spark.sql("SELECT CAST(id * 30 AS INT) AS lead_minutes FROM range(0, 6)"))


def _ground(spark, sf):
    """Every cell; where the table has none there is water."""
    every = spark.sql(f"SELECT CAST(id div {SIDE} AS INT) AS r, CAST(id % {SIDE} AS INT) AS c FROM range(0, {SIDE * SIDE})")
    return every.join(view(spark, sf, "dem").hint("merge"), ["r", "c"], "left").select("r", "c", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("land", F.lit(0)).alias("land"))


QUERIES = {
    "a46_dossiers": _dossiers,
    "a46_closed_roads": lambda s, d: reports.closed_roads(_impact(s, d)),
    "a12_ward_report": _wards,
    "f32_itemised": _itemised,
    "f29_alert_messages": _messages,
    "a23_validation_fit": _validation,
    "a22_composite_loss": _composite,
    "n4_blend_statistics": lambda s, d: reports.blend_statistics(q_nowcast._blend(s, d)),
    "a37_acceptance": _gate,
    "a40_unresolved_types": _unresolved,
    "s8_rivers": lambda s, d: feeds.rivers(_river_feed(s, d), "c_custkey"),
    "t10_first_features": lambda s, d: reports.first_features(view(s, d, "segment").select("road_class", "road_id", "length_m"), 2000, "road_id", "road_class").withColumn("place", F.col("place").cast("long")),
    "x1_sites_of_cities": _catalogs,
    "f42_labels": lambda s, d: reports.labelled(s.sql(RUNS, part=table(s, d, "part")), "authority").select("run", "content_label", "crs_provenance"),
    "w13_clear_window_from": lambda s, d: frames.clear_window(_dense(s, d), 3, (20, 30)),
    "f38_city_ponding": lambda s, d: fields.city_ponding(_ground(s, d), _city_frames(s)),
}

_BASE = with_views("depth", "segment")
_ALERTS = "alerts AS (" + FRAME_SQL["f28_alert_records"] + ")"
ORACLES = {
    "a46_dossiers": with_views("depth", "segment", "ledger") + f",{CELLS_SQL},{IMPACT_SQL},{_ALERTS}" + """,
fl AS (SELECT scenario_id, lead_minutes, count(*) AS cells, max(depth_m) AS max_depth_m, count(*) FILTER (depth_m > 0.05) * CAST(900 AS DOUBLE) AS flooded_area_m2, round(sum(depth_m) * 900 + 1e-6, 3) AS surface_storage_m3 FROM depth GROUP BY scenario_id, lead_minutes),
pk AS (SELECT scenario_id, lead_minutes AS peak_lead_minutes FROM fl QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY max_depth_m DESC, lead_minutes) = 1),
rd AS (SELECT scenario_id, lead_minutes, count(*) AS total_roads, count(*) FILTER (classification = 'IMPASSABLE') AS impassable_roads, count(*) FILTER (classification = 'CAUTION') AS caution_roads, count(*) FILTER (classification = 'DRY') AS dry_roads FROM impact GROUP BY scenario_id, lead_minutes),
lb AS (SELECT scenario_id, sum(rain_m3) AS rain, sum(ext_in_m3) AS ext, sum(outfall_m3) AS outf, sum(rain_m3) + sum(ext_in_m3) - sum(losses_m3) - sum(surf_out_m3) - sum(outfall_m3) - sum(s_s1 - s_s0 + s_d1 - s_d0) AS lft FROM ledger GROUP BY scenario_id),
bl AS (SELECT scenario_id, round(rain + 1e-6, 3) AS rainfall_m3, round(outf + 1e-6, 3) AS outfall_m3, round(lft + 1e-6, 3) AS residual_m3, round(abs(lft) / greatest(abs(rain) + abs(ext), 1e-6) * 100 + 1e-9, 4) AS relative_error_pct FROM lb),
al AS (SELECT scenario_id, lead_minutes, alert_id, headline, severity AS alert_severity, instruction FROM alerts),
jn AS (SELECT *, round(flooded_area_m2 / (cells * 900) * 100 + 1e-9, 4) AS inundated_pct, round(CASE WHEN lead_minutes <= 30 THEN 1 WHEN lead_minutes >= 150 THEN 0 ELSE 1 - (lead_minutes - 30) / CAST(120 AS DOUBLE) END + 1e-9, 4) AS w
  FROM fl JOIN rd USING (scenario_id, lead_minutes) JOIN pk USING (scenario_id) LEFT JOIN bl USING (scenario_id) LEFT JOIN al USING (scenario_id, lead_minutes))
SELECT 'DOSSIER-' || scenario_id || '-' || lpad(lead_minutes::VARCHAR, 3, '0') AS dossier_id, scenario_id, lead_minutes,
  CASE WHEN max_depth_m >= 0.5 OR impassable_roads >= 2 THEN 'EXTREME RED' WHEN max_depth_m >= 0.3 OR impassable_roads >= 1 THEN 'SEVERE ORANGE' WHEN max_depth_m >= 0.15 OR caution_roads >= 2 THEN 'MODERATE AMBER' ELSE 'MINOR GREEN' END AS severity_level,
  max_depth_m, flooded_area_m2, surface_storage_m3, inundated_pct, peak_lead_minutes, rainfall_m3, outfall_m3, round(greatest(0.0, rainfall_m3 - outfall_m3 - surface_storage_m3) + 1e-6, 3) AS conduit_storage_m3, residual_m3, relative_error_pct,
  relative_error_pct < 0.05 AS closed_balance, total_roads, impassable_roads, caution_roads, dry_roads, alert_id, headline, alert_severity, instruction, round(w * 100, 2) AS radar_weight_pct, round((1 - w) * 100, 2) AS nwp_weight_pct,
  'Scenario ' || scenario_id || ': water up to ' || printf('%.2f', round(max_depth_m + 1e-9, 2)) || ' m, ' || printf('%.1f', round(inundated_pct + 1e-9, 1)) || '% of the area wet, ' || impassable_roads || ' roads closed.' AS summary_text FROM jn""",
    "a46_closed_roads": _BASE + f",{CELLS_SQL},{IMPACT_SQL} SELECT 'DOSSIER-' || scenario_id || '-' || lpad(lead_minutes::VARCHAR, 3, '0') AS dossier_id, road_id FROM impact WHERE classification = 'IMPASSABLE'",
    "a12_ward_report": with_views("depth", "segment", "asset") + f""",{CELLS_SQL},{IMPACT_SQL},
rc AS (SELECT r, c, count(DISTINCT road_id) AS roads FROM cells GROUP BY r, c), st AS (SELECT r, c, count(*) AS sites FROM asset GROUP BY r, c),
su AS (SELECT scenario_id, lead_minutes, CAST(r // 10 AS INT) AS ward_r, CAST(c // 10 AS INT) AS ward_c, count(*) FILTER (depth_m > 0.05) * CAST(900 AS DOUBLE) AS wet_area_m2, count(*) FILTER (depth_m > 0.3) * CAST(900 AS DOUBLE) AS severe_area_m2,
  max(depth_m) AS max_depth_m, round(avg(depth_m) + 1e-9, 6) AS mean_depth_m, coalesce(sum(roads) FILTER (depth_m > 0.05), 0) * CAST(30 AS DOUBLE) AS wet_road_m, CAST(coalesce(sum(sites) FILTER (depth_m > 0.3), 0) AS BIGINT) AS flooded_assets
  FROM depth LEFT JOIN rc USING (r, c) LEFT JOIN st USING (r, c) GROUP BY ALL),
pw AS (SELECT DISTINCT road_id, CAST(r // 10 AS INT) AS ward_r, CAST(c // 10 AS INT) AS ward_c FROM cells),
rw AS (SELECT scenario_id, lead_minutes, ward_r, ward_c, count(*) FILTER (classification = 'IMPASSABLE') AS impassable_roads, count(*) FILTER (classification <> 'IMPASSABLE') AS caution_roads
       FROM pw JOIN impact USING (road_id) WHERE classification IN ('IMPASSABLE', 'CAUTION', 'HIGH_IMPACT') GROUP BY ALL),
fw AS (SELECT scenario_id, lead_minutes, CAST(r // 10 AS INT) AS ward_r, CAST(c // 10 AS INT) AS ward_c, string_agg(name, ', ' ORDER BY name) AS facilities FROM depth JOIN asset USING (r, c) WHERE depth_m > 0.3 GROUP BY ALL)
SELECT su.*, coalesce(impassable_roads, 0) AS impassable_roads, coalesce(caution_roads, 0) AS caution_roads, coalesce(facilities, '') AS facilities_at_risk
FROM su LEFT JOIN rw USING (scenario_id, lead_minutes, ward_r, ward_c) LEFT JOIN fw USING (scenario_id, lead_minutes, ward_r, ward_c)""",
    "f32_itemised": with_views("depth", "segment", "asset") + f""",{CELLS_SQL},{q_assets.MITIGATION_SQL},
pa AS (SELECT scenario_id, lead_minutes, package, count(*) FILTER (base_m >= critical_depth_m AND depth_m < critical_depth_m) AS n FROM grids JOIN asset USING (r, c) GROUP BY ALL),
x AS (SELECT e.*, p.lid * 100000 * 1800 AS lc, p.basin_m3 * 450 AS bc, p.pump_m3s * 2500000 AS pc, CASE WHEN p.unblock THEN CAST(1500000 AS DOUBLE) ELSE 0 END AS dc, area_reduction_m2 * 1200 AS ag, volume_reduction_m3 * 180 AS vg,
        reopened_roads * CAST(2500000 AS DOUBLE) AS rg, coalesce(n, 0) * CAST(5000000 AS DOUBLE) AS sg FROM effects e JOIN packages p USING (package) LEFT JOIN pa USING (scenario_id, lead_minutes, package))
SELECT scenario_id, lead_minutes, package, round(lc + 1e-9, 2) AS lid_cost_inr, round(bc + 1e-9, 2) AS basin_cost_inr, round(pc + 1e-9, 2) AS pump_cost_inr, round(dc + 1e-9, 2) AS desilting_cost_inr, round(ag + 1e-9, 2) AS property_inr, round(vg + 1e-9, 2) AS volume_inr,
  round(rg + 1e-9, 2) AS traffic_inr, round(sg + 1e-9, 2) AS assets_inr, round(lc + bc + pc + dc + 1e-9, 2) AS capex_inr, round((lc + bc + pc + dc) / 1e7 + 1e-9, 3) AS capex_crores, round(ag + vg + rg + sg + 1e-9, 2) AS avoided_inr, round((ag + vg + rg + sg) / 1e7 + 1e-9, 3) AS avoided_crores FROM x""",
    "f29_alert_messages": with_views("depth") + f",{_ALERTS}" + """,
bx AS (SELECT scenario_id, lead_minutes, CAST(min(r) AS DOUBLE) AS r0, CAST(min(c) AS DOUBLE) AS c0, CAST(max(r) AS DOUBLE) AS r1, CAST(max(c) AS DOUBLE) AS c1 FROM depth WHERE depth_m > 0.05 GROUP BY ALL),
k AS (SELECT *, printf('%.6f', 23.0::DOUBLE - r0 * 0.001::DOUBLE) AS top, printf('%.6f', 23.0::DOUBLE - (r1 + 1) * 0.001::DOUBLE) AS low, printf('%.6f', 88.0::DOUBLE + c0 * 0.001::DOUBLE) AS lft, printf('%.6f', 88.0::DOUBLE + (c1 + 1) * 0.001::DOUBLE) AS rgt FROM alerts JOIN bx USING (scenario_id, lead_minutes)),
p AS (SELECT *, top || ',' || lft || ' ' || top || ',' || rgt || ' ' || low || ',' || rgt || ' ' || low || ',' || lft || ' ' || top || ',' || lft AS ring, strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') AS since, strftime(expires, '%Y-%m-%dT%H:%M:%SZ') AS till FROM k),
m AS (SELECT alert_id, ring AS polygon, '{"identifier":"' || alert_id || '","sender":"flood-desk","sent":"' || since || '","status":"' || status || '","msg_type":"Alert","scope":"Public","info":[{"headline":"' || headline || '","description":"' || description || '","instruction":"' || instruction
  || '","urgency":"' || urgency || '","severity":"' || severity || '","certainty":"' || certainty || '","effective":"' || since || '","expires":"' || till || '","area":{"area_desc":"' || area || '","polygon":"' || ring || '"},"parameters":[{"name":"color","value":"' || color_band || '"},{"name":"max_depth_m","value":"'
  || printf('%.3f', max_depth_m) || '"}]}]}' AS message FROM p)
SELECT alert_id, polygon, message, sha256(message) AS digest FROM m""",
    "a23_validation_fit": with_views("depth") + """,
p0 AS (SELECT lead_minutes, r, a.depth_m AS s, b.depth_m AS o FROM (SELECT * FROM depth WHERE scenario_id = 'A') a JOIN (SELECT * FROM depth WHERE scenario_id = 'N') b USING (lead_minutes, r, c)),
p AS (SELECT lead_minutes, s, o FROM p0 UNION ALL SELECT lead_minutes + 1000, 0.0::DOUBLE, 0.0::DOUBLE FROM p0 WHERE r % 9 = 0 UNION ALL SELECT lead_minutes + 2000, s, 0.0::DOUBLE FROM p0 WHERE r % 9 = 1),
m AS (SELECT lead_minutes, count(*) AS n, avg(s) AS ms, avg(o) AS mo, stddev_pop(s) AS ds, stddev_pop(o) AS dv, covar_pop(s, o) AS cov, sum((s - o) * (s - o)) AS sse, bool_and(abs(s - o) <= 1e-6 + 1e-5 * abs(o)) AS eq FROM p GROUP BY lead_minutes),
k AS (SELECT *, CASE WHEN dv * dv * n <= 1e-12 THEN CASE WHEN sse <= 1e-12 THEN 1.0 ELSE '-inf'::DOUBLE END ELSE 1 - sse / (dv * dv * n) END AS nse, CASE WHEN eq THEN 1.0 WHEN ds > 1e-12 AND dv > 1e-12 THEN greatest(-1.0, least(1.0, cov / (ds * dv))) ELSE 0.0 END AS rr,
  CASE WHEN eq THEN 1.0 WHEN dv > 1e-12 THEN ds / dv ELSE 0.0 END AS al, CASE WHEN eq THEN 1.0 WHEN abs(mo) > 1e-12 THEN ms / mo WHEN abs(ms - mo) <= 1e-6 THEN 1.0 WHEN ms > 0 THEN ms ELSE 0.0 END AS be FROM m)
SELECT lead_minutes, n, CASE WHEN isinf(nse) THEN nse ELSE round(nse + 1e-9, 4) END AS nse, round(CASE WHEN eq THEN 1.0 ELSE 1 - sqrt((rr - 1) * (rr - 1) + (al - 1) * (al - 1) + (be - 1) * (be - 1)) END + 1e-9, 4) AS kge, round(rr + 1e-9, 4) AS r, round(al + 1e-9, 4) AS alpha, round(be + 1e-9, 4) AS beta FROM k""",
    "a22_composite_loss": "WITH fit AS (" + q_scores.ORACLES["a18_hydrograph_fit"] + """), a AS (SELECT l_linenumber, l_orderkey % 67 AS r, l_partkey % 67 AS c, l_returnflag AS f, max(l_quantity)::DOUBLE / 80 AS d FROM lineitem GROUP BY ALL),
sp AS (SELECT 'A' AS scenario_id, sqrt(avg((x.d - y.d) * (x.d - y.d))) AS rm, max(y.d) AS mx FROM a x JOIN a y ON x.f = 'A' AND y.f = 'N' AND x.l_linenumber = y.l_linenumber AND x.r = y.r AND x.c = y.c)
SELECT scenario_id, loss, round(rm + 1e-9, 6) AS spatial_rmse, round(CASE WHEN rm IS NULL THEN loss ELSE loss * CAST(0.9 AS DOUBLE) + CAST(0.1 AS DOUBLE) * least(5.0, rm / greatest(mx, 0.01)) END + 1e-9, 6) AS composite_loss FROM fit LEFT JOIN sp USING (scenario_id)""",
    "n4_blend_statistics": "WITH b AS (" + q_nowcast.ORACLES["n4_blended"] + ") SELECT lead_minutes, blending_mode, count(*) AS cells, round(min(rate_mmh) + 1e-9, 6) AS min_mmh, round(max(rate_mmh) + 1e-9, 6) AS max_mmh, round(avg(rate_mmh) + 1e-9, 6) AS mean_mmh FROM b GROUP BY ALL",
    "a37_acceptance": "WITH f AS (" + FRAME_SQL["a37_accepted"] + "), b AS (" + FRAME_SQL["a8_accepted_runs"] + ") SELECT scenario_id, f.accepted AS frames_accepted, coalesce(overall_status, 'missing') AS balance_status, f.accepted AND overall_status = 'pass' AS accepted FROM f FULL JOIN b USING (scenario_id)",
    "a40_unresolved_types": "WITH m AS (" + q_geometry.ORACLES["f24_geometry_ladder"] + ") SELECT ' SRC' || (ord % 4) AS source_type, count(*) AS n FROM m WHERE status = 'UNRESOLVED_TYPE' GROUP BY ALL",
    "s8_rivers": """SELECT c_custkey, CASE WHEN c_custkey % 5 >= 3 THEN 2 ELSE 0 END AS days, CASE WHEN c_custkey % 5 >= 3 THEN c_custkey % 90 + 0.5::DOUBLE ELSE 0 END AS discharge_cms,
CASE WHEN c_custkey % 5 >= 3 THEN greatest(c_custkey % 90 + 0.5::DOUBLE, c_custkey % 70) END AS highest_cms, CASE WHEN c_custkey % 5 >= 3 THEN CAST(c_custkey % 30 AS DOUBLE) END AS mean_cms FROM customer""",
    "t10_first_features": with_views("segment") + " SELECT road_class, road_id, length_m, row_number() OVER (PARTITION BY road_class ORDER BY road_id) AS place FROM segment QUALIFY place <= 2000",
    "x1_sites_of_cities": with_views("asset") + f""",
s AS (SELECT 'asset' AS catalog, asset_id::VARCHAR AS site_id, name, c::DOUBLE AS x, r::DOUBLE AS y FROM asset UNION ALL SELECT 'shelter', c_custkey::VARCHAR, c_name, (c_custkey * 3 % 90)::DOUBLE, (c_custkey * 7 % 80)::DOUBLE FROM customer WHERE c_custkey % 20 = 0)
SELECT s.*, min(city_id) AS city_id FROM s JOIN ({values(CITIES, CITY_COLUMNS)}) b ON x BETWEEN west AND east AND y BETWEEN south AND north GROUP BY ALL""",
    "f42_labels": """SELECT p_partkey AS run, CASE p_partkey % 4 WHEN 0 THEN 'REAL_TERRAIN+SYNTHETIC_HYDRAULICS' WHEN 1 THEN 'REAL_TERRAIN+REAL_DRAINAGE_GEOMETRY' ELSE 'SYNTHETIC' END AS content_label,
CASE WHEN p_partkey % 3 = 0 THEN 'EMBEDDED' WHEN p_partkey % 2 = 0 THEN 'AUTHORITATIVE_EXTERNAL' ELSE 'UNVERIFIED' END AS crs_provenance FROM part""",
    "w13_clear_window_from": FRAME_SQL["w13_clear_window"].replace("n = 9 ORDER", "n = 9 AND (r > 20 OR (r = 20 AND c >= 30)) ORDER"),
    "f38_city_ponding": with_views("dem") + f""",
sc AS (SELECT * FROM ({values(CULVERTS, CULVERT_COLUMNS)}) CROSS JOIN (SELECT CAST(i * 30 AS INT) AS lead_minutes FROM range(0, 6) AS t(i))),
g AS (SELECT CAST(i // {SIDE} AS INT) AS r, CAST(i % {SIDE} AS INT) AS c FROM range(0, {SIDE * SIDE}) AS t(i)), d AS (SELECT r, c, coalesce(z, 0) AS z, coalesce(land, 0) AS land FROM g LEFT JOIN dem USING (r, c)),
s AS (SELECT *, CASE WHEN lag(z) OVER x IS NULL THEN lead(z) OVER x - z WHEN lead(z) OVER x IS NULL THEN z - lag(z) OVER x ELSE (lead(z) OVER x - lag(z) OVER x) / 2 END AS gx,
             CASE WHEN lag(z) OVER y IS NULL THEN lead(z) OVER y - z WHEN lead(z) OVER y IS NULL THEN z - lag(z) OVER y ELSE (lead(z) OVER y - lag(z) OVER y) / 2 END AS gy FROM d WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)),
p AS (SELECT max(z) AS high, max(z) - min(z) AS span FROM d),
w AS (SELECT *, CASE WHEN lead_minutes <= 90 THEN sin(lead_minutes / CAST(90 AS DOUBLE) * CAST(1.5707963267948966 AS DOUBLE)) ELSE exp(-(lead_minutes - 90) / CAST(45 AS DOUBLE)) END AS f FROM s CROSS JOIN p CROSS JOIN sc),
q AS (SELECT *, round(greatest(0::DOUBLE, rate_mmh * f - (12 + 25 * drained)) / 1000 * (lead_minutes / CAST(60 AS DOUBLE)) * (0.6::DOUBLE * exp(-8 * sqrt(gx * gx + gy * gy)) + 1.4::DOUBLE * pow(least(1::DOUBLE, greatest(0::DOUBLE, (high - z) / greatest(span, 1::DOUBLE))), 1.8::DOUBLE)) + 1e-9, 6) AS depth FROM w)
SELECT scenario_id, lead_minutes, r, c, round(CASE WHEN land = 1 THEN greatest(0::DOUBLE, depth + CASE WHEN r BETWEEN {SIDE // 2 - 15} AND {SIDE // 2 + 14} AND c BETWEEN {SIDE // 2 - 15} AND {SIDE // 2 + 14} THEN culvert_m * f ELSE 0 END) ELSE 0 END + 1e-9, 5) AS depth_m FROM q""",
}
