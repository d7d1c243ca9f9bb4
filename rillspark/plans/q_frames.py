"""Queries on depth frames, nearest nodes and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import alerts, frames, ledger, roads
from rillspark.plans.q_roads import ORACLES as ROAD_SQL
from rillspark.plans.testbed import view, with_views

LEADS = "SELECT CAST(id * 5 AS INT) AS lead_minutes FROM range(0, 19)"
KEYS = "SELECT CAST(id * 15 AS INT) AS lead_minutes FROM range(0, 7)"


def _depth(spark, sf):
    return view(spark, sf, "depth")


def _alerts(spark, sf):
    depth = _depth(spark, sf)
    return alerts.records(roads.screened_frames(depth, roads.road_impact(view(spark, sf, "segment"), depth)), "Canal basin and surroundings")


def _points(spark, sf):
    return view(spark, sf, "asset").select(F.col("asset_id").alias("point_id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))


def _nodes(spark, sf):
    """Nodes are the starts of the segments, one a cell."""
    return view(spark, sf, "segment").groupBy("r1", "c1").agg(F.min("road_id").alias("node")).select("node", F.col("c1").cast("double").alias("nx"), F.col("r1").cast("double").alias("ny"))


def _projected(spark, sf):
    x, y = frames.cell_to_projected(F.col("r"), F.col("c"))
    r, c = frames.projected_to_cell(F.col("x"), F.col("y"))
    return view(spark, sf, "asset").select("asset_id", x.alias("x"), y.alias("y")).withColumns({"row": r, "col": c})


def _dense(spark, sf):
    """A dense grid: cells that scenario A holds at no lead are bad."""
    have = _depth(spark, sf).where("scenario_id = 'A'").select("r", "c").distinct().withColumn("have", F.lit(True))
    every = spark.sql("SELECT CAST(id div 67 AS INT) AS r, CAST(id % 67 AS INT) AS c FROM range(0, 4489)")
    return every.join(have.hint("merge"), ["r", "c"], "left").select("r", "c", F.col("have").isNull().alias("bad"))


QUERIES = {
    "a6_snapshots": lambda s, d: frames.snapshots(_depth(s, d)),
    "a7_peaks": lambda s, d: frames.peaks(frames.snapshots(_depth(s, d))),
    "j10_interpolated": lambda s, d: frames.interpolated(_depth(s, d), s.sql(LEADS), s.sql(KEYS)),
    "a35_compared": lambda s, d: ledger.blockage(view(s, d, "ledger"), "N", "R"),
    "a9_residuals": lambda s, d: ledger.residuals(view(s, d, "ledger")).select("run_id", "scenario_id", "residual_surface_m3", "residual_drainage_m3", "residual_total_m3", "relative_total", "balance_status"),
    "a8_accepted_runs": lambda s, d: ledger.accepted_runs(ledger.residuals(view(s, d, "ledger"))),
    "a37_accepted": lambda s, d: frames.accepted(_depth(s, d), 7),
    "j16_paired_cells": lambda s, d: frames.blends(_depth(s, d).where("scenario_id = 'A'"), _depth(s, d).where("scenario_id = 'R'").withColumn("scenario_id", F.lit("A"))),
    "j6_nearest_nodes": lambda s, d: frames.nearest_nodes(_points(s, d), _nodes(s, d), 2.0).select("point_id", "node", roads.steady(F.col("distance")).alias("distance")),
    "j5_nearest_within": lambda s, d: frames.nearest_within(_points(s, d), _nodes(s, d), 1.5).select("point_id", "node", roads.steady(F.col("distance")).alias("distance")),
    "p1_projected": _projected,
    "a34_scenario_rows": lambda s, d: frames.scenario_rows(frames.snapshots(_depth(s, d)), view(s, d, "ledger")),
    "p19_balance_terms": lambda s, d: ledger.identity(view(s, d, "ledger")),
    "s18_alert_feed": lambda s, d: alerts.syndicated(_alerts(s, d)),
    "w13_clear_window": lambda s, d: frames.clear_window(_dense(s, d), 3),
    "f28_alert_records": _alerts,
    "j24_dispatched": lambda s, d: alerts.dispatched(_alerts(s, d)),
    "t6_alert_history": lambda s, d: alerts.history(_alerts(s, d), 5).select("alert_id", "severity", "valid_from"),
}

_D, _L = with_views("depth"), with_views("ledger")
BALANCE_SQL = """
r AS (SELECT *, rain_m3 - losses_m3 - surf_out_m3 - s2d_m3 + d2s_m3 + flood_export_m3 - (s_s1 - s_s0) AS rs, ext_in_m3 + s2d_m3 - d2s_m3 - flood_export_m3 - outfall_m3 - (s_d1 - s_d0) AS rd,
             rain_m3 + ext_in_m3 - losses_m3 - surf_out_m3 - outfall_m3 - (s_s1 - s_s0) - (s_d1 - s_d0) AS rt FROM ledger),
q AS (SELECT *, abs(rt) / greatest(abs(rain_m3) + abs(ext_in_m3), 1e-6) AS rel FROM r),
balances AS (SELECT *, round(rs + 1e-9, 6) AS residual_surface_m3, round(rd + 1e-9, 6) AS residual_drainage_m3, round(rt + 1e-9, 6) AS residual_total_m3, round(rel + 1e-9, 6) AS relative_total,
  CASE WHEN rel <= 0.01 OR (abs(rt) <= 1e-6 AND rain_m3 = 0 AND ext_in_m3 = 0) THEN 'pass' WHEN rel <= 0.05 THEN 'warning' ELSE 'fail' END AS balance_status FROM q)"""
SNAP_SQL = """
snap AS (SELECT scenario_id, lead_minutes, count(*) AS cells, max(depth_m) AS max_depth_m, count(*) FILTER (depth_m > 0.05) AS flooded_cells, count(*) FILTER (depth_m > 0.05) * CAST(900 AS DOUBLE) AS flooded_area_m2,
                round(avg(depth_m) + 1e-9, 6) AS mean_depth_m, round(sum(depth_m) * 900 + 1e-6, 3) AS storage_m3 FROM depth GROUP BY scenario_id, lead_minutes)"""
ALERT_SQL = f"""
screened AS ({ROAD_SQL["a11_screened_frames"]}),
alerts AS (SELECT 'FLOOD-' || scenario_id || '-' || lpad(CAST(lead_minutes AS VARCHAR), 3, '0') AS alert_id, scenario_id, lead_minutes, 'Exercise' AS status, severity, urgency, certainty, color_band,
  event || ' for Canal basin and surroundings - depth ' || printf('%.2f m', round(max_depth_m + 1e-9, 2)) AS headline, TIMESTAMP '2026-08-21 06:00:00' + to_minutes(lead_minutes) AS valid_from,
  TIMESTAMP '2026-08-21 06:00:00' + to_minutes(lead_minutes) + INTERVAL '2 hours' AS expires, min_r || ',' || min_c || ' ' || min_r || ',' || max_c || ' ' || max_r || ',' || max_c || ' ' || max_r || ',' || min_c || ' ' || min_r || ',' || min_c AS polygon,
  'Canal basin and surroundings' AS area, max_depth_m, 'Water up to ' || printf('%.2f m', round(max_depth_m + 1e-9, 2)) || ' in the area.' AS description, 'Avoid waterlogged roads.' AS instruction FROM screened)"""
_A = f"WITH {ALERT_SQL}"
ORACLES = {
    "a6_snapshots": _D + f",{SNAP_SQL} SELECT * FROM snap",
    "a7_peaks": _D + f",{SNAP_SQL} SELECT scenario_id, max(max_depth_m) AS peak_depth_m, arg_max(lead_minutes, max_depth_m * 1000000 - lead_minutes) AS peak_lead_minutes, max(flooded_area_m2) AS peak_area_m2 FROM snap GROUP BY scenario_id",
    "j10_interpolated": _D + """,
n AS (SELECT CAST(i * 5 AS INT) AS lead_minutes, CAST(i * 5 // 15 * 15 AS INT) AS low, CAST((i * 5 + 14) // 15 * 15 AS INT) AS high FROM range(0, 19) AS t(i)),
b AS (SELECT a.scenario_id, n.lead_minutes, a.r, a.c, a.depth_m AS a, b.depth_m AS b, CASE WHEN high > low THEN (n.lead_minutes - low) / CAST(high - low AS DOUBLE) ELSE 0 END AS al
      FROM depth a JOIN n ON n.low = a.lead_minutes JOIN depth b ON b.scenario_id = a.scenario_id AND b.lead_minutes = n.high AND b.r = a.r AND b.c = a.c)
SELECT scenario_id, lead_minutes, r, c, round(greatest(CAST(0 AS DOUBLE), (1 - al) * a + al * b) + 1e-9, 4) AS depth_m FROM b""",
    "a35_compared": _L + f""",
x AS (SELECT a.run_id, b.peak_depth_m - a.peak_depth_m AS d, b.max_flooded_area_m2 - a.max_flooded_area_m2 AS f, (b.s_s1 - b.s_s0) - (a.s_s1 - a.s_s0) AS v, b.max_surcharge_m - a.max_surcharge_m AS h,
             a.s2d_m3 - b.s2d_m3 AS k, b.d2s_m3 - a.d2s_m3 AS sp, a.outfall_m3 - b.outfall_m3 AS o, a.d2s_m3 AS ad, b.d2s_m3 AS bd FROM ledger a JOIN ledger b ON a.run_id = b.run_id AND a.scenario_id = 'N' AND b.scenario_id = 'R')
SELECT run_id, round(d + 1e-9, 6) AS delta_peak_depth_m, round(f + 1e-9, 4) AS delta_flooded_area_m2, round(v + 1e-9, 4) AS delta_surface_storage_change_m3, round(h + 1e-9, 6) AS delta_max_surcharge_m, round(k + 1e-9, 4) AS capture_reduction_m3,
       round(sp + 1e-9, 4) AS additional_spill_m3, round(o + 1e-9, 4) AS outfall_reduction_m3, CASE WHEN sp > 0 AND o > 0 AND d >= 0 THEN 'PHYSICALLY CONSISTENT' WHEN ad = 0 AND bd = 0 THEN 'NO SURCHARGE \u2014 REVIEW' ELSE 'REVIEW REQUIRED' END AS interpretation_status FROM x""",
    "a9_residuals": _L + f",{BALANCE_SQL} SELECT run_id, scenario_id, residual_surface_m3, residual_drainage_m3, residual_total_m3, relative_total, balance_status FROM balances",
    "a8_accepted_runs": _L + f""",{BALANCE_SQL}
SELECT scenario_id, count(*) AS runs, count(*) FILTER (balance_status = 'pass') AS passed, count(*) FILTER (balance_status = 'warning') AS warned, count(*) FILTER (balance_status = 'fail') AS failed, max(relative_total) AS worst_relative,
       CASE WHEN count(*) FILTER (balance_status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (balance_status = 'warning') > 0 THEN 'warning' ELSE 'pass' END AS overall_status FROM balances GROUP BY scenario_id""",
    "a37_accepted": _D + """,
n AS (SELECT scenario_id, count(*) FILTER (depth_m IS NULL OR isnan(depth_m) OR isinf(depth_m)) AS not_finite, count(*) FILTER (depth_m < -1e-12) AS negative, count(DISTINCT lead_minutes) AS leads FROM depth GROUP BY scenario_id)
SELECT *, not_finite = 0 AND negative = 0 AND leads = 7 AS accepted FROM n""",
    "j16_paired_cells": _D + """,
a AS (SELECT * FROM depth WHERE scenario_id = 'A'), b AS (SELECT 'A' AS scenario_id, lead_minutes, r, c, depth_m FROM depth WHERE scenario_id = 'R')
SELECT coalesce(a.scenario_id, b.scenario_id) AS scenario_id, coalesce(a.lead_minutes, b.lead_minutes) AS lead_minutes, count(*) FILTER (a.depth_m IS NOT NULL AND b.depth_m IS NOT NULL) AS matched,
       count(*) FILTER (b.depth_m IS NULL) AS only_first, count(*) FILTER (a.depth_m IS NULL) AS only_second
FROM a FULL JOIN b ON a.lead_minutes = b.lead_minutes AND a.r = b.r AND a.c = b.c GROUP BY 1, 2""",
    "j6_nearest_nodes": with_views("asset", "segment") + """,
n AS (SELECT min(road_id) AS node, r1, c1 FROM segment GROUP BY r1, c1),
d AS (SELECT asset_id AS point_id, node, (c - c1) * (c - c1) + (r - r1) * (r - r1) AS d2 FROM asset CROSS JOIN n)
SELECT point_id, node, round(sqrt(CAST(d2 AS DOUBLE)) + 1e-9, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, node) AS k FROM d) WHERE k = 1""",
    "j5_nearest_within": with_views("asset", "segment") + """,
n AS (SELECT min(road_id) AS node, r1, c1 FROM segment GROUP BY r1, c1),
d AS (SELECT asset_id AS point_id, node, (c - c1) * (c - c1) + (r - r1) * (r - r1) AS d2 FROM asset CROSS JOIN n WHERE (c - c1) * (c - c1) + (r - r1) * (r - r1) <= 2.25)
SELECT point_id, node, round(sqrt(CAST(d2 AS DOUBLE)) + 1e-9, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, node) AS k FROM d) WHERE k = 1""",
    "a34_scenario_rows": with_views("depth", "ledger") + f""",{SNAP_SQL},
p AS (SELECT scenario_id, max(max_depth_m) AS peak_depth_m, arg_max(lead_minutes, max_depth_m * 1000000 - lead_minutes) AS peak_lead_minutes, max(flooded_area_m2) AS peak_area_m2 FROM snap GROUP BY scenario_id),
l AS (SELECT scenario_id, count(*) AS runs, round(sum(rain_m3) + 1e-6, 3) AS rain_m3, round(sum(s2d_m3) + 1e-6, 3) AS s2d_m3, round(sum(d2s_m3) + 1e-6, 3) AS d2s_m3, round(sum(outfall_m3) + 1e-6, 3) AS outfall_m3, max(max_surcharge_m) AS max_surcharge_m FROM ledger GROUP BY scenario_id)
SELECT *, max_surcharge_m > 0 AS surcharged FROM p JOIN l USING (scenario_id)""",
    "p19_balance_terms": _L + """,
t AS (SELECT run_id, scenario_id, unnest(['rain', 'external', 'losses', 'surface_outflow', 'outfall', 'storage_change']) AS term,
      unnest([rain_m3, ext_in_m3, -losses_m3, -surf_out_m3, -outfall_m3, -(s_s1 - s_s0 + s_d1 - s_d0)]) AS volume_m3 FROM ledger) SELECT * FROM t""",
    "s18_alert_feed": _A + """ SELECT alert_id, '<entry><id>' || alert_id || '</id><title>' || replace(replace(replace(headline, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><updated>' || strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') || '</updated><georss:polygon>' || replace(polygon, ',', ' ') || '</georss:polygon></entry>' AS entry FROM alerts""",
    "p1_projected": with_views("asset") + """
, p AS (SELECT asset_id, CAST(300000 AS DOUBLE) + (c + CAST(0.5 AS DOUBLE)) * 30 AS x, CAST(2504020 AS DOUBLE) - (r + CAST(0.5 AS DOUBLE)) * 30 AS y FROM asset)
SELECT *, CAST(trunc((2504020 - y) / 30) AS INT) AS row, CAST(trunc((x - 300000) / 30) AS INT) AS col FROM p""",
    "w13_clear_window": _D + """,
h AS (SELECT DISTINCT r, c FROM depth WHERE scenario_id = 'A'),
g AS (SELECT CAST(i // 67 AS INT) AS r, CAST(i % 67 AS INT) AS c FROM range(0, 4489) AS t(i)),
b AS (SELECT g.r, g.c, CASE WHEN h.r IS NULL THEN 1 ELSE 0 END AS bad FROM g LEFT JOIN h ON h.r = g.r AND h.c = g.c),
x AS (SELECT r, c, sum(bad) OVER w AS bad, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)),
y AS (SELECT r, c, sum(bad) OVER w AS bad, sum(n) OVER w AS n FROM x WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT r, c FROM y WHERE bad = 0 AND n = 9 ORDER BY r, c LIMIT 1""",
    "f28_alert_records": _A + " SELECT * FROM alerts",
    "j24_dispatched": _A + """,
e AS (SELECT *, unnest(['SMS', 'WHATSAPP', 'WEB_PUSH', 'EMAIL']) AS channel FROM alerts),
m AS (SELECT alert_id, channel, CASE WHEN channel = 'SMS' THEN substr('[' || upper(status) || '] ' || upper(severity) || ' FLOOD: ' || substr(area, 1, 24) || '. Depth ~' || printf('%.2f', round(max_depth_m + 1e-9, 2)) || 'm. Avoid blocked roads. Detour: http://localhost:8000', 1, 160)
  ELSE CASE WHEN severity IN ('Extreme', 'Severe') THEN '[CRITICAL ALERT]' ELSE '[FLOOD ADVISORY]' END || ' *[EXERCISE] ' || headline || '*' || chr(10) || chr(10) || '*Summary:* ' || description || chr(10) || chr(10) || '*Action Advice:* ' || instruction || chr(10) || chr(10) || '*Live Dynamic Route:* http://localhost:8000' || chr(10) || '_Issued by Flood early warning_' END AS message FROM e)
SELECT alert_id, channel, message, sha256(message) AS digest, 'rcpt-' || substr(sha256(alert_id || ':' || channel || ':' || sha256(message)), 1, 12) AS receipt_id FROM m""",
    "t6_alert_history": _A + " SELECT alert_id, severity, valid_from FROM alerts ORDER BY valid_from DESC, alert_id LIMIT 5",
}
