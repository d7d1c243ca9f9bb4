"""Queries on wards, volumes, way-points and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.policy import WAYPOINT_PROFILES, catalog, class_sql, values
from rillspark.functions.shared import looked_up
from rillspark.operators import assets, roads, summaries
from rillspark.plans.q_roads import CELLS_SQL
from rillspark.plans.testbed import rain_cells, view, with_views

PROFILE_COLUMNS = "profile, max_depth_m, max_dv"


def _series(spark, sf):
    sums = view(spark, sf, "depth").groupBy("scenario_id", "r").agg(F.sum("depth_m").alias("v"))
    return sums.select("scenario_id", F.col("r").cast("double").alias("t"), "v")


def _points(spark, sf):
    return roads.road_cells(view(spark, sf, "segment")).select(F.col("road_id").alias("feature"), "i", (F.col("c") * 30.0).alias("x"), (F.col("r") * 30.0).alias("y"))


def _ends(spark, sf):
    """Both ends of every road."""
    return view(spark, sf, "segment").selectExpr("road_id", "stack(2, 0, r1, c1, 1, r2, c2) AS (i, r, c)")


def _waypoints(spark, sf):
    """The different ends of roads, with the depth and speed of the water there, for every scenario and lead; 0 where the grid has no cell."""
    frames = assets.site_depths(_ends(spark, sf).select("i", "r", "c").distinct(), view(spark, sf, "depth"), view(spark, sf, "depth").select("scenario_id", "lead_minutes").distinct())
    return frames.select("r", "c", "scenario_id", "lead_minutes", "i", (F.col("c") * 30.0).alias("x"), (F.col("r") * 30.0).alias("y"), F.col("site_depth_m").alias("depth_m"), (F.expr("CAST((r * 13 + c * 7) % 30 AS DOUBLE)") / 10.0).alias("velocity_ms"))


def _hazard(spark, sf):
    """The hazard depends on the place alone, so it is worked out once a place and spread to the ends of roads there."""
    found = summaries.waypoint_hazard(_waypoints(spark, sf), catalog(spark, WAYPOINT_PROFILES, PROFILE_COLUMNS))
    columns = [c for c in found.columns if c not in ("r", "c", "i", "scenario_id", "lead_minutes")]
    return looked_up(_ends(spark, sf), found, "i", "r", "c").select("scenario_id", "lead_minutes", "road_id", "i", *columns)


def _line_cells(spark, sf):
    """Cells of the different lines of roads, with the number of roads on each."""
    segments = view(spark, sf, "segment")
    return roads.road_cells(roads.lines_of(segments)).select("road_id", "r", "c").join(roads.line_counts(segments).hint("merge"), "road_id")


QUERIES = {
    "a10_rainfall_volume": lambda s, d: summaries.rainfall_volume(rain_cells(s, d), "frame"),
    "a12_ward_summary": lambda s, d: summaries.ward_summary(view(s, d, "depth"), _line_cells(s, d), view(s, d, "asset")),
    "w1_polyline_lengths": lambda s, d: summaries.polyline_lengths(_points(s, d)),
    "j12_resampled_series": lambda s, d: summaries.resampled(_series(s, d), s.sql("SELECT CAST(id AS DOUBLE) / 2.0D - 2.0D AS t FROM range(0, 145)"), "scenario_id"),
    "a36_controls": lambda s, d: summaries.controls(view(s, d, "depth").groupBy("scenario_id").agg(F.countDistinct("lead_minutes").alias("leads"), F.max("r").alias("last_row"), F.max("lead_minutes").alias("last_lead")), "leads", "last_row", "last_lead"),
    "f36_waypoint_hazard": _hazard,
}

_D = with_views("depth", "segment", "asset")
ORACLES = {
    "a10_rainfall_volume": with_views("rain") + " SELECT frame, round(sum(rate_mmh) / 3.6e6 * 900 * 900 + 1e-6, 3) AS volume_m3, count(*) AS cells FROM rain GROUP BY frame",
    "a12_ward_summary": _D + f""",{CELLS_SQL},
w AS (SELECT r, c, count(DISTINCT road_id) AS roads FROM cells GROUP BY r, c), t AS (SELECT r, c, count(*) AS sites FROM asset GROUP BY r, c),
x AS (SELECT d.*, roads, sites FROM depth d LEFT JOIN w ON w.r = d.r AND w.c = d.c LEFT JOIN t ON t.r = d.r AND t.c = d.c)
SELECT scenario_id, lead_minutes, CAST(r // 10 AS INT) AS ward_r, CAST(c // 10 AS INT) AS ward_c, count(*) FILTER (depth_m > 0.05) * CAST(900 AS DOUBLE) AS wet_area_m2, count(*) FILTER (depth_m > 0.3) * CAST(900 AS DOUBLE) AS severe_area_m2,
       max(depth_m) AS max_depth_m, round(avg(depth_m) + 1e-9, 6) AS mean_depth_m, CAST(coalesce(sum(roads) FILTER (depth_m > 0.05), 0) AS DOUBLE) * 30 AS wet_road_m, CAST(coalesce(sum(sites) FILTER (depth_m > 0.3), 0) AS BIGINT) AS flooded_assets
FROM x GROUP BY scenario_id, lead_minutes, CAST(r // 10 AS INT), CAST(c // 10 AS INT)""",
    "w1_polyline_lengths": with_views("segment") + f""",{CELLS_SQL},
s AS (SELECT road_id, sqrt(CAST(pow(30 * (c - lag(c) OVER w), 2) + pow(30 * (r - lag(r) OVER w), 2) AS DOUBLE)) AS d FROM cells WINDOW w AS (PARTITION BY road_id ORDER BY i))
SELECT road_id AS feature, count(*) AS points, round(greatest(CAST(10 AS DOUBLE), coalesce(sum(d), 0)) + 1e-9, 6) AS length_m FROM s GROUP BY road_id""",
    "j12_resampled_series": with_views("depth") + """,
s AS (SELECT scenario_id, CAST(r AS DOUBLE) AS t, sum(depth_m) AS v FROM depth GROUP BY scenario_id, r),
q AS (SELECT k.scenario_id, CAST(i AS DOUBLE) / 2 - 2 AS t FROM (SELECT DISTINCT scenario_id FROM s) k, range(0, 145) AS x(i)),
n AS (SELECT q.scenario_id, q.t, max(CASE WHEN s.t <= q.t THEN s.t END) AS a, min(CASE WHEN s.t >= q.t THEN s.t END) AS b FROM q JOIN s ON s.scenario_id = q.scenario_id GROUP BY q.scenario_id, q.t)
SELECT n.scenario_id, n.t, round(CASE WHEN a IS NULL THEN y.v WHEN b IS NULL OR a = b THEN x.v ELSE x.v + (y.v - x.v) * (n.t - a) / (b - a) END + 1e-9, 6) AS v
FROM n LEFT JOIN s x ON x.scenario_id = n.scenario_id AND x.t = a LEFT JOIN s y ON y.scenario_id = n.scenario_id AND y.t = b""",
    "a36_controls": with_views("depth") + """,
g AS (SELECT scenario_id, count(DISTINCT lead_minutes) AS leads, max(r) AS last_row, max(lead_minutes) AS last_lead FROM depth GROUP BY scenario_id),
l AS (SELECT 'leads' AS control, CAST(leads AS VARCHAR) AS value FROM g UNION ALL SELECT 'last_row', CAST(last_row AS VARCHAR) FROM g UNION ALL SELECT 'last_lead', CAST(last_lead AS VARCHAR) FROM g)
SELECT control, count(DISTINCT value) AS distinct_values, string_agg(DISTINCT value, ',' ORDER BY value) AS values_seen, count(DISTINCT value) <= 1 AS all_equal FROM l GROUP BY control""",
    "f36_waypoint_hazard": with_views("depth", "segment") + f""",
e AS (SELECT road_id, 0 AS i, r1 AS r, c1 AS c FROM segment UNION ALL SELECT road_id, 1, r2, c2 FROM segment),
p AS (SELECT f.scenario_id, f.lead_minutes, road_id, i, c * CAST(30 AS DOUBLE) AS x, r * CAST(30 AS DOUBLE) AS y, coalesce(depth_m, 0) AS depth_m, CAST((e.r * 13 + e.c * 7) % 30 AS DOUBLE) / 10 AS velocity_ms
      FROM e CROSS JOIN (SELECT DISTINCT scenario_id, lead_minutes FROM depth) f LEFT JOIN depth USING (scenario_id, lead_minutes, r, c)),
m AS (SELECT *, depth_m > max_depth_m OR depth_m * velocity_ms > max_dv AS blocked FROM p CROSS JOIN ({values(WAYPOINT_PROFILES, PROFILE_COLUMNS)})),
n AS (SELECT *, CASE WHEN blocked THEN ((depth_m - max_depth_m) * 80 + 20) * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS move FROM m)
SELECT scenario_id, lead_minutes, road_id, i, x, y, depth_m, velocity_ms, profile, round(depth_m * velocity_ms + 1e-9, 6) AS hazard_dv, blocked, round(x + move + 1e-9, 6) AS x_out, round(y + move * CAST(0.5 AS DOUBLE) + 1e-9, 6) AS y_out, {class_sql("depth_m")} AS class FROM n""",
}
