"""Queries on verification, validation, calibration and ensembles of depth grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.policy import MEMBERS, catalog, values
from rillspark.functions.shared import settled
from rillspark.operators import roads, scores
from rillspark.plans.q_roads import CELLS_SQL
from rillspark.plans.testbed import SIDE, view, with_views

MEMBER_COLUMNS = "member_id, multiplier, dr, dc, weight"
THRESHOLDS = "0.10, 0.20, 0.30, 0.50"


def _members(spark):
    return catalog(spark, MEMBERS, MEMBER_COLUMNS)


def _grids(spark, sf):
    return scores.member_depths(view(spark, sf, "depth"), _members(spark), SIDE, SIDE)


def member_depths(spark, sf):
    return _grids(spark, sf).select("scenario_id", "lead_minutes", "member_id", "r", "c", F.round(F.col("depth_m"), 6).alias("depth_m"))


def _extent_pairs(spark, sf):
    """Scenario A as the simulation, N as the reference, by lead; cells of both."""
    depth = view(spark, sf, "depth")
    side = lambda k, n: depth.where(F.col("scenario_id") == k).select("lead_minutes", "r", "c", F.col("depth_m").alias(n))
    return side("A", "s").join(side("N", "o"), ["lead_minutes", "r", "c"])


def _series(spark, sf):
    """Flow series by scenario: depth summed along row r as t; observed is a smoothed copy of the simulated."""
    sums = view(spark, sf, "depth").groupBy("scenario_id", F.col("r").alias("t")).agg(F.sum("depth_m").alias("s"))
    return sums.withColumn("o", F.col("s") * (0.9 + 0.2 * (F.col("t") % 7) / 7.0))


def risk(spark, sf):
    """Members stand side by side, so a line's cells are joined once for all of them; roads of the same ends share a line."""
    segments, members = view(spark, sf, "segment"), [m[0] for m in MEMBERS]
    wide = settled(scores.side_by_side(_grids(spark, sf), members), "members")
    names = tuple(f"m{m}" for m in members)
    worst = roads.by_road(roads.road_cells(roads.lines_of(segments)), wide, ("scenario_id",), names, roads.leads_of(view(spark, sf, "depth")), lambda *d: {n: F.max(x) for n, x in zip(names, d, strict=True)})
    return roads.for_roads(scores.road_risk(scores.one_by_one(worst, members, "scenario_id", "lead_minutes", "road_id")), segments)


QUERIES = {
    "a18_hydrograph_fit": lambda s, d: scores.hydrograph_fit(_series(s, d), "scenario_id"),
    "a24_extent_scores": lambda s, d: scores.extent_scores(_extent_pairs(s, d), "lead_minutes"),
    "a21_masked_rmse": lambda s, d: scores.masked_rmse(_extent_pairs(s, d), F.col("o") >= 0.1, "lead_minutes"),
    "j23_member_depths": member_depths,
    "a27_member_metrics": lambda s, d: scores.member_metrics(_grids(s, d)),
    "a28_confidence_bounds": lambda s, d: scores.confidence_bounds(scores.member_metrics(_grids(s, d))),
    "a29_exceedance": lambda s, d: scores.exceedance(_grids(s, d), s.sql(f"SELECT CAST(t AS DOUBLE) AS threshold FROM (SELECT explode(array({THRESHOLDS})) AS t)"), len(MEMBERS), SIDE * SIDE),
    "a30_road_risk": risk,
    "a31_brier": lambda s, d: scores.brier(_grids(s, d), view(s, d, "depth"), len(MEMBERS)),
}

GRIDS_SQL = f"""
members AS ({values(MEMBERS, MEMBER_COLUMNS)}),
grids AS (SELECT scenario_id, lead_minutes, member_id, CAST((r + dr + {SIDE}) % {SIDE} AS INT) AS r, CAST((c + dc + {SIDE}) % {SIDE} AS INT) AS c, depth_m * multiplier AS depth_m FROM depth, members)"""
METRICS_SQL = """
metrics AS (SELECT scenario_id, lead_minutes, member_id, round(max(depth_m) + 1e-9, 3) AS max_depth_m, count(*) FILTER (depth_m >= 0.05) * CAST(900 AS DOUBLE) AS inundated_area_m2
            FROM grids GROUP BY scenario_id, lead_minutes, member_id)"""
_W = with_views("depth")
ORACLES = {
    "a18_hydrograph_fit": _W + """,
q AS (SELECT scenario_id, r AS t, sum(depth_m) AS s FROM depth GROUP BY scenario_id, r),
z AS (SELECT *, s * (0.9 + 0.2 * (t % 7) / CAST(7 AS DOUBLE)) AS o FROM q),
m AS (SELECT scenario_id, count(*) AS n, avg(o) AS mo, avg(s) AS ms, sum(o) AS so, sum(s) AS ss, sum((s - o) * (s - o)) AS sse, var_pop(o) * count(*) AS sso, stddev_samp(o) AS dv, stddev_samp(s) AS ds,
             covar_samp(o, s) AS cov, max(o) AS po, max(s) AS ps, arg_max(t, (o, -t)) AS t_o, arg_max(t, (s, -t)) AS t_s FROM z GROUP BY scenario_id),
k AS (SELECT *, 1 - sse / sso AS nse, greatest(-1.0, least(1.0, cov / (dv * ds))) AS rr, ds / dv AS alpha, ms / mo AS beta, abs(ps - po) / po * 100 AS pfe, CAST(abs(t_s - t_o) AS DOUBLE) AS tpe,
             (ss - so) / so * 100 AS pbias, sqrt(sse / n) AS rmse FROM m),
g AS (SELECT *, 1 - sqrt((rr - 1) * (rr - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1)) AS kge FROM k)
SELECT scenario_id, n, round(nse + 1e-9, 6) AS nse, round(kge + 1e-9, 6) AS kge, round(rr + 1e-9, 6) AS r, round(alpha + 1e-9, 6) AS alpha, round(beta + 1e-9, 6) AS beta, round(pfe + 1e-9, 6) AS pfe_pct,
       round(tpe + 1e-9, 6) AS tpe_minutes, round(pbias + 1e-9, 6) AS pbias_pct, round(rmse + 1e-9, 6) AS rmse,
       round((0.5 * greatest(0.0, 1 - kge) + 0.25 * least(5.0, pfe / 100) + 0.15 * least(5.0, abs(pbias) / 100)) / CAST(0.9 AS DOUBLE) + 1e-9, 6) AS loss FROM g""",
    "a24_extent_scores": _W + """,
p AS (SELECT lead_minutes, a.depth_m AS s, b.depth_m AS o FROM (SELECT * FROM depth WHERE scenario_id = 'A') a JOIN (SELECT * FROM depth WHERE scenario_id = 'N') b USING (lead_minutes, r, c)),
n AS (SELECT lead_minutes, count(*) FILTER (s >= 0.05 AND o >= 0.05) AS hits, count(*) FILTER (s < 0.05 AND o >= 0.05) AS misses, count(*) FILTER (s >= 0.05 AND o < 0.05) AS false_alarms,
             count(*) FILTER (s < 0.05 AND o < 0.05) AS correct_negatives, round(sqrt(avg((s - o) * (s - o))) + 1e-9, 6) AS rmse_m, round(avg(abs(s - o)) + 1e-9, 6) AS mae_m,
             round(max(abs(s - o)) + 1e-9, 6) AS max_abs_m, round(avg(s - o) + 1e-9, 6) AS bias_m FROM p GROUP BY lead_minutes)
SELECT *, round(CASE WHEN hits + misses + false_alarms > 0 THEN CAST(hits AS DOUBLE) / (hits + misses + false_alarms) ELSE 1 END + 1e-9, 6) AS csi,
       round(CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) / (hits + misses) ELSE 1 END + 1e-9, 6) AS pod,
       round(CASE WHEN hits + false_alarms > 0 THEN CAST(false_alarms AS DOUBLE) / (hits + false_alarms) ELSE 0 END + 1e-9, 6) AS far,
       round(CASE WHEN 2 * hits + misses + false_alarms > 0 THEN CAST(2 * hits AS DOUBLE) / (2 * hits + misses + false_alarms) ELSE 1 END + 1e-9, 6) AS f1 FROM n""",
    "a21_masked_rmse": _W + """,
p AS (SELECT lead_minutes, a.depth_m AS s, b.depth_m AS o FROM (SELECT * FROM depth WHERE scenario_id = 'A') a JOIN (SELECT * FROM depth WHERE scenario_id = 'N') b USING (lead_minutes, r, c))
SELECT lead_minutes, count(*) FILTER (o >= 0.1) AS cells, round(sqrt(avg((s - o) * (s - o)) FILTER (o >= 0.1)) + 1e-9, 6) AS rmse_m FROM p GROUP BY lead_minutes""",
    "j23_member_depths": _W + f",{GRIDS_SQL} SELECT scenario_id, lead_minutes, member_id, r, c, round(depth_m, 6) AS depth_m FROM grids",
    "a27_member_metrics": _W + f",{GRIDS_SQL},{METRICS_SQL} SELECT * FROM metrics",
    "a28_confidence_bounds": _W + f""",{GRIDS_SQL},{METRICS_SQL},
q AS (SELECT scenario_id, lead_minutes, quantile_cont(max_depth_m, 0.1) AS a, quantile_cont(max_depth_m, 0.5) AS b, quantile_cont(max_depth_m, 0.9) AS c FROM metrics GROUP BY scenario_id, lead_minutes)
SELECT scenario_id, lead_minutes, round(a + 1e-9, 3) AS p10_max_depth_m, round(b + 1e-9, 3) AS p50_max_depth_m, round(c + 1e-9, 3) AS p90_max_depth_m, round(c - a + 1e-9, 3) AS interquartile_range_m FROM q""",
    "a29_exceedance": _W + f""",{GRIDS_SQL},
p AS (SELECT scenario_id, lead_minutes, r, c, threshold, count(*) FILTER (depth_m >= threshold) / CAST({len(MEMBERS)} AS DOUBLE) AS p
      FROM grids, (SELECT CAST(unnest([{THRESHOLDS}]) AS DOUBLE) AS threshold) GROUP BY scenario_id, lead_minutes, r, c, threshold)
SELECT scenario_id, lead_minutes, threshold, count(*) FILTER (p > 0) AS cells_any, count(*) FILTER (p >= 0.5) AS cells_likely, count(*) FILTER (p >= 0.9) AS cells_certain,
       round(sum(p) / {SIDE * SIDE} + 1e-9, 6) AS mean_probability, round(max(p) + 1e-9, 6) AS max_probability FROM p GROUP BY scenario_id, lead_minutes, threshold""",
    "a30_road_risk": with_views("depth", "segment") + f""",{CELLS_SQL},{GRIDS_SQL},
w AS (SELECT scenario_id, lead_minutes, road_id, member_id, max(depth_m) AS d FROM grids JOIN cells USING (r, c) GROUP BY scenario_id, lead_minutes, road_id, member_id)
SELECT scenario_id, lead_minutes, road_id, round(avg(CASE WHEN d >= 0.3 THEN 1 ELSE 0 END) + 1e-9, 3) AS prob_impassable, round(avg(CASE WHEN d >= 0.1 AND d < 0.3 THEN 1 ELSE 0 END) + 1e-9, 3) AS prob_caution,
       round(avg(CASE WHEN d < 0.1 THEN 1 ELSE 0 END) + 1e-9, 3) AS prob_dry, round(avg(d) + 1e-9, 3) AS expected_depth_m, round(quantile_cont(d, 0.9) + 1e-9, 3) AS depth_p90_m
FROM w GROUP BY scenario_id, lead_minutes, road_id""",
    "a31_brier": _W + f""",{GRIDS_SQL},
p AS (SELECT scenario_id, lead_minutes, r, c, count(*) FILTER (depth_m >= 0.1) / CAST({len(MEMBERS)} AS DOUBLE) AS p FROM grids GROUP BY scenario_id, lead_minutes, r, c)
SELECT scenario_id, lead_minutes, round(avg((coalesce(p, 0) - CAST(depth_m >= 0.1 AS DOUBLE)) * (coalesce(p, 0) - CAST(depth_m >= 0.1 AS DOUBLE))) + 1e-9, 6) AS brier_score
FROM depth LEFT JOIN p USING (scenario_id, lead_minutes, r, c) GROUP BY scenario_id, lead_minutes""",
}
