"""Queries on rain frames and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import nowcast, scores
from rillspark.operators.roads import steady
from rillspark.plans.testbed import rain_cells, with_views

LEADS = "SELECT CAST(id * 15 AS INT) AS lead_minutes FROM range(0, 13)"
STEPS = "SELECT CAST(id * 60 AS INT) AS step_minutes FROM range(0, 4)"
LEADS_SQL = "leads AS (SELECT CAST(i * 15 AS INT) AS lead_minutes FROM range(0, 13) AS t(i)), steps AS (SELECT CAST(i * 60 AS INT) AS step_minutes FROM range(0, 4) AS t(i))"


def _frames(spark, sf):
    return rain_cells(spark, sf)


def _field(spark, sf):
    return nowcast.motion_field(_frames(spark, sf), 0, 1)


def _drift(spark, sf):
    """The later frame with one velocity for all cells (m/s)."""
    return _frames(spark, sf).where("frame = 1").select("r", "c", "rate_mmh", F.lit(0.05).alias("u"), F.lit(-0.03).alias("v"))


def _rounded(df, *columns):
    return df.select(*(steady(F.col(c)).alias(c) if c in columns else c for c in df.columns))


def _forecast(spark, sf):
    """A forecast for every hour: the earlier frame, growing by a fifth each hour."""
    return _frames(spark, sf).where("frame = 0").crossJoin(F.broadcast(spark.sql(STEPS))).select("step_minutes", "r", "c", (F.col("rate_mmh") * (1.0 + F.col("step_minutes") / 300.0)).alias("rate_mmh"))


def _blend(spark, sf):
    leads = spark.sql(LEADS)
    radar = nowcast.advected(_drift(spark, sf), leads)
    return nowcast.blended(radar, _forecast(spark, sf), nowcast.nearest_step(leads, spark.sql(STEPS)))


def _pairs(spark, sf):
    """Frame 0 as the forecast, frame 1 as the observation."""
    both = _frames(spark, sf).groupBy("r", "c").agg(F.max(F.when(F.col("frame") == 0, F.col("rate_mmh"))).alias("f"), F.max(F.when(F.col("frame") == 1, F.col("rate_mmh"))).alias("o"))
    return both.where("f IS NOT NULL AND o IS NOT NULL")


def _thresholds(spark):
    return spark.sql("SELECT explode(array(0.1D, 1.0D, 5.0D, 15.0D, 30.0D)) AS threshold")


QUERIES = {
    "s2_unpacked_frames": _frames,
    "w2_gradients": lambda s, d: _rounded(nowcast.gradients(_frames(s, d)), "gx", "gy").select("frame", "r", "c", "gx", "gy"),
    "a43_storm_motion": lambda s, d: _rounded(nowcast.storm_motion(_frames(s, d), 0, 1), "u_mps", "v_mps"),
    "w3_motion_field": lambda s, d: _rounded(_field(s, d), "u", "v").select("r", "c", "u", "v"),
    "j15_advected": lambda s, d: _rounded(nowcast.advected(_drift(s, d), s.sql(LEADS)), "rate_mmh"),
    "n1_persistence": lambda s, d: nowcast.persisted(_frames(s, d).where("frame = 1"), s.sql(LEADS).where("lead_minutes <= 60")),
    "n2_advection_nowcast": lambda s, d: _rounded(nowcast.advected(_field(s, d), s.sql(LEADS)), "rate_mmh"),
    "j8_nearest_step": lambda s, d: nowcast.nearest_step(s.sql(LEADS), s.sql(STEPS)),
    "f16_blend_weights": lambda s, d: s.sql(LEADS).select("lead_minutes", nowcast.radar_weight(F.col("lead_minutes")).alias("w_radar"), F.round(1.0 - nowcast.radar_weight(F.col("lead_minutes")), 4).alias("w_nwp")),
    "n4_blended": lambda s, d: _rounded(_blend(s, d), "rate_mmh"),
    "j13_resampled": lambda s, d: _rounded(nowcast.resampled(_frames(s, d), 40, 32), "rate_mmh"),
    "a13_continuous_scores": lambda s, d: scores.continuous(_pairs(s, d)),
    "a15_categorical_scores": lambda s, d: scores.categorical(_pairs(s, d), _thresholds(s)),
    "a17_fraction_skill": lambda s, d: scores.fraction_skill(_pairs(s, d)),
}
# Lists of leads and weights alone do not grow with the data; they stay parts of the queries above.
for _name in ("j8_nearest_step", "f16_blend_weights"):
    QUERIES.pop(_name)

GRADIENT_SQL = """
grad AS (
  SELECT *, CASE WHEN lag(rate_mmh) OVER x IS NULL THEN lead(rate_mmh) OVER x - rate_mmh WHEN lead(rate_mmh) OVER x IS NULL THEN rate_mmh - lag(rate_mmh) OVER x
                 ELSE (lead(rate_mmh) OVER x - lag(rate_mmh) OVER x) / 2 END AS gx,
            CASE WHEN lag(rate_mmh) OVER y IS NULL THEN lead(rate_mmh) OVER y - rate_mmh WHEN lead(rate_mmh) OVER y IS NULL THEN rate_mmh - lag(rate_mmh) OVER y
                 ELSE (lead(rate_mmh) OVER y - lag(rate_mmh) OVER y) / 2 END AS gy
  FROM rain WINDOW x AS (PARTITION BY frame, r ORDER BY c), y AS (PARTITION BY frame, c ORDER BY r)
), centre AS (SELECT frame, sum(rate_mmh) AS mass, sum(c * rate_mmh) / sum(rate_mmh) AS cx, sum(r * rate_mmh) / sum(rate_mmh) AS cy FROM rain GROUP BY frame),
motion AS (
  SELECT CASE WHEN a.mass > 1 AND b.mass > 1 THEN (b.cx - a.cx) * CAST(30 AS DOUBLE) / 900 ELSE CAST(3 AS DOUBLE) END AS u_mps,
         CASE WHEN a.mass > 1 AND b.mass > 1 THEN (b.cy - a.cy) * CAST(30 AS DOUBLE) / 900 ELSE CAST(2 AS DOUBLE) END AS v_mps
  FROM centre a, centre b WHERE a.frame = 0 AND b.frame = 1
), field AS (
  SELECT r, c, rate_mmh, greatest(-50.0, least(50.0, w * (-(gx * it) / (g2 + 1) * 30 / 900) + (1 - w) * u_mps)) AS u,
         greatest(-50.0, least(50.0, w * (-(gy * it) / (g2 + 1) * 30 / 900) + (1 - w) * v_mps)) AS v
  FROM (SELECT g.r, g.c, g.rate_mmh, g.gx, g.gy, g.rate_mmh - p.rate_mmh AS it, gx * gx + gy * gy AS g2, (gx * gx + gy * gy) / (gx * gx + gy * gy + 0.1) AS w
        FROM grad g JOIN rain p ON g.frame = 1 AND p.frame = 0 AND g.r = p.r AND g.c = p.c), motion
)"""
DRIFT_SQL = "field AS (SELECT r, c, rate_mmh, CAST(0.05 AS DOUBLE) AS u, CAST(-0.03 AS DOUBLE) AS v FROM rain WHERE frame = 1)"
ADVECT_SQL = """
size AS (SELECT max(r) AS h1, max(c) AS w1 FROM field),
ends AS (SELECT lead_minutes, r, c, greatest(0.0, least(CAST(w1 AS DOUBLE), c - u * lead_minutes * 60 / 30)) AS x, greatest(0.0, least(CAST(h1 AS DOUBLE), r - v * lead_minutes * 60 / 30)) AS y, h1, w1
         FROM field, leads, size),
corner AS (SELECT *, CAST(floor(x) AS INT) AS x0, CAST(floor(y) AS INT) AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM ends),
moved AS (
  SELECT k.lead_minutes, k.r, k.c, CASE WHEN k.lead_minutes <= 0 THEN 1 ELSE exp(-k.lead_minutes / CAST(180 AS DOUBLE)) END
         * greatest(0.0, (1 - fx) * (1 - fy) * a.rate_mmh + fx * (1 - fy) * b.rate_mmh + (1 - fx) * fy * d.rate_mmh + fx * fy * e.rate_mmh) AS rate_mmh
  FROM corner k JOIN field a ON a.r = y0 AND a.c = x0 JOIN field b ON b.r = y0 AND b.c = least(x0 + 1, w1)
  JOIN field d ON d.r = least(y0 + 1, h1) AND d.c = x0 JOIN field e ON e.r = least(y0 + 1, h1) AND e.c = least(x0 + 1, w1)
)"""
PAIRS_SQL = """
pairs AS (SELECT a.r, a.c, a.rate_mmh AS f, b.rate_mmh AS o FROM rain a JOIN rain b ON a.frame = 0 AND b.frame = 1 AND a.r = b.r AND a.c = b.c)"""
_W = with_views("rain")
ORACLES = {
    "s2_unpacked_frames": _W + " SELECT * FROM rain",
    "w2_gradients": _W + f",{GRADIENT_SQL} SELECT frame, r, c, round(gx + 1e-9, 6) AS gx, round(gy + 1e-9, 6) AS gy FROM grad",
    "a43_storm_motion": _W + f",{GRADIENT_SQL} SELECT round(u_mps + 1e-9, 6) AS u_mps, round(v_mps + 1e-9, 6) AS v_mps FROM motion",
    "w3_motion_field": _W + f",{GRADIENT_SQL} SELECT r, c, round(u + 1e-9, 6) AS u, round(v + 1e-9, 6) AS v FROM field",
    "j15_advected": _W + f",{LEADS_SQL},{DRIFT_SQL},{ADVECT_SQL} SELECT lead_minutes, r, c, round(rate_mmh + 1e-9, 6) AS rate_mmh FROM moved",
    "n1_persistence": _W + f",{LEADS_SQL} SELECT lead_minutes, r, c, rate_mmh FROM rain, leads WHERE frame = 1 AND lead_minutes <= 60",
    "n2_advection_nowcast": _W + f",{LEADS_SQL},{GRADIENT_SQL},{ADVECT_SQL} SELECT lead_minutes, r, c, round(rate_mmh + 1e-9, 6) AS rate_mmh FROM moved",
    "n4_blended": _W + f""",{LEADS_SQL},{DRIFT_SQL},{ADVECT_SQL},
near AS (SELECT lead_minutes, arg_min(step_minutes, abs(lead_minutes - step_minutes) * 1000 + step_minutes) AS step_minutes,
         round(CASE WHEN lead_minutes <= 30 THEN 1 WHEN lead_minutes >= 150 THEN 0 ELSE 1 - (lead_minutes - 30) / CAST(120 AS DOUBLE) END + 1e-9, 4) AS w FROM leads, steps GROUP BY lead_minutes)
SELECT m.lead_minutes, m.r, m.c, round(greatest(0.0, least(300.0, w * m.rate_mmh + (1 - w) * p.rate_mmh * (1 + step_minutes / CAST(300 AS DOUBLE)))) + 1e-9, 6) AS rate_mmh,
       CASE WHEN w = 1 THEN 'RADAR_ONLY' WHEN w = 0 THEN 'NWP_ONLY' ELSE 'BLENDED_LINEAR' END AS blending_mode
FROM moved m JOIN near USING (lead_minutes) JOIN rain p ON p.frame = 0 AND p.r = m.r AND p.c = m.c""",
    "j13_resampled": _W + """,
size AS (SELECT frame, max(r) AS h1, max(c) AS w1 FROM rain GROUP BY frame),
tgt AS (SELECT frame, CAST(tr AS INT) AS tr, CAST(tc AS INT) AS tc, h1, w1, tr * CAST(h1 AS DOUBLE) / 39 AS y, tc * CAST(w1 AS DOUBLE) / 31 AS x FROM size, range(0, 40) AS a(tr), range(0, 32) AS b(tc)),
k AS (SELECT *, least(CAST(floor(y) AS INT), h1 - 1) AS y0, least(CAST(floor(x) AS INT), w1 - 1) AS x0 FROM tgt),
q AS (SELECT frame, tr, tc, y0 + dy AS r, x0 + dx AS c, CASE dy WHEN 1 THEN y - y0 ELSE 1 - (y - y0) END * CASE dx WHEN 1 THEN x - x0 ELSE 1 - (x - x0) END AS w
      FROM k, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(dy, dx))
SELECT q.frame, tr AS r, tc AS c, round(sum(w * rate_mmh) + 1e-9, 6) AS rate_mmh FROM q JOIN rain ON rain.frame = q.frame AND rain.r = q.r AND rain.c = q.c GROUP BY q.frame, tr, tc""",
    "a13_continuous_scores": _W + f""",{PAIRS_SQL}
SELECT count(*) AS n, round(avg(abs(f - o)) + 1e-9, 6) AS mae, round(sqrt(avg((f - o) * (f - o))) + 1e-9, 6) AS rmse, round(avg(f - o) + 1e-9, 6) AS bias,
       round(CASE WHEN stddev_pop(f) < 1e-12 OR stddev_pop(o) < 1e-12 THEN 0 ELSE corr(f, o) END + 1e-9, 6) AS correlation FROM pairs""",
    "a15_categorical_scores": _W + f""",{PAIRS_SQL},
n AS (SELECT threshold, count(*) FILTER (f >= threshold AND o >= threshold) AS hits, count(*) FILTER (f < threshold AND o >= threshold) AS misses,
             count(*) FILTER (f >= threshold AND o < threshold) AS false_alarms, count(*) FILTER (f < threshold AND o < threshold) AS correct_negatives
      FROM pairs, (SELECT CAST(unnest([0.1, 1, 5, 15, 30]) AS DOUBLE) AS threshold) GROUP BY threshold),
e AS (SELECT *, CAST(hits + misses AS DOUBLE) * (hits + false_alarms) / (hits + misses + false_alarms + correct_negatives) AS ch FROM n)
SELECT threshold, hits, misses, false_alarms, correct_negatives, round(CASE WHEN hits + misses + false_alarms > 0 THEN CAST(hits AS DOUBLE) / (hits + misses + false_alarms) ELSE 0 END + 1e-9, 6) AS csi,
       round(CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) / (hits + misses) ELSE 0 END + 1e-9, 6) AS pod,
       round(CASE WHEN hits + false_alarms > 0 THEN CAST(false_alarms AS DOUBLE) / (hits + false_alarms) ELSE 0 END + 1e-9, 6) AS far,
       round(CASE WHEN hits + misses + false_alarms - ch > 0 THEN (hits - ch) / (hits + misses + false_alarms - ch) ELSE 0 END + 1e-9, 6) AS ets FROM e""",
    "a17_fraction_skill": _W + f""",{PAIRS_SQL},
b AS (SELECT r, c, CAST(f >= 1 AS DOUBLE) AS f, CAST(o >= 1 AS DOUBLE) AS o FROM pairs),
x AS (SELECT r, c, sum(f) OVER w AS f, sum(o) OVER w AS o FROM b WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
y AS (SELECT sum(f) OVER w / 25 AS f, sum(o) OVER w / 25 AS o FROM x WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
z AS (SELECT avg((f - o) * (f - o)) AS mse, avg(f * f) + avg(o * o) AS worst FROM y)
SELECT round(CASE WHEN worst <= 1e-12 THEN CASE WHEN mse <= 1e-12 THEN 1 ELSE 0 END ELSE 1 - mse / worst END + 1e-9, 6) AS fss FROM z""",
}
