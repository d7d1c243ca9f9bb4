"""Queries on storm cells, ponding, frames by the minute, unified nowcasts, fused feeds, volumes and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.policy import catalog, values
from rillspark.operators import fields, frames, mitigation, nowcast, scores, storms
from rillspark.operators.roads import steady
from rillspark.plans.q_frames import SNAP_SQL
from rillspark.plans.q_nowcast import ADVECT_SQL, DRIFT_SQL, _drift
from rillspark.plans.q_rain import BLOCKS_SQL, IDF_SQL, RATES_SQL, _rates
from rillspark.plans.testbed import SIDE, rain_cells, view, with_views
from rillspark.sources.tables import table

LEADS = "SELECT CAST(id * 20 AS INT) AS lead_minutes FROM range(0, 13)"
# Scenarios with their rain (mm/h), surcharge of the one index (m), and share of the drains that works for the other.
SCENARIOS = (("S1", 15.0, 0.0, 1.0), ("S2", 38.0, 0.0, 1.0), ("S3", 72.0, 0.25, 0.35), ("S4", 72.0, 0.45, 0.95))
SCENARIO_COLUMNS = "scenario_id, rate_mmh, surcharge_m, drained"
# Strategies as (id, permeable share, basin m3, pump m3/s, unblocked).
STRATEGIES = (
    ("sponge_city_green", 0.30, 30000.0, 0.0, False),
    ("emergency_pumping", 0.0, 0.0, 5.0, False),
    ("culvert_desilting", 0.0, 0.0, 0.0, True),
    ("hybrid_max_mitigation", 0.35, 50000.0, 4.0, True),
)
STRATEGY_COLUMNS = "package, lid, basin_m3, pump_m3s, unblock"
# Parameters of calibration as (name, least, most, default).
PARAMETERS = (("blockage_ratio", 0.0, 0.95, 0.2), ("manning_n", 0.01, 0.05, 0.015), ("fmin_mmh", 0.5, 10.0, 2.0))
PARAMETER_COLUMNS = "name, least, most, usual"


def _frame_rates(spark, sf):
    """A rate for each lead: 100 times the mean depth of scenario A."""
    return view(spark, sf, "depth").where("scenario_id = 'A'").groupBy("lead_minutes").agg(steady(F.avg("depth_m") * 100).alias("rate_mmh"))


def _grid(spark, sf):
    return view(spark, sf, "depth").select("r", "c").distinct()


def _scenario_frames(spark):
    return catalog(spark, SCENARIOS, SCENARIO_COLUMNS).crossJoin(spark.sql("SELECT CAST(id * 30 AS INT) AS lead_minutes FROM range(0, 6)"))


def _advected(spark, sf):
    """Advection to two hours; the unified nowcast goes on to four."""
    return nowcast.advected(_drift(spark, sf), spark.sql(LEADS).where("lead_minutes <= 120"))


def _observed(spark, sf):
    return rain_cells(spark, sf).where("frame = 1").select("r", "c", "rate_mmh")


def _dispatched(spark, sf):
    leads = spark.sql("SELECT CAST(id * 30 AS INT) AS lead_minutes FROM range(0, 3)")
    persisted = nowcast.persisted(rain_cells(spark, sf).where("frame = 1"), leads).select(F.lit("persistence").alias("method"), "lead_minutes", "r", "c", "rate_mmh")
    moved = nowcast.advected(_drift(spark, sf), leads).select(F.lit("advection").alias("method"), "lead_minutes", "r", "c", steady(F.col("rate_mmh")).alias("rate_mmh"))
    requests = spark.sql("SELECT * FROM VALUES ('a', 'advection'), ('b', 'persistence'), ('c', 'unheard_of') AS t(request, method)")
    return fields.dispatched_methods(requests, persisted.unionByName(moved), methods=("persistence", "advection"))


def _by_sensor(spark, sf, kind: str, column: str):
    rates = _rates(spark, sf).where(F.col("product_type") == kind)
    return rates.groupBy("sensor_id").agg(F.max_by("rate_mmh", F.struct("observation_time", "obs_id")).alias(column))


def _fused(spark, sf):
    sensors = view(spark, sf, "gauge").select("sensor_id").distinct()
    weather = sensors.join(_by_sensor(spark, sf, "RAIN_RATE_MMH", "rate_mmh").hint("merge"), "sensor_id", "left")
    tide = sensors.where("sensor_id % 3 = 0").selectExpr("sensor_id", "CAST(sensor_id % 40 AS DOUBLE) / 10 AS tide_m")
    river = sensors.where("sensor_id % 4 = 0").selectExpr("sensor_id", "CAST(sensor_id % 900 AS DOUBLE) AS discharge_cms")
    return fields.fused(weather, _by_sensor(spark, sf, "SATELLITE_QPE", "rate_mmh"), tide, river, "sensor_id")


def _design_storms(spark, sf):
    """Three-hour storms of every order's return period, by the published table."""
    asked = view(spark, sf, "segment").selectExpr("road_id AS storm_id", "CAST(3 AS DOUBLE) AS hours", "CAST(2 + road_id % 99 AS DOUBLE) AS years")
    return storms.published_depths(asked).select("storm_id", F.round(F.col("depth_mm") + 1e-9, 2).alias("total_mm"), F.lit(12).alias("n"), F.lit(15).alias("minutes"))


def _strategies(spark, sf):
    depth = view(spark, sf, "depth")
    clean = depth.where("scenario_id = 'N'").select(F.lit("R").alias("scenario_id"), "lead_minutes", "r", "c", F.col("depth_m").alias("clean_depth_m"))
    grids = mitigation.abated(depth, catalog(spark, STRATEGIES, STRATEGY_COLUMNS), clean)
    return grids.groupBy("scenario_id", "lead_minutes", "package").agg(steady(F.max("depth_m")).alias("max_depth_m"), steady(F.avg("depth_m")).alias("mean_depth_m"), F.count_if(F.col("depth_m") >= 0.05).alias("wet_cells"))


def _parameters(spark, sf):
    """A value for every part and parameter, some out of bounds, some missing."""
    part = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / CAST(40 AS DOUBLE) - CAST(0.1 AS DOUBLE) END AS v")
    least, most, usual = F.col("least"), F.col("most"), F.col("usual")
    return part.crossJoin(F.broadcast(catalog(spark, PARAMETERS, PARAMETER_COLUMNS))).select(
        "p_partkey", "name", steady(fields.clipped(F.col("v"), least, most, usual)).alias("clipped"), steady(fields.normalised(F.col("v"), least, most, usual)).alias("place"), steady(fields.denormalised(F.coalesce("v", F.lit(0.0)), least, most)).alias("back")
    )


def _tiers(spark, sf):
    """Scenario A against N and R, by lead: extent and errors."""
    depth = view(spark, sf, "depth")
    side = lambda k, n: depth.where(F.col("scenario_id") == k).select("lead_minutes", "r", "c", F.col("depth_m").alias(n))
    pairs = [side("A", "s").join(side(k, "o").hint("merge"), ["lead_minutes", "r", "c"]).withColumn("benchmark", F.lit(k)) for k in ("N", "R", "A")]
    return scores.benchmark_tiers(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]), F.col("benchmark") == "A", SIDE // 2, 0.01, "benchmark", "lead_minutes")


QUERIES = {
    "f11_moving_cell": lambda s, d: fields.moving_cell(_grid(s, d), _frame_rates(s, d), SIDE, SIDE),
    "f10_convective_cell": lambda s, d: fields.convective_cell(_grid(s, d), _frame_rates(s, d).select((F.col("lead_minutes") / 15).cast("int").alias("place"), "rate_mmh"), SIDE, SIDE),
    "f37_topographic_ponding": lambda s, d: fields.topographic_ponding(view(s, d, "dem"), _scenario_frames(s)),
    "f38_lowland_ponding": lambda s, d: fields.lowland_ponding(view(s, d, "dem").withColumn("slope", F.expr("CAST((r + c) % 10 AS DOUBLE) / 100")), _scenario_frames(s)),
    "j8_nearest_step": lambda s, d: fields.nearest_step(table(s, d, "orders").selectExpr("o_custkey % 50 AS k", "CAST(o_orderkey % 200 AS INT) AS lead_minutes").distinct(), table(s, d, "orders").selectExpr("o_custkey % 50 AS k", "CAST(o_orderkey % 5 * 60 AS INT) AS step_minutes").distinct(), "k"),
    "f16_blend_weights": lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 200 AS INT) AS lead_minutes").select("o_orderkey", nowcast.radar_weight(F.col("lead_minutes")).alias("w_radar"), F.round(1.0 - nowcast.radar_weight(F.col("lead_minutes")), 4).alias("w_nwp")),
    "j9_floor_intervals": lambda s, d: fields.floor_intervals(view(s, d, "gauge").select("sensor_id", "obs_id", F.col("observation_time").alias("t")), view(s, d, "gauge").groupBy("sensor_id").agg((F.min("observation_time") + F.expr("INTERVAL 1 HOUR")).alias("start"), F.lit(96).alias("n")), 15, "sensor_id").select("obs_id", "place", "interval_seconds"),
    "j11_minute_frames": lambda s, d: fields.minute_frames(frames.snapshots(view(s, d, "depth")), s.sql("SELECT CAST(id AS INT) AS lead_minutes FROM range(0, 101)"), 15),
    "n3_unified_nowcast": lambda s, d: fields.unified(_advected(s, d), _observed(s, d), s.sql(LEADS)),
    "n5_dispatched_methods": _dispatched,
    "j25_fused_feeds": _fused,
    "f7_design_storms": lambda s, d: storms.alternating_blocks(_design_storms(s, d)),
    "f9_custom_hyetographs": lambda s, d: fields.custom_hyetographs(table(s, d, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("double") - 5.0).alias("rate_mmh")), 15, "l_orderkey"),
    "c7_strategies": _strategies,
    "f19_blocked_diameters": lambda s, d: table(s, d, "part").select("p_partkey", steady(fields.blocked_diameter(F.lit(0.3), F.col("p_size") / 40.0)).alias("diameter_m")),
    "f41_capacity_ratios": lambda s, d: table(s, d, "part").select("p_partkey", steady(F.pow(fields.blocked_diameter(F.lit(0.3), F.col("p_size") / 40.0) / 0.3, F.lit(8.0 / 3.0))).alias("capacity_ratio")),
    "f20_parameters": _parameters,
    "c2_random_sweep": lambda s, d: fields.random_sweep(table(s, d, "part").select(F.col("p_partkey").alias("candidate")), catalog(s, PARAMETERS, PARAMETER_COLUMNS)),
    "w6_increments": lambda s, d: fields.increments(view(s, d, "gauge").selectExpr("sensor_id", "obs_id AS step", "CAST(obs_id AS DOUBLE) * 3 + CAST(sensor_id % 7 AS DOUBLE) AS cumulative_mm"), "sensor_id").select("sensor_id", "step", "depth_mm"),
    "w8_trapezoid_volumes": lambda s, d: fields.trapezoid_volumes(view(s, d, "gauge").selectExpr("sensor_id", "obs_id AS step", "CAST(raw_value AS DOUBLE) AS rate"), 900.0, "sensor_id"),
    "a26_benchmark_tiers": _tiers,
}

_D, _Z, _G, _S, _R = with_views("depth"), with_views("dem"), with_views("gauge"), with_views("segment"), with_views("rain")
RATE_SQL = "f AS (SELECT lead_minutes, round(avg(depth_m) * 100 + 1e-9, 6) AS rate FROM depth WHERE scenario_id = 'A' GROUP BY lead_minutes), g AS (SELECT DISTINCT r, c FROM depth)"
SCENARIO_SQL = f"sc AS (SELECT * FROM ({values(SCENARIOS, SCENARIO_COLUMNS)}) CROSS JOIN (SELECT CAST(i * 30 AS INT) AS lead_minutes FROM range(0, 6) AS t(i)))"
_H = "CAST(1.5707963267948966 AS DOUBLE)"
_ROWS = "ROWS UNBOUNDED PRECEDING"
ORACLES = {
    "f11_moving_cell": _D + f""",{RATE_SQL},
x AS (SELECT lead_minutes, r, c, rate, (c - {SIDE} * (0.35 + 0.3 * (lead_minutes / CAST(180 AS DOUBLE)))) / ({SIDE} * CAST(0.28 AS DOUBLE)) AS dx, (r - {SIDE} * (0.30 + 0.4 * (lead_minutes / CAST(180 AS DOUBLE)))) / ({SIDE} * CAST(0.28 AS DOUBLE)) AS dy FROM f CROSS JOIN g)
SELECT lead_minutes, r, c, round(least(CAST(120 AS DOUBLE), greatest(CAST(0 AS DOUBLE), rate * exp(CAST(-0.5 AS DOUBLE) * (dx * dx + dy * dy)))) + 1e-9, 2) AS rate_mmh FROM x""",
    "f10_convective_cell": _D + f""",{RATE_SQL},
x AS (SELECT CAST(lead_minutes // 15 AS INT) AS place, r, c, rate, c / CAST({SIDE - 1} AS DOUBLE) AS x, r / CAST({SIDE - 1} AS DOUBLE) AS y FROM f CROSS JOIN g),
y AS (SELECT *, CAST(0.25 AS DOUBLE) + CAST(0.05 AS DOUBLE) * place AS cx, CAST(0.45 AS DOUBLE) + CAST(0.03 AS DOUBLE) * sin(place * CAST(0.9 AS DOUBLE)) AS cy FROM x)
SELECT place, r, c, round(greatest(CAST(0 AS DOUBLE), CAST(0.6 AS DOUBLE) * rate + CAST(2.5 AS DOUBLE) * rate * exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / CAST(0.02 AS DOUBLE))) + 1e-9, 6) AS rate_mmh FROM y""",
    "f37_topographic_ponding": _Z + f""",{SCENARIO_SQL},
p AS (SELECT CASE WHEN count(*) > 50 THEN quantile_cont(z, 0.05) ELSE 0 END AS low, CASE WHEN count(*) > 50 THEN quantile_cont(z, 0.35) ELSE 15 END AS middle FROM dem WHERE land = 1 AND z > -50),
x AS (SELECT *, lead_minutes / CAST(60 AS DOUBLE) AS h, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (middle - z) / greatest(CAST(1 AS DOUBLE), middle - low))) AS eta,
  CASE WHEN lead_minutes <= 90 THEN greatest(CAST(0.2 AS DOUBLE), sin(greatest(CAST(0.1 AS DOUBLE), lead_minutes / CAST(90 AS DOUBLE) * {_H}))) ELSE greatest(CAST(0.25 AS DOUBLE), cos(least({_H}, (lead_minutes - 90) / CAST(90 AS DOUBLE) * {_H}))) END AS tf FROM dem CROSS JOIN p CROSS JOIN sc),
y AS (SELECT *, rate_mmh * h * tf / 1000 * CASE WHEN lead_minutes = 0 THEN 0 ELSE least(CAST(0.92 AS DOUBLE), CAST(0.28 AS DOUBLE) + CAST(0.64 AS DOUBLE) * tanh(h * CAST(1.5 AS DOUBLE))) END * (CAST(0.05 AS DOUBLE) + CAST(2.6 AS DOUBLE) * pow(eta, CAST(1.4 AS DOUBLE)))
  + CASE WHEN lead_minutes > 0 AND eta > 0.45 THEN surcharge_m * tanh(h * CAST(2.2 AS DOUBLE)) * (eta - CAST(0.45 AS DOUBLE)) / CAST(0.55 AS DOUBLE) ELSE 0 END AS d FROM x)
SELECT scenario_id, lead_minutes, r, c, round(CASE WHEN NOT (land = 1 AND z > -50) OR d < 0.001 THEN 0 ELSE d END + 1e-9, 4) AS depth_m FROM y""",
    "f38_lowland_ponding": _Z + f""",{SCENARIO_SQL},
p AS (SELECT max(z) AS high, max(z) - min(z) AS span FROM dem),
x AS (SELECT *, CAST((r + c) % 10 AS DOUBLE) / 100 AS slope, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (high - z) / greatest(span, CAST(1 AS DOUBLE)))) AS low,
  greatest(CAST(0 AS DOUBLE), rate_mmh * CASE WHEN lead_minutes <= 90 THEN sin(lead_minutes / CAST(90 AS DOUBLE) * {_H}) ELSE exp(-(lead_minutes - 90) / CAST(45 AS DOUBLE)) END - (12 + 25 * drained)) AS ex FROM dem CROSS JOIN p CROSS JOIN sc)
SELECT scenario_id, lead_minutes, r, c, round(ex / 1000 * (lead_minutes / CAST(60 AS DOUBLE)) * (CAST(0.6 AS DOUBLE) * exp(-8 * slope) + CAST(1.4 AS DOUBLE) * pow(low, CAST(1.8 AS DOUBLE))) + 1e-9, 6) AS depth_m FROM x""",
    "j8_nearest_step": """WITH w AS (SELECT DISTINCT o_custkey % 50 AS k, CAST(o_orderkey % 200 AS INT) AS lead_minutes FROM orders), s AS (SELECT DISTINCT o_custkey % 50 AS k, CAST(o_orderkey % 5 * 60 AS INT) AS step_minutes FROM orders)
SELECT k, lead_minutes, step_minutes, gap AS gap_minutes FROM (SELECT w.k, lead_minutes, step_minutes, abs(lead_minutes - step_minutes) AS gap, row_number() OVER (PARTITION BY w.k, lead_minutes ORDER BY abs(lead_minutes - step_minutes), step_minutes) AS p FROM w JOIN s ON w.k = s.k) WHERE p = 1""",
    "f16_blend_weights": "WITH l AS (SELECT o_orderkey, o_orderkey % 200 AS l FROM orders), w AS (SELECT o_orderkey, round(CASE WHEN l <= 30 THEN CAST(1 AS DOUBLE) WHEN l >= 150 THEN CAST(0 AS DOUBLE) ELSE 1 - (l - 30) / CAST(120 AS DOUBLE) END, 4) AS w FROM l) SELECT o_orderkey, w AS w_radar, round(1 - w, 4) AS w_nwp FROM w",
    "j9_floor_intervals": _G + """,
s AS (SELECT obs_id, epoch_us(observation_time) - epoch_us(min(observation_time) OVER (PARTITION BY sensor_id)) - CAST(3600000000 AS BIGINT) AS u FROM gauge)
SELECT obs_id, CAST(greatest(0, least(95, floor(u / CAST(900000000 AS DOUBLE)))) AS INT) AS place, CAST(greatest(0, least(95, floor(u / CAST(900000000 AS DOUBLE)))) * 900 AS BIGINT) AS interval_seconds FROM s""",
    "j11_minute_frames": _D + f""",{SNAP_SQL},
q AS (SELECT k.scenario_id, CAST(i AS INT) AS lead_minutes, CAST(i // 15 * 15 AS INT) AS low, CAST(i // 15 * 15 + 15 AS INT) AS high FROM (SELECT DISTINCT scenario_id FROM snap) k, range(0, 101) AS t(i)),
b AS (SELECT q.*, (q.lead_minutes - low) / CAST(15 AS DOUBLE) AS al, a.lead_minutes AS la, z.lead_minutes AS lz, a.max_depth_m AS d0, z.max_depth_m AS d1, a.flooded_area_m2 AS f0, z.flooded_area_m2 AS f1, a.storage_m3 AS s0, z.storage_m3 AS s1
      FROM q LEFT JOIN snap a ON a.scenario_id = q.scenario_id AND a.lead_minutes = low LEFT JOIN snap z ON z.scenario_id = q.scenario_id AND z.lead_minutes = high WHERE a.lead_minutes IS NOT NULL OR z.lead_minutes IS NOT NULL)
SELECT scenario_id, lead_minutes, round(CASE WHEN lead_minutes = low THEN d0 ELSE coalesce(d0 * (1 - al) + d1 * al, d0, d1) END + 1e-9, 6) AS max_depth_m, round(CASE WHEN lead_minutes = low THEN f0 ELSE coalesce(f0 * (1 - al) + f1 * al, f0, f1) END + 1e-9, 0) AS flooded_area_m2,
       round(CASE WHEN lead_minutes = low THEN s0 ELSE coalesce(s0 * (1 - al) + s1 * al, s0, s1) END + 1e-9, 3) AS storage_m3, CASE WHEN la IS NULL THEN high WHEN lz IS NULL OR al < 0.5 THEN low ELSE high END AS road_lead_minutes FROM b""",
    "n3_unified_nowcast": _R + f""",
leads AS (SELECT CAST(i * 20 AS INT) AS lead_minutes FROM range(0, 7) AS t(i)),{DRIFT_SQL},{ADVECT_SQL},
l AS (SELECT CAST(i * 20 AS INT) AS lead_minutes FROM range(0, 13) AS t(i)), o AS (SELECT r, c, rate_mmh FROM rain WHERE frame = 1), a AS (SELECT avg(rate_mmh) AS mean FROM o),
q AS (SELECT l.lead_minutes, o.r, o.c, o.rate_mmh AS now, m.rate_mmh AS moved, mean, round(CASE WHEN l.lead_minutes <= 30 THEN CAST(1 AS DOUBLE) WHEN l.lead_minutes >= 150 THEN CAST(0 AS DOUBLE) ELSE 1 - (l.lead_minutes - 30) / CAST(120 AS DOUBLE) END + 1e-9, 4) AS w
      FROM o CROSS JOIN l CROSS JOIN a LEFT JOIN moved m ON m.lead_minutes = l.lead_minutes AND m.r = o.r AND m.c = o.c)
SELECT lead_minutes, r, c, round(greatest(CAST(0 AS DOUBLE), coalesce(CASE WHEN lead_minutes > 30 AND w < 1 THEN w * moved + (1 - w) * mean ELSE moved END, now)) + 1e-9, 6) AS rate_mmh FROM q""",
    "n5_dispatched_methods": _R + f""",
leads AS (SELECT CAST(i * 30 AS INT) AS lead_minutes FROM range(0, 3) AS t(i)),{DRIFT_SQL},{ADVECT_SQL},
n AS (SELECT 'persistence' AS method, lead_minutes, r, c, rate_mmh FROM rain CROSS JOIN leads WHERE frame = 1 UNION ALL SELECT 'advection', lead_minutes, r, c, round(rate_mmh + 1e-9, 6) FROM moved),
q AS (SELECT * FROM (VALUES ('a', 'advection'), ('b', 'persistence'), ('c', 'persistence')) AS t(request, method))
SELECT request, method, lead_minutes, r, c, rate_mmh FROM q JOIN n USING (method)""",
    "j25_fused_feeds": _G + f""",{RATES_SQL},
k AS (SELECT DISTINCT sensor_id FROM gauge),
l AS (SELECT sensor_id, product_type, arg_max(rate_mmh, (observation_time, obs_id)) AS rate FROM rates WHERE rate_mmh IS NOT NULL GROUP BY sensor_id, product_type),
j AS (SELECT k.sensor_id, w.rate AS w, s.rate AS s, CASE WHEN k.sensor_id % 3 = 0 THEN CAST(k.sensor_id % 40 AS DOUBLE) / 10 ELSE CAST(0.4 AS DOUBLE) END AS tide_m, CASE WHEN k.sensor_id % 4 = 0 THEN CAST(k.sensor_id % 900 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS discharge_cms
      FROM k LEFT JOIN l w ON w.sensor_id = k.sensor_id AND w.product_type = 'RAIN_RATE_MMH' LEFT JOIN l s ON s.sensor_id = k.sensor_id AND s.product_type = 'SATELLITE_QPE')
SELECT sensor_id, round((coalesce(w, 0) + coalesce(s, 0)) / CAST(2 AS DOUBLE) + 1e-9, 6) AS fused_rate_mmh, tide_m, tide_m > 2.5 AS surge, discharge_cms FROM j""",
    "f7_design_storms": _S + f""",
r AS (SELECT road_id AS storm_id, CAST(3 AS DOUBLE) AS hours, CAST(2 + road_id % 99 AS DOUBLE) AS years FROM segment), d AS (SELECT *, {IDF_SQL} AS dd FROM r),
storms AS (SELECT storm_id, round(round(dd + 1e-9, 6) + 1e-9, 2) AS total_mm, 12 AS n, 15 AS minutes FROM d),{BLOCKS_SQL} SELECT * FROM blocks""",
    "f9_custom_hyetographs": """WITH c AS (SELECT l_orderkey, round(greatest(CAST(0 AS DOUBLE), CAST(l_quantity AS DOUBLE) - 5), 2) AS x FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS steps, sum(CAST(round(x * 100) AS BIGINT)) / CAST(100 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS total, max(x) AS peak_mmh FROM c GROUP BY l_orderkey)
SELECT l_orderkey, 'P_CUSTOM_' || CAST(floor(total) AS BIGINT) || 'MM_' || steps || 'STEPS' AS profile_id, steps, steps * 15 AS duration_minutes, round(total + 1e-9, 2) AS total_mm, peak_mmh FROM s""",
    "c7_strategies": _D + f""",
packages AS ({values(STRATEGIES, STRATEGY_COLUMNS)}),
b0 AS (SELECT d.scenario_id, d.lead_minutes, d.r, d.c, d.depth_m AS base_m, p.*, n.depth_m AS clean FROM depth d CROSS JOIN packages p LEFT JOIN depth n ON d.scenario_id = 'R' AND n.scenario_id = 'N' AND n.lead_minutes = d.lead_minutes AND n.r = d.r AND n.c = d.c),
b1 AS (SELECT *, CASE WHEN unblock AND clean IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), base_m - (greatest(CAST(0 AS DOUBLE), base_m - clean) + CASE WHEN base_m > 0.2 THEN least(base_m, CAST(0.08 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END)) ELSE base_m END AS d1 FROM b0),
b2 AS (SELECT *, greatest(CAST(0 AS DOUBLE), d1 - least(d1, CAST(0.0125 AS DOUBLE) * lid)) AS d2 FROM b1),
b3 AS (SELECT *, count(*) FILTER (d2 >= 0.15) OVER (PARTITION BY scenario_id, lead_minutes, package) AS n2 FROM b2),
b4 AS (SELECT *, CASE WHEN d2 >= 0.15 AND basin_m3 > 0 THEN greatest(CAST(0 AS DOUBLE), d2 - least(d2, basin_m3 / (n2 * CAST(900 AS DOUBLE)))) ELSE d2 END AS d3 FROM b3),
b5 AS (SELECT *, count(*) FILTER (d3 >= 0.10) OVER (PARTITION BY scenario_id, lead_minutes, package) AS n3 FROM b4),
g AS (SELECT *, CASE WHEN d3 >= 0.10 AND pump_m3s > 0 THEN greatest(CAST(0 AS DOUBLE), d3 - least(d3, pump_m3s * 1800 / (n3 * CAST(900 AS DOUBLE)))) ELSE d3 END AS d FROM b5)
SELECT scenario_id, lead_minutes, package, round(max(d) + 1e-9, 6) AS max_depth_m, round(avg(d) + 1e-9, 6) AS mean_depth_m, count(*) FILTER (d >= 0.05) AS wet_cells FROM g GROUP BY scenario_id, lead_minutes, package""",
    "f19_blocked_diameters": "SELECT p_partkey, round(CAST(0.3 AS DOUBLE) * pow(greatest(CAST(0.01 AS DOUBLE), 1 - least(CAST(0.95 AS DOUBLE), p_size / CAST(40 AS DOUBLE))), CAST(0.375 AS DOUBLE)) + 1e-9, 6) AS diameter_m FROM part",
    "f41_capacity_ratios": "SELECT p_partkey, round(pow(CAST(0.3 AS DOUBLE) * pow(greatest(CAST(0.01 AS DOUBLE), 1 - least(CAST(0.95 AS DOUBLE), p_size / CAST(40 AS DOUBLE))), CAST(0.375 AS DOUBLE)) / CAST(0.3 AS DOUBLE), CAST(8 AS DOUBLE) / 3) + 1e-9, 6) AS capacity_ratio FROM part",
    "f20_parameters": f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 40 - CAST(0.1 AS DOUBLE) END AS v FROM part),
x AS (SELECT *, CASE WHEN v IS NULL THEN usual ELSE greatest(least, least(most, v)) END AS k FROM p CROSS JOIN ({values(PARAMETERS, PARAMETER_COLUMNS)}))
SELECT p_partkey, name, round(k + 1e-9, 6) AS clipped, round((k - least) / (most - least) + 1e-9, 6) AS place, round(least + greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce(v, 0))) * (most - least) + 1e-9, 6) AS back FROM x""",
    "w6_increments": _G + ", s AS (SELECT sensor_id, obs_id AS step, CAST(obs_id AS DOUBLE) * 3 + CAST(sensor_id % 7 AS DOUBLE) AS u FROM gauge) SELECT sensor_id, step, round(u - coalesce(lag(u) OVER (PARTITION BY sensor_id ORDER BY step), 0) + 1e-9, 6) AS depth_mm FROM s",
    "w8_trapezoid_volumes": _G + f""",
s AS (SELECT sensor_id, obs_id AS step, (CAST(raw_value AS DOUBLE) + coalesce(lag(CAST(raw_value AS DOUBLE)) OVER (PARTITION BY sensor_id ORDER BY obs_id), 0)) / 2 * 900 AS v FROM gauge)
SELECT sensor_id, step, round(v + 1e-9, 3) AS volume_m3, round(sum(v) OVER (PARTITION BY sensor_id ORDER BY step {_ROWS}) + 1e-9, 3) AS total_m3 FROM s""",
    "a26_benchmark_tiers": _D + f""",
p AS (SELECT b.scenario_id AS benchmark, a.lead_minutes, a.c, a.depth_m AS s, b.depth_m AS o FROM (SELECT * FROM depth WHERE scenario_id = 'A') a JOIN depth b USING (lead_minutes, r, c)),
n AS (SELECT benchmark, lead_minutes, sum((s - o) * (s - o)) FILTER (c = {SIDE // 2}) AS e, var_pop(o) FILTER (c = {SIDE // 2}) * count(*) FILTER (c = {SIDE // 2}) AS v, count(*) FILTER (s >= 0.05 AND o >= 0.05) AS h, count(*) FILTER (s >= 0.05 OR o >= 0.05) AS u FROM p GROUP BY benchmark, lead_minutes),
q AS (SELECT benchmark, lead_minutes, CASE WHEN v <= 1e-12 OR v IS NULL THEN CASE WHEN e <= 1e-12 THEN CAST(1 AS DOUBLE) END ELSE 1 - e / v END AS nse, CASE WHEN u > 0 THEN h / CAST(u AS DOUBLE) ELSE 1 END AS csi FROM n)
SELECT benchmark, lead_minutes, round(nse + 1e-9, 4) AS nse, round(csi + 1e-9, 4) AS csi, CASE WHEN benchmark <> 'A' AND nse >= 0.75 AND csi >= 0.7 THEN 'TIER_1_PUBLICATION_GRADE' WHEN nse >= 0.5 AND csi >= 0.5 THEN 'TIER_2_OPERATIONAL_GRADE' ELSE 'TIER_3_DIAGNOSTIC_GRADE' END AS tier FROM q""",
}
