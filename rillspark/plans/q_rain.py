"""Queries on gauges and design storms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import gauges, storms
from rillspark.operators.roads import steady
from rillspark.plans.testbed import view, with_views

def _obs(spark, sf):
    return view(spark, sf, "gauge")


def _rates(spark, sf):
    return gauges.standardised(_obs(spark, sf)).where("rate_mmh IS NOT NULL")


def _now(spark, sf):
    """One hour before the newest observation of the table, so that all kinds of age occur."""
    return _obs(spark, sf).agg((F.max(F.col("observation_time").cast("timestamp")) - F.expr("INTERVAL 1 HOUR")).alias("now"))


def _storms(spark, sf):
    """One storm an order: total 20 to 119 mm in 4 to 15 blocks."""
    return view(spark, sf, "segment").selectExpr("road_id AS storm_id", "CAST(20 + road_id % 100 AS DOUBLE) AS total_mm", "CAST(4 + road_id % 12 AS INT) AS n", "15 AS minutes")


def nearest(spark, sf):
    """The observation nearest to 7 minutes after each observation."""
    wanted = _obs(spark, sf).select("sensor_id", (F.col("observation_time") + F.expr("INTERVAL 7 MINUTES")).alias("t")).distinct()
    return gauges.nearest_in_time(wanted, _obs(spark, sf)).select("sensor_id", "t", "obs_id", "gap_seconds", "fallback")


def _health(spark, sf):
    """Every sensor a provider, at 30 minutes after the newest observation of the table."""
    now = _obs(spark, sf).agg(F.max(F.col("observation_time").cast("timestamp"))).first()[0]
    return gauges.health(_obs(spark, sf), F.lit(now) + F.expr("INTERVAL 30 MINUTES"), "sensor_id")


QUERIES = {
    "s13_standard_rates": lambda s, d: _rates(s, d).select("obs_id", "product_type", steady(F.col("rate_mmh")).alias("rate_mmh"), steady(gauges.reflectivity(F.col("rate_mmh"))).alias("dbz")),
    "s13_frame_statistics": lambda s, d: gauges.frame_statistics(_rates(s, d), "product_type"),
    "p6_quality": lambda s, d: gauges.quality(_obs(s, d).crossJoin(F.broadcast(_now(s, d))), F.col("now")).select("obs_id", "freshness", "errors", "warnings", "valid", "observable"),
    "st2_accumulated": lambda s, d: gauges.accumulated(_rates(s, d)),
    "t8_latest": lambda s, d: gauges.latest(_obs(s, d).select("sensor_id", "obs_id", "observation_time", "product_type"), "sensor_id"),
    "a47_provider_health": _health,
    "j7_nearest_in_time": nearest,
    "f6_published_depths": lambda s, d: storms.published_depths(_storms(s, d).selectExpr("storm_id", "CAST(n * minutes AS DOUBLE) / CAST(20 AS DOUBLE) AS hours", "CAST(2 + storm_id % 99 AS DOUBLE) AS years")),
    "f3_intensities": lambda s, d: _storms(s, d).select("storm_id", steady(storms.kothyari_garde(F.lit(8.3), F.col("total_mm"), F.lit(10.0), F.col("n") / 4.0)).alias("kothyari_garde"), steady(storms.sherman(F.lit(5850.0), F.lit(0.22), F.lit(18.0), F.lit(0.74), F.lit(10.0), F.col("n") * 15.0)).alias("sherman"), steady(storms.short_duration_depth(F.col("total_mm"), F.col("n") / 4.0)).alias("depth_mm")),
    "w7_alternating_blocks": lambda s, d: storms.alternating_blocks(_storms(s, d)),
    "f8_chicago": lambda s, d: storms.chicago(_storms(s, d)),
    "w7_blocks_around_peak": lambda s, d: storms.blocks_around_peak(_storms(s, d)),
    "w9_ponded": lambda s, d: storms.ponded(storms.blocks_around_peak(_storms(s, d)).withColumn("minutes", F.lit(15))),
    "w9_excess": lambda s, d: storms.excess(storms.alternating_blocks(_storms(s, d)).withColumn("minutes", F.lit(15))),
}

D = "CAST({} AS DOUBLE)".format
_G = with_views("gauge")
RATES_SQL = f"""
rates AS (SELECT *, CASE WHEN product_type = 'REFLECTIVITY_DBZ' THEN CASE WHEN v IS NULL OR isnan(v) OR v < 10 THEN {D(0)} ELSE pow(pow({D(10)}, least(v, {D(55)}) / 10) / 300, 1 / {D(1.4)}) END
  WHEN product_type IN ('RAIN_RATE_MMH', 'SATELLITE_QPE', 'ACCUMULATION_MM') THEN CASE WHEN v IS NULL OR isnan(v) THEN {D(0)} ELSE greatest({D(0)}, v) END END AS rate_mmh FROM (SELECT *, CAST(raw_value AS DOUBLE) AS v FROM gauge))"""
STORMS_SQL = "storms AS (SELECT road_id AS storm_id, CAST(20 + road_id % 100 AS DOUBLE) AS total_mm, CAST(4 + road_id % 12 AS INT) AS n, 15 AS minutes FROM segment)"
BLOCKS_SQL = """
blocks AS (SELECT storm_id, CAST(CASE WHEN k = 1 THEN n // 2 WHEN (k - 1) % 2 = 1 THEN n // 2 - k // 2 ELSE n // 2 + (k - 1) // 2 END AS INT) AS slot,
  round(total_mm * (pow(k / CAST(n AS DOUBLE), CAST(0.4 AS DOUBLE)) - CASE WHEN k > 1 THEN pow((k - 1) / CAST(n AS DOUBLE), CAST(0.4 AS DOUBLE)) ELSE 0 END) / (minutes / CAST(60 AS DOUBLE)) + 1e-9, 6) AS rate_mmh
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM storms))"""
AROUND_SQL = """
around AS (SELECT s.storm_id, s.slot, coalesce(p.rate_mmh, 0) AS rate_mmh FROM (SELECT storm_id, CAST(unnest(range(0, n)) AS INT) AS slot FROM storms) s LEFT JOIN (
  SELECT storm_id, CASE WHEN k % 2 = 0 THEN n // 2 - k // 2 ELSE n // 2 + 1 + k // 2 END AS slot, round(total_mm * (pow((k + 1) / CAST(n AS DOUBLE), CAST(0.4 AS DOUBLE)) - CASE WHEN k > 0 THEN pow(k / CAST(n AS DOUBLE), CAST(0.4 AS DOUBLE)) ELSE 0 END) * 60 / minutes + 1e-9, 2) AS rate_mmh
  FROM (SELECT *, unnest(range(0, n)) AS k FROM storms)) p USING (storm_id, slot))"""
_S = with_views("segment") + f",{STORMS_SQL}"
_node = lambda k: f"({D(storms.IDF[k][1])} * pow(years / 2, ln({D(storms.IDF[k][2] / storms.IDF[k][1])}) / ln({D(50)})) * {storms.IDF[k][0]})"
IDF_SQL = "CASE WHEN hours <= 1 THEN " + _node(0) + " * hours" + "".join(
    f" WHEN hours <= {storms.IDF[k + 1][0]} THEN exp(ln({_node(k)}) + (ln({_node(k + 1)}) - ln({_node(k)})) * (ln(hours) - ln({D(storms.IDF[k][0])})) / (ln({D(storms.IDF[k + 1][0])}) - ln({D(storms.IDF[k][0])})))" for k in range(5)
) + f" ELSE {_node(5)} / 48 * hours END"
ORACLES = {
    "s13_standard_rates": _G + f",{RATES_SQL} SELECT obs_id, product_type, round(rate_mmh + 1e-9, 6) AS rate_mmh, round(CASE WHEN rate_mmh <= 0 THEN -30 ELSE 10 * log10(300 * pow(greatest(rate_mmh, 1e-6), {D(1.4)})) END + 1e-9, 6) AS dbz FROM rates WHERE rate_mmh IS NOT NULL",
    "s13_frame_statistics": _G + f",{RATES_SQL} SELECT product_type, count(*) AS n, round(avg(rate_mmh) + 1e-9, 6) AS mean_mmh, round(max(rate_mmh) + 1e-9, 6) AS max_mmh, round(min(rate_mmh) + 1e-9, 6) AS min_mmh, round(avg(CASE WHEN rate_mmh >= 0.1 THEN 1 ELSE 0 END) + 1e-9, 6) AS wet_fraction FROM rates WHERE rate_mmh IS NOT NULL GROUP BY product_type",
    "p6_quality": _G + """,
a AS (SELECT obs_id, CAST(raw_value AS DOUBLE) AS v, (epoch_us((SELECT max(observation_time) FROM gauge)) - CAST(3600000000 AS BIGINT) - epoch_us(observation_time)) / CAST(60000000 AS DOUBLE) AS age FROM gauge),
b AS (SELECT *, printf('%.1f', round(abs(age) + 1e-9, 1)) AS m FROM a),
c AS (SELECT obs_id, CASE WHEN age < -30 THEN 'INVALID' WHEN age <= 30 THEN 'FRESH' WHEN age <= 240 THEN 'STALE' ELSE 'MISSING' END AS freshness,
  concat_ws('; ', CASE WHEN v IS NULL OR isnan(v) THEN 'RATE_NOT_FINITE' END, CASE WHEN v < -0.001 THEN 'RATE_BELOW_ZERO ' || printf('%.4f', round(v - 1e-9, 4)) || ' mm/h' END,
    CASE WHEN age < -30 THEN 'AHEAD_OF_TIME ' || m || ' minutes' END, CASE WHEN age > 120 THEN 'AGE ' || m || ' min too old' END) AS errors,
  concat_ws('; ', CASE WHEN age < 0 AND age >= -30 THEN 'AHEAD_OF_TIME ' || m || ' minutes' END, CASE WHEN age > 30 AND age <= 120 THEN 'AGE ' || m || ' min old' END) AS warnings FROM b)
SELECT *, errors = '' AS valid, errors = '' AND freshness IN ('FRESH', 'STALE') AS observable FROM c""",
    "st2_accumulated": _G + f""",{RATES_SQL}
SELECT sensor_id, time_bucket(INTERVAL '15 minutes', observation_time) AS valid_from, time_bucket(INTERVAL '15 minutes', observation_time) + INTERVAL '15 minutes' AS valid_to, count(*) AS n,
       round(avg(rate_mmh) + 1e-9, 6) AS rate_mmh, round(avg(rate_mmh) * 15 / {D(60)} + 1e-9, 6) AS depth_mm FROM rates WHERE rate_mmh IS NOT NULL GROUP BY ALL""",
    "t8_latest": _G + " SELECT sensor_id, obs_id, observation_time, product_type FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY observation_time DESC, obs_id DESC) AS k FROM gauge) WHERE k = 1",
    "a47_provider_health": _G + """,
h AS (SELECT sensor_id, count(observation_time) AS observations, max(observation_time) AS last_observation, ((SELECT epoch_us(max(observation_time)) FROM gauge) + CAST(1800000000 AS BIGINT) - epoch_us(max(observation_time))) / CAST(60000000 AS DOUBLE) AS age FROM gauge GROUP BY sensor_id)
SELECT sensor_id, observations, last_observation, CASE WHEN age <= 45 THEN 'HEALTHY' WHEN age <= 90 THEN 'DEGRADED' ELSE 'UNAVAILABLE' END AS status,
  CASE WHEN age <= 20 THEN 'FRESH' WHEN age <= 45 THEN 'AGING' WHEN age <= 90 THEN 'STALE' ELSE 'EXPIRED' END || ', ' || printf('%.1f', age) || ' min, ' || observations || ' observations' AS message FROM h""",
    "j7_nearest_in_time": _G + """,
w AS (SELECT DISTINCT sensor_id, observation_time + INTERVAL '7 minutes' AS t FROM gauge),
l AS (SELECT sensor_id, max(observation_time) AS lt, arg_max(obs_id, (observation_time, obs_id)) AS lo FROM gauge GROUP BY sensor_id),
n AS (SELECT w.sensor_id, t, obs_id, abs(epoch_us(t) - epoch_us(observation_time)) AS gap, observation_time FROM w JOIN gauge g ON g.sensor_id = w.sensor_id WHERE abs(epoch_us(t) - epoch_us(observation_time)) <= 900000000),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, t ORDER BY gap, observation_time, obs_id) AS k FROM n) WHERE k = 1)
SELECT w.sensor_id, w.t, coalesce(b.obs_id, lo) AS obs_id, coalesce(gap, abs(epoch_us(w.t) - epoch_us(lt))) / CAST(1000000 AS DOUBLE) AS gap_seconds, b.obs_id IS NULL AS fallback
FROM w JOIN l ON l.sensor_id = w.sensor_id LEFT JOIN b ON b.sensor_id = w.sensor_id AND b.t = w.t""",
    "f6_published_depths": _S + f",r AS (SELECT storm_id, CAST(n * minutes AS DOUBLE) / {D(20)} AS hours, CAST(2 + storm_id % 99 AS DOUBLE) AS years FROM storms), d AS (SELECT *, {IDF_SQL} AS dd FROM r) SELECT storm_id, hours, years, round(dd + 1e-9, 6) AS depth_mm, round(dd / hours + 1e-9, 6) AS intensity_mmh FROM d",
    "f3_intensities": _S + f" SELECT storm_id, round({D(8.3)} * pow(total_mm, {D(0.33)}) * pow({D(10)}, {D(0.2)}) / pow(n / {D(4)}, {D(0.71)}) + 1e-9, 6) AS kothyari_garde, round({D(5850)} * pow({D(10)}, {D(0.22)}) / pow(n * {D(15)} + 18, {D(0.74)}) + 1e-9, 6) AS sherman, round(total_mm * pow(n / {D(4)} / 24, {D(0.45)}) + 1e-9, 6) AS depth_mm FROM storms",
    "w7_alternating_blocks": _S + f",{BLOCKS_SQL} SELECT * FROM blocks",
    "f8_chicago": _S + """,
k AS (SELECT *, unnest(range(0, n)) AS slot FROM storms),
i AS (SELECT *, round(total_mm * CAST(1.5 AS DOUBLE) / pow(abs((slot + CAST(0.5 AS DOUBLE)) * minutes - n * minutes * CAST(0.35 AS DOUBLE)) + 10, CAST(0.75 AS DOUBLE)) + 1e-9, 2) AS i FROM k)
SELECT storm_id, CAST(slot AS INT) AS slot, round(i * (total_mm / greatest(sum(i) OVER (PARTITION BY storm_id) * (minutes / CAST(60 AS DOUBLE)), 1e-3)) + 1e-9, 2) AS rate_mmh FROM i""",
    "w7_blocks_around_peak": _S + f",{AROUND_SQL} SELECT * FROM around",
    "w9_ponded": _S.replace("WITH ", "WITH RECURSIVE ", 1) + f""",{AROUND_SQL},
a AS (SELECT storm_id, slot, rate_mmh * 15 / {D(60)} AS mm, sum(rate_mmh * 15 / {D(60)}) OVER w AS total, sum(CASE WHEN rate_mmh > 0 THEN 15 ELSE 0 END) OVER w AS wet FROM around WINDOW w AS (PARTITION BY storm_id ORDER BY slot ROWS UNBOUNDED PRECEDING)),
b AS (SELECT storm_id, slot, greatest({D(0)}, total - 2) - greatest({D(0)}, total - mm - 2) AS added, (2 + 23 * exp(-wet * 60 / {D(1800)})) * 15 / {D(60)} AS cap FROM a),
h AS (SELECT storm_id, slot, added, least(added, cap) AS taken, greatest({D(0)}, added - cap) AS stands FROM b WHERE slot = 0
      UNION ALL SELECT b.storm_id, b.slot, b.added, least(h.stands + b.added, b.cap), greatest({D(0)}, h.stands + b.added - b.cap) FROM h JOIN b ON b.storm_id = h.storm_id AND b.slot = h.slot + 1)
SELECT storm_id, slot, round(added + 1e-9, 6) AS surface_mm, round(taken + 1e-9, 6) AS infiltrated_mm, round(stands + 1e-9, 6) AS ponded_mm FROM h""",
    "w9_excess": _S + f""",{BLOCKS_SQL},
a AS (SELECT storm_id, slot, rate_mmh * 15 / {D(60)} AS mm FROM blocks),
b AS (SELECT *, sum(mm) OVER (PARTITION BY storm_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS total FROM a),
c AS (SELECT *, greatest({D(0)}, total - 2) - greatest({D(0)}, total - mm - 2) AS lft FROM b)
SELECT storm_id, slot, round(lft + 1e-9, 6) AS surface_mm, round(greatest({D(0)}, lft - (2 + 23 * exp(-slot * 15 * 60 / {D(1800)})) * 15 / {D(60)}) + 1e-9, 6) AS excess_mm FROM c""",
}
