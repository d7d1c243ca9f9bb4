"""Queries on checks of grids, frames, forecasts, cubes and tags, and on rules that read a catalog by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.policy import VEHICLES
from rillspark.operators import contracts
from rillspark.operators.roads import steady
from rillspark.plans.testbed import SIDE, view, with_views
from rillspark.sources.tables import table

HEADS = f"""SELECT DISTINCT scenario_id, lead_minutes, {SIDE} AS width, {SIDE} AS height, CASE WHEN lead_minutes = 15 THEN 'mm' ELSE 'mm/h' END AS units, lead_minutes <> 30 AS zoned,
lead_minutes AS valid_from, CASE WHEN lead_minutes = 45 THEN lead_minutes ELSE lead_minutes + 15 END AS valid_to FROM {{depth}}"""
GRIDS = """SELECT p_partkey AS grid_id, p_partkey % 5 <> 0 AS projected, CAST(p_partkey % 40 AS INT) AS width, 20 AS height, CAST(30 AS DOUBLE) AS cell_m, CAST(CASE WHEN p_partkey % 7 = 0 THEN 31 ELSE 30 END AS DOUBLE) AS a,
CAST(CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS b, CAST(p_size AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d, CAST(-30 AS DOUBLE) AS e, CAST(1000 AS DOUBLE) AS f, CAST(p_size AS DOUBLE) AS xmin, CAST(400 AS DOUBLE) AS ymin,
CAST(p_size + 30 * (p_partkey % 40) AS DOUBLE) AS xmax, CAST(1000 AS DOUBLE) AS ymax FROM {part}"""
CUBE = """SELECT l_suppkey AS cube_id, l_orderkey AS cell_id, l_linenumber AS line, CASE l_suppkey % 3 WHEN 0 THEN 'hours' WHEN 1 THEN 'seconds' ELSE 'minutes' END AS time_unit,
CAST(l_linenumber AS DOUBLE) * CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 900 ELSE 15 END AS step, CASE WHEN l_suppkey % 2 = 0 THEN 'kg m-2 s-1' ELSE 'mm/h' END AS unit, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) / CASE WHEN l_suppkey % 2 = 0 THEN 1000 ELSE 1 END - CAST(0.003 AS DOUBLE) END AS value
FROM {lineitem}"""
TAGS = """SELECT p_partkey AS field_id, CASE p_partkey % 7 WHEN 0 THEN 'kg m-2 s-1' WHEN 1 THEN 'mm/h' WHEN 2 THEN 'mm' WHEN 3 THEN 'm' WHEN 4 THEN 'K' WHEN 5 THEN NULL ELSE 'kg m-2' END AS unit,
CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size % 7 AS DOUBLE) END AS hours FROM {part}"""
NAMES = """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN ' car ' WHEN 1 THEN 'Walk' WHEN 2 THEN 'suv' WHEN 3 THEN 'boat' WHEN 4 THEN '4x4' WHEN 5 THEN 'AMBULANCE' WHEN 6 THEN NULL ELSE 'truck' END AS name FROM {customer}"""
LABELS = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'BLOCKED' ELSE 'NOT_FETCHED' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'FIXTURE' WHEN o_orderkey % 3 = 1 THEN 'REAL' ELSE 'SIMULATED' END AS classification FROM {orders}"""
AVAILABLE = """SELECT DISTINCT s_nationkey AS dataset, CASE s_suppkey % 4 WHEN 0 THEN 'diameter' WHEN 1 THEN 'roughness' WHEN 2 THEN 'invert' ELSE 'outfall' END AS attribute, CASE WHEN s_suppkey % 9 = 0 THEN 'ASSUMED' WHEN s_suppkey % 2 = 0 THEN 'PRESENT' ELSE 'DERIVED' END AS availability FROM {supplier}"""
REQUIRED = ("diameter", "roughness", "invert")


def _on(spark, sf, sql):
    names = [n for n in ("part", "lineitem", "customer", "orders", "supplier") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})


def _frames(spark, sf):
    return view(spark, sf, "forecast_frame")


def _dem(spark, sf):
    """Elevations by block of rows, with holes."""
    return view(spark, sf, "dem").selectExpr("CAST(r div 10 AS INT) AS block", "r", "c", "CASE WHEN (r * 3 + c) % 13 = 0 THEN CAST(-9999 AS DOUBLE) ELSE z END AS z", "CAST(30 * (1 + r div 10) AS DOUBLE) AS cell_m", "r div 10 <> 2 AS projected")


def _pairs(spark, sf):
    depth = view(spark, sf, "depth")
    side = lambda k, n: depth.where(F.col("scenario_id") == k).select("lead_minutes", "r", "c", F.col("depth_m").alias(n))
    return side("A", "f").join(side("N", "o").hint("merge"), ["lead_minutes", "r", "c"], "full")


QUERIES = {
    "s1_known_frames": lambda s, d: contracts.known_frames(view(s, d, "depth").select("scenario_id").distinct().crossJoin(s.sql("SELECT CAST(id * 10 AS INT) AS lead_minutes FROM range(0, 13)").hint("broadcast")), view(s, d, "depth"), "scenario_id", "lead_minutes"),
    "p8_checked_frames": lambda s, d: contracts.checked_frames(view(s, d, "depth").withColumnRenamed("depth_m", "rate_mmh"), s.sql(HEADS, depth=view(s, d, "depth")), "scenario_id", "lead_minutes"),
    "p9_checked_grids": lambda s, d: contracts.checked_grids(_on(s, d, GRIDS), "grid_id"),
    "p10_in_domain": lambda s, d: contracts.in_domain(table(s, d, "customer").selectExpr("c_custkey", "CAST(c_custkey * 37 % 20000 AS DOUBLE) AS x", "CAST(c_custkey * 91 % 20000 AS DOUBLE) AS y"), 5000.0, 6000.0, 15000.0, 12000.0),
    "p11_forecast_intervals": lambda s, d: contracts.forecast_intervals(table(s, d, "events").select("event_id", F.col("ts").alias("issue")), 60, 15),
    "p12_checked_forecasts": lambda s, d: contracts.checked_forecasts(_frames(s, d), "forecast_id"),
    "p13_forcing": lambda s, d: contracts.forcing(_frames(s, d), 60, "forecast_id").select("forecast_id", "lead_minutes", "width"),
    "p14_conditioned": lambda s, d: contracts.conditioned(_dem(s, d), "block").select("block", "r", "c", "z_out", "filled"),
    "a45_conditioning_report": lambda s, d: contracts.conditioning_report(contracts.conditioned(_dem(s, d), "block"), "block"),
    "s11_cube_leads": lambda s, d: contracts.cube_leads(_on(s, d, CUBE), "cube_id").select("cube_id", "cell_id", "line", "lead_minutes", "rate_mmh"),
    "s12_tagged_rates": lambda s, d: contracts.tagged_rates(_on(s, d, TAGS)).select("field_id", "unit", "hours", "factor", "reason"),
    "s14_raster_audit": lambda s, d: contracts.raster_audit(_dem(s, d), 60.0, "block"),
    "p15_result_labels": lambda s, d: _on(s, d, LABELS).select("o_orderkey", F.array_join(contracts.result_labels(F.col("status"), F.col("classification")), ",").alias("labels")),
    "p16_interval_index": lambda s, d: table(s, d, "orders").select("o_orderkey", contracts.interval_index(F.col("o_orderkey") % 400, 15, 12).alias("place")),
    "p18_profiles": lambda s, d: _on(s, d, NAMES).select("c_custkey", contracts.profile_of(F.col("name")).alias("profile")),
    "a16_verification_status": lambda s, d: contracts.verification_status(_pairs(s, d), "lead_minutes"),
    "a48_readiness": lambda s, d: contracts.readiness(_on(s, d, AVAILABLE), REQUIRED, "dataset"),
    "f27_times": lambda s, d: table(s, d, "events").select("event_id", contracts.iso_utc(F.col("ts")).alias("utc"), contracts.local_display(F.col("ts")).alias("local")),
    "p4_unit_rates": lambda s, d: table(s, d, "events").select("event_id", (F.col("value").cast("double") / 3.6e6).alias("rate_ms"), steady(F.col("value").cast("double") / 3.6e6 * 3.6e6).alias("rate_mmh")),
}


def _t(*pairs: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '" + t.replace("'", "''") + "' END" for c, t in pairs) + ")"


def _plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


def _close(a: str, b: str) -> str:
    return f"abs({a} - ({b})) <= 1e-8 + 1e-5 * abs({b})"


_D, _FR, _Z = with_views("depth"), with_views("forecast_frame"), with_views("dem")
DEM_SQL = "g AS (SELECT CAST(r // 10 AS INT) AS block, r, c, CASE WHEN (r * 3 + c) % 13 = 0 THEN CAST(-9999 AS DOUBLE) ELSE z END AS z, CAST(30 * (1 + r // 10) AS DOUBLE) AS cell_m, r // 10 <> 2 AS projected FROM dem)"
VALID = "z > -100 AND z < 9000"
_names = " ".join(f"WHEN '{v[0]}' THEN '{v[0]}'" for v in VEHICLES) + " " + " ".join(f"WHEN '{a}' THEN '{v}'" for a, v in contracts.ALIASES.items())
ORACLES = {
    "s1_known_frames": _D + ", w AS (SELECT DISTINCT scenario_id, CAST(i * 10 AS INT) AS lead_minutes FROM depth, range(0, 13) AS t(i)) SELECT w.*, CASE WHEN EXISTS (SELECT 1 FROM depth d WHERE d.scenario_id = w.scenario_id AND d.lead_minutes = w.lead_minutes) THEN 'KNOWN' ELSE 'UNKNOWN' END AS status FROM w",
    "p8_checked_frames": _D + f""",
h AS ({_plain(HEADS)}), n AS (SELECT scenario_id, lead_minutes, count(*) AS n, max(r) AS lr, max(c) AS lc, count(*) FILTER (depth_m < 0) AS neg, count(*) FILTER (depth_m IS NULL OR isnan(depth_m) OR isinf(depth_m)) AS odd FROM depth GROUP BY ALL),
x AS (SELECT scenario_id, lead_minutes, {_t(("NOT zoned", "TIME_WITHOUT_ZONE"), ("valid_to <= valid_from", "EMPTY_INTERVAL"), ("units <> 'mm/h'", "UNITS_NOT_MM_PER_HOUR"), ("n <> width * height OR lr <> height - 1 OR lc <> width - 1", "CELLS_DO_NOT_FILL_GRID"), ("odd > 0", "RATE_NOT_FINITE"), ("neg > 0", "RATE_BELOW_ZERO"))} AS errors FROM h JOIN n USING (scenario_id, lead_minutes))
SELECT *, errors = '' AS accepted FROM x""",
    "p9_checked_grids": f"""WITH g AS ({_plain(GRIDS)}),
x AS (SELECT grid_id, {_t(("width < 2 OR height < 2", "TOO_FEW_CELLS"), ("NOT projected", "NOT_PROJECTED"), ("b <> 0 OR d <> 0", "ROTATED"), ("a <= 0 OR e >= 0", "NOT_NORTH_UP"), (f"NOT ({_close('a', 'abs(e)')}) OR NOT ({_close('a', 'cell_m')})", "CELL_SIZE_DIFFERS"), ("xmin >= xmax OR ymin >= ymax", "BOUNDS_REVERSED"), (f"NOT ({_close('c', 'xmin')}) OR NOT ({_close('f', 'ymax')})", "ORIGIN_DIFFERS"), (f"NOT ({_close('(xmax - xmin)', 'a * width')}) OR NOT ({_close('(ymax - ymin)', 'abs(e) * height')})", "EXTENT_DIFFERS"))} AS errors FROM g)
SELECT *, errors = '' AS accepted FROM x""",
    "p10_in_domain": "WITH p AS (SELECT c_custkey, CAST(c_custkey * 37 % 20000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 20000 AS DOUBLE) AS y FROM customer) SELECT * FROM p WHERE x BETWEEN 3500 AND 16500 AND y BETWEEN 4500 AND 13500",
    "p11_forecast_intervals": "SELECT event_id, ts AS issue, CAST(k * 15 AS INT) AS lead_minutes, ts + to_minutes(k * 15) AS valid_from, ts + to_minutes(k * 15 + 15) AS valid_to FROM events, range(0, 4) AS t(k)",
    "p12_checked_forecasts": _FR + f""",
n AS (SELECT forecast_id, count(*) AS frames, list_sort(list(DISTINCT lead_minutes)) AS have, count(*) FILTER (units <> 'mm/h') AS u, count(DISTINCT (width, height)) AS shapes, count(DISTINCT reference) AS systems, max(resolution_m) - min(resolution_m) AS spread FROM forecast_frame GROUP BY forecast_id),
x AS (SELECT forecast_id, frames, {_t(("NOT (have = [0, 15, 30, 45, 60] AND frames = 5)", "LEADS_DIFFER"), ("u > 0", "UNITS_NOT_MM_PER_HOUR"), ("shapes > 1", "SHAPES_DIFFER"), ("systems > 1", "REFERENCES_DIFFER"), ("spread > 1e-9", "RESOLUTIONS_DIFFER"))} AS errors FROM n)
SELECT *, errors = '' AS accepted FROM x""",
    "p13_forcing": _FR + " SELECT forecast_id, lead_minutes, width FROM forecast_frame WHERE lead_minutes < 60 AND forecast_id IN (SELECT forecast_id FROM forecast_frame WHERE lead_minutes < 60 GROUP BY forecast_id HAVING count(*) = 4)",
    "p14_conditioned": _Z + f",{DEM_SQL} SELECT block, r, c, CASE WHEN {VALID} THEN z ELSE min(CASE WHEN {VALID} THEN z END) OVER (PARTITION BY block) END AS z_out, NOT ({VALID}) AS filled FROM g",
    "a45_conditioning_report": _Z + f",{DEM_SQL} SELECT block, count(*) AS cells, count(*) FILTER (NOT ({VALID})) AS nodata_cells, count(*) FILTER (NOT ({VALID})) AS changed_cells, CAST(0 AS DOUBLE) AS volume_change_m3, bool_and(NOT ({VALID})) AS all_nodata FROM g GROUP BY block",
    "s11_cube_leads": f"""WITH q AS ({_plain(CUBE)}), f AS (SELECT *, step - min(step) OVER (PARTITION BY cube_id) AS since FROM q)
SELECT cube_id, cell_id, line, CAST(round(CASE time_unit WHEN 'hours' THEN since * 60 WHEN 'seconds' THEN since / 60 ELSE since END) AS INT) AS lead_minutes,
       round(CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE least(CAST(300 AS DOUBLE), greatest(CAST(0 AS DOUBLE), value * CASE WHEN unit = 'kg m-2 s-1' THEN 3600 ELSE 1 END)) END + 1e-9, 6) AS rate_mmh FROM f""",
    "s12_tagged_rates": f"""WITH t AS ({_plain(TAGS)}), u AS (SELECT *, coalesce(unit, '') AS u, coalesce(hours > 0, false) AS timed FROM t)
SELECT field_id, unit, hours, CASE WHEN u = 'kg m-2 s-1' THEN CAST(3600 AS DOUBLE) WHEN u IN ('mm/h', '') THEN CAST(1 AS DOUBLE) WHEN u IN ('mm', 'kg m-2') AND timed THEN 1 / hours WHEN u = 'm' AND timed THEN 1000 / hours END AS factor,
       CASE WHEN u IN ('mm', 'kg m-2', 'm') AND NOT timed THEN 'ACCUMULATION_WITHOUT_INTERVAL' WHEN u = 'K' THEN 'UNSUPPORTED_UNIT' END AS reason FROM u""",
    "s14_raster_audit": _Z + f""",{DEM_SQL},
n AS (SELECT block, max(r) + 1 AS height, max(c) + 1 AS width, max(cell_m) AS cell_m, bool_and(projected) AS projected, count(*) FILTER ({VALID}) AS valid FROM g GROUP BY block),
o AS (SELECT *, greatest(cell_m / 60, 60 / cell_m) AS o FROM n),
x AS (SELECT block, height, width, valid, {_t(("height < 2 OR width < 2", "raster is smaller than 2 x 2"), ("o > 3", "resolution is far from the expected one"), ("valid = 0", "raster holds no data"))} AS errors, {_t(("NOT projected", "reference system differs"), ("o > 1.5 AND o <= 3", "resolution differs from the expected one"))} AS warnings FROM o)
SELECT *, CASE WHEN errors = '' THEN 'VALIDATED' ELSE 'BLOCKED' END AS status FROM x""",
    "p15_result_labels": f"WITH l AS ({_plain(LABELS)}) SELECT o_orderkey, status || ',' || classification || ',' || CASE WHEN status IN ('NOT_FETCHED', 'BLOCKED') THEN 'NO_DATA' WHEN classification IN ('FIXTURE', 'SIMULATED') THEN 'SYNTHETIC' ELSE 'REAL_DATA' END AS labels FROM l",
    "p16_interval_index": "SELECT o_orderkey, CAST(least(o_orderkey % 400 // 15, 11) AS INT) AS place FROM orders",
    "p18_profiles": f"WITH n AS ({_plain(NAMES)}) SELECT c_custkey, coalesce(CASE upper(trim(name)) {_names} END, 'LIGHT_VEHICLE') AS profile FROM n",
    "a16_verification_status": _D + """,
p AS (SELECT lead_minutes, a.depth_m AS f, b.depth_m AS o FROM (SELECT * FROM depth WHERE scenario_id = 'A') a FULL JOIN (SELECT * FROM depth WHERE scenario_id = 'N') b USING (lead_minutes, r, c)),
n AS (SELECT lead_minutes, count(*) FILTER (f IS NOT NULL AND o IS NOT NULL) AS pairs, count(f) AS nf, count(o) AS no FROM p GROUP BY lead_minutes)
SELECT lead_minutes, pairs, CASE WHEN nf = 0 OR no = 0 THEN 'NOT_EVALUATED' WHEN pairs = nf AND pairs = no THEN 'EVALUATED' ELSE 'INSUFFICIENT_DATA' END AS status FROM n""",
    "a48_readiness": f"""WITH a AS ({_plain(AVAILABLE)}), h AS (SELECT dataset, attribute, min(availability) AS availability FROM a GROUP BY ALL),
e AS (SELECT d.dataset, q.attribute, coalesce(h.availability, 'MISSING') AS availability FROM (SELECT DISTINCT dataset FROM a) d CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in REQUIRED)}) AS q(attribute) LEFT JOIN h ON h.dataset = d.dataset AND h.attribute = q.attribute)
SELECT *, bool_and(availability IN ('PRESENT', 'DERIVED')) OVER (PARTITION BY dataset) AS ready FROM e""",
    "f27_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(ts + INTERVAL '330 minutes', '%Y-%m-%d %H:%M') AS local FROM events",
    "p4_unit_rates": "SELECT event_id, CAST(value AS DOUBLE) / 3.6e6 AS rate_ms, round(CAST(value AS DOUBLE) / 3.6e6 * 3.6e6 + 1e-9, 6) AS rate_mmh FROM events",
}
