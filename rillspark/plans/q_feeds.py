"""Queries on nested feeds: a document for each event or part, put together from its columns, is parsed and flattened."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.sources import feeds
from rillspark.sources.tables import table

#: The box of stations that are kept.
BOX = (10.0, -20.0, 60.0, 40.0)


def _at(k: int) -> str:
    return f"date_format(ts + make_interval(0, 0, 0, 0, 0, {k}, 0), \"yyyy-MM-dd'T'HH:mm\")"


def _documents(spark, sf, text: str):
    """event_id and a JSON document of an event's own columns (v: its value)."""
    return table(spark, sf, "events").selectExpr("event_id", "event_type", "ts", "CAST(value AS DOUBLE) AS v", "CAST(event_id AS BIGINT) AS n").selectExpr("event_id", f"to_json({text}) AS feed")


def _weather(spark, sf):
    arrays = f"named_struct('time', array({_at(0)}, {_at(15)}, {_at(30)}, {_at(45)}), 'precipitation', array(v, v / 2, CAST(NULL AS DOUBLE), v / 4))"
    hourly = f"named_struct('time', array({_at(0)}, {_at(60)}), 'precipitation_alpha', array(v, v + 1), 'precipitation_beta', array(v / 2, CAST(NULL AS DOUBLE)), 'weather_code_alpha', array(1.0D, 2.0D))"
    return _documents(spark, sf, f"named_struct('current', CASE WHEN event_type <> 'view' THEN named_struct('time', {_at(0)}, 'precipitation', v) END, 'minutely_15', {arrays}, 'hourly', {hourly})")


def _marine(spark, sf):
    return _documents(spark, sf, "named_struct('hourly', named_struct('sea_level_height_msl', transform(sequence(0, 29), k -> CASE WHEN (n + k) % 4 <> 0 THEN CAST((n * 7 + k * 3) % 40 AS DOUBLE) / 10 END)))")


def _boxes(spark, sf):
    sensor = "named_struct('_id', concat('s', n, '-', k), 'title', 'Rain', 'unit', 'mm', 'sensorType', event_type)"
    return _documents(spark, sf, f"named_struct('_id', concat('b', n), 'name', concat('Box ', n), 'exposure', 'outdoor', 'currentLocation', named_struct('coordinates', array(CAST(n % 90 AS DOUBLE), CAST(n % 80 - 40 AS DOUBLE))), 'sensors', transform(sequence(1, CAST(1 + n % 3 AS INT)), k -> {sensor}))")


def _radar(spark, sf):
    frames = lambda n, base: f"transform(sequence(0, {n}), k -> named_struct('time', n * 600 + {base} + k * 600, 'path', concat('/v2/', n, '/', {base} + k)))"
    return _documents(spark, sf, f"named_struct('host', 'https://tiles', 'radar', named_struct('past', {frames(2, 0)}, 'nowcast', {frames('CAST(n % 2 AS INT)', 3)}))")


def _geojson(spark, sf):
    line = "named_struct('geometry', named_struct('type', 'LineString', 'coordinates', transform(sequence(0, CAST(n % 4 AS INT)), k -> array(CAST(n % 100 + k AS DOUBLE), CAST(n % 50 - k AS DOUBLE)))), 'properties', named_struct('waterway', event_type))"
    point = "named_struct('geometry', named_struct('type', 'Point', 'coordinates', array(array(CAST(n AS DOUBLE)))), 'properties', named_struct('waterway', 'none'))"
    return _documents(spark, sf, f"named_struct('features', array({point}, {line}))")


def _elements(spark, sf):
    """A node for each part and a way for each third one, over nodes of which some do not exist."""
    part = table(spark, sf, "part")
    nodes = part.selectExpr("'node' AS type", "p_partkey AS id", "CAST(p_partkey % 360 AS DOUBLE) / 2 AS lon", "CAST(p_partkey % 170 AS DOUBLE) / 2 AS lat", "CAST(NULL AS ARRAY<BIGINT>) AS nodes")
    ways = part.where("p_partkey % 3 = 0").selectExpr("'way' AS type", "p_partkey AS id", "CAST(NULL AS DOUBLE) AS lon", "CAST(NULL AS DOUBLE) AS lat", "array(p_partkey, p_partkey * 2, p_partkey * 3, p_partkey + 1) AS nodes")
    return nodes.unionByName(ways)


def _lines(points):
    """Points as text, so that engines agree: x y, x y."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p[0].cast("decimal(12,2)").cast("string"), p[1].cast("decimal(12,2)").cast("string"))), ", ")


QUERIES = {
    "s6_current_weather": lambda s, d: feeds.current_weather(_weather(s, d), "event_id"),
    "s6_quarter_hours": lambda s, d: feeds.series(_weather(s, d), "minutely_15", ("precipitation",), "event_id").select("event_id", "place", "time", F.coalesce("precipitation", F.lit(0.0)).alias("precipitation")),
    "s7_model_forecasts": lambda s, d: feeds.model_forecasts(_weather(s, d), "event_id"),
    "s8_tides": lambda s, d: feeds.tides(_marine(s, d), "event_id"),
    "s9_gauge_boxes": lambda s, d: feeds.gauge_boxes(_boxes(s, d), *BOX, "event_id"),
    "s10_radar_frames": lambda s, d: feeds.radar_frames(_radar(s, d), "event_id"),
    "s4_geojson_lines": lambda s, d: feeds.geojson_lines(_geojson(s, d), "event_id").select("event_id", "feature", "waterway", _lines(F.col("points")).alias("line")),
    "s5_way_lines": lambda s, d: feeds.way_lines(_elements(s, d)).select("way", _lines(F.col("points")).alias("line")),
}

_E = "WITH e AS (SELECT event_id, event_type, ts, CAST(value AS DOUBLE) AS v, CAST(event_id AS BIGINT) AS n FROM events)"
_T = lambda m: f"strftime(ts + to_minutes({m}), '%Y-%m-%dT%H:%M')"
_L = "CASE WHEN (n + k) % 4 <> 0 THEN CAST((n * 7 + k * 3) % 40 AS DOUBLE) / 10 END"
TIDE_SQL = f"""
l AS (SELECT event_id, k, {_L} AS x FROM e, range(0, 30) AS t(k)),
tides AS (SELECT event_id, CAST(count(x) FILTER (k < 24) AS INT) AS hours, max(x) FILTER (k < 24) AS highest_m, arg_min(x, k) FILTER (x IS NOT NULL) AS tide_m FROM l GROUP BY event_id)"""
_P = "CAST(CAST({} AS DECIMAL(12, 2)) AS VARCHAR)".format
ORACLES = {
    "s6_current_weather": _E + f" SELECT event_id, CASE WHEN event_type <> 'view' THEN {_T(0)} END AS time, CASE WHEN event_type <> 'view' THEN coalesce(v, 0) ELSE CAST(0 AS DOUBLE) END AS rate_mmh, CAST(28.5 AS DOUBLE) AS temperature_c FROM e",
    "s6_quarter_hours": _E + f" SELECT event_id, CAST(k AS INT) AS place, {_T('15 * k')} AS time, coalesce(CASE k WHEN 0 THEN v WHEN 1 THEN v / 2 WHEN 3 THEN v / 4 END, CAST(0 AS DOUBLE)) AS precipitation FROM e, range(0, 4) AS t(k)",
    "s7_model_forecasts": _E + f""" SELECT event_id, model, CAST(k AS INT) AS place, {_T('60 * k')} AS time, CASE WHEN model = 'alpha' THEN v + k WHEN k = 0 THEN v / 2 END AS value
FROM e, range(0, 2) AS t(k), (VALUES ('alpha'), ('beta')) AS m(model)""",
    "s8_tides": _E + f",{TIDE_SQL} SELECT *, coalesce(tide_m > 2.5, false) AS surge FROM tides",
    "s9_gauge_boxes": _E + f""" SELECT event_id, 'b' || n AS station, 'Box ' || n AS name, 'outdoor' AS exposure, CAST(n % 90 AS DOUBLE) AS lon, CAST(n % 80 - 40 AS DOUBLE) AS lat, 's' || n || '-' || k AS sensor, 'Rain' AS title, 'mm' AS unit, event_type AS sensor_type
FROM e, range(1, 4) AS t(k) WHERE k <= 1 + n % 3 AND n % 90 BETWEEN {BOX[0]} AND {BOX[2]} AND n % 80 - 40 BETWEEN {BOX[1]} AND {BOX[3]}""",
    "s10_radar_frames": _E + """, f AS (SELECT event_id, n, 'past' AS kind, k, 0 AS b FROM e, range(0, 3) AS t(k) UNION ALL SELECT event_id, n, 'nowcast', k, 3 FROM e, range(0, 2) AS t(k) WHERE k <= n % 2)
SELECT event_id, kind, CAST(k AS INT) AS place, n * 600 + b + k * 600 AS seconds, 'https://tiles/v2/' || n || '/' || (b + k) AS url, kind = 'past' AND k = 2 AS latest FROM f""",
    "s4_geojson_lines": _E + f" SELECT event_id, 1 AS feature, event_type AS waterway, array_to_string(list_transform(range(0, n % 4 + 1), lambda k: {_P('n % 100 + k')} || ' ' || {_P('n % 50 - k')}), ', ') AS line FROM e WHERE n % 4 >= 1",
    "s5_way_lines": f"""WITH w AS (SELECT p_partkey AS way, unnest([p_partkey, p_partkey * 2, p_partkey * 3, p_partkey + 1]) AS node, unnest([0, 1, 2, 3]) AS place FROM part WHERE p_partkey % 3 = 0),
k AS (SELECT way, place, {_P('CAST(node % 360 AS DOUBLE) / 2')} || ' ' || {_P('CAST(node % 170 AS DOUBLE) / 2')} AS p FROM w JOIN part ON p_partkey = node)
SELECT way, string_agg(p, ', ' ORDER BY place) AS line FROM k GROUP BY way HAVING count(*) >= 2""",
}
