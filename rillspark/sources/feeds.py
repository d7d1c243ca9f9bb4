"""Flat tables of nested feeds: weather, models, tides, gauges, radar frames, GeoJSON and map elements.

Every function takes a table with a JSON text column, one document a row, and keeps the other columns named in `keys`. A
text that does not parse gives no rows (scan functions) or nulls (one-row functions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a missing current reading counts as, and the highest tide in metres without a surge.
NO_RAIN, USUAL_TEMPERATURE, SURGE_M = 0.0, 28.5, 2.5
HOURS = 24


def current_weather(docs: DataFrame, *keys: str, text: str = "feed") -> DataFrame:
    """The current rate and temperature of each document, with defaults for what is missing."""
    now = F.from_json(text, "current STRUCT<time STRING, precipitation DOUBLE, temperature_2m DOUBLE>")["current"]
    return docs.select(*keys, now["time"].alias("time"), F.coalesce(now["precipitation"], F.lit(NO_RAIN)).alias("rate_mmh"), F.coalesce(now["temperature_2m"], F.lit(USUAL_TEMPERATURE)).alias("temperature_c"))


def series(docs: DataFrame, group: str, columns: tuple[str, ...], *keys: str, text: str = "feed") -> DataFrame:
    """The parallel arrays of a group (time and `columns`) as rows, with their place; a shorter array counts as null at its end."""
    arrays = ", ".join(f"`{c}`: ARRAY<DOUBLE>" for c in columns)
    found = docs.select(*keys, F.from_json(text, f"`{group}` STRUCT<`time`: ARRAY<STRING>, {arrays}>")[group].alias("g"))
    zipped = F.arrays_zip("g.time", *(F.coalesce(F.col("g")[c], F.array().cast("array<double>")).alias(c) for c in columns))
    rows = found.where("g.time IS NOT NULL").select(*keys, F.posexplode(zipped).alias("place", "z"))
    return rows.select(*keys, "place", F.col("z")["time"].alias("time"), *(F.col("z")[c].alias(c) for c in columns)).where("time IS NOT NULL")


def model_forecasts(docs: DataFrame, *keys: str, prefix: str = "precipitation_", text: str = "feed") -> DataFrame:
    """The hourly columns `<prefix><model>` as rows of (model, time, value); the models need not be known before."""
    found = docs.select(*keys, F.from_json(text, "hourly MAP<STRING, ARRAY<STRING>>")["hourly"].alias("h"))
    named = found.select(*keys, F.col("h")["time"].alias("times"), F.explode("h").alias("name", "values")).where(F.col("name").startswith(prefix))
    rows = named.select(*keys, F.substring("name", len(prefix) + 1, 1000).alias("model"), F.posexplode(F.arrays_zip("times", "values")).alias("place", "z"))
    return rows.select(*keys, "model", "place", F.col("z")["times"].alias("time"), F.col("z")["values"].cast("double").alias("value"))


def tides(docs: DataFrame, *keys: str, text: str = "feed") -> DataFrame:
    """Of the first day: hours given, highest level; of all: the first level that is given as the current tide, and whether it is a surge."""
    level = F.from_json(text, "hourly STRUCT<sea_level_height_msl ARRAY<DOUBLE>>")["hourly"]["sea_level_height_msl"]
    found = docs.select(*keys, level.alias("v")).withColumn("day", F.slice("v", 1, HOURS))
    tide = F.get(F.filter("v", lambda x: x.isNotNull()), F.lit(0))
    return found.select(*keys, F.size(F.filter("day", lambda x: x.isNotNull())).alias("hours"), F.array_max("day").alias("highest_m"), tide.alias("tide_m"), F.coalesce(tide > SURGE_M, F.lit(False)).alias("surge"))


def rivers(docs: DataFrame, *keys: str, text: str = "feed") -> DataFrame:
    """Daily discharge of each river feed: days given, the first value as the current one (0 without any), the largest, and its mean where the feed has it."""
    daily = F.from_json(text, "daily STRUCT<`time`: ARRAY<STRING>, river_discharge: ARRAY<DOUBLE>, river_discharge_mean: ARRAY<DOUBLE>>")["daily"]
    found = docs.select(*keys, daily["river_discharge"].alias("v"), daily["river_discharge_mean"].alias("m"))
    days = F.coalesce(F.size(F.filter("v", lambda x: x.isNotNull())), F.lit(0))
    return found.select(*keys, F.greatest(days, F.lit(0)).alias("days"), F.coalesce(F.get("v", F.lit(0)), F.lit(0.0)).alias("discharge_cms"), F.array_max("v").alias("highest_cms"), F.get("m", F.lit(0)).alias("mean_cms"))


def gauge_boxes(docs: DataFrame, west: float, south: float, east: float, north: float, *keys: str, text: str = "feed") -> DataFrame:
    """A row for each sensor of every station inside a box of longitude and latitude; a station without sensors has one row of nulls."""
    kind = "_id STRING, name STRING, exposure STRING, currentLocation STRUCT<coordinates ARRAY<DOUBLE>>, sensors ARRAY<STRUCT<_id STRING, title STRING, unit STRING, sensorType STRING>>"
    box = docs.select(*keys, F.from_json(text, kind).alias("b")).select(*keys, F.col("b._id").alias("station"), "b.name", "b.exposure", F.col("b.currentLocation.coordinates")[0].alias("lon"), F.col("b.currentLocation.coordinates")[1].alias("lat"), "b.sensors")
    inside = box.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return inside.select("*", F.explode_outer("sensors").alias("s")).select(*keys, "station", "name", "exposure", "lon", "lat", F.col("s._id").alias("sensor"), F.col("s.title").alias("title"), F.col("s.unit").alias("unit"), F.col("s.sensorType").alias("sensor_type"))


def radar_frames(docs: DataFrame, *keys: str, text: str = "feed") -> DataFrame:
    """A row for each past and forecast frame: its kind, place, time, path and whether it is the latest past one."""
    frames = "ARRAY<STRUCT<`time`: LONG, path: STRING>>"
    index = docs.select(*keys, F.from_json(text, f"host STRING, radar STRUCT<past: {frames}, nowcast: {frames}>").alias("i")).select(*keys, "i.host", "i.radar.past", "i.radar.nowcast")
    of = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(frames)), lambda x, k: F.struct(F.lit(c).alias("kind"), k.alias("place"), x["time"].alias("seconds"), x["path"].alias("path"), F.lit(c == "past").alias("p")))
    rows = index.withColumn("n_past", F.coalesce(F.size("past"), F.lit(0))).select(*keys, "host", "n_past", F.explode(F.concat(of("past"), of("nowcast"))).alias("f"))
    return rows.select(*keys, "f.kind", "f.place", "f.seconds", F.concat("host", "f.path").alias("url"), (F.col("f.p") & (F.col("f.place") == F.col("n_past") - 1)).alias("latest"))


def geojson_lines(docs: DataFrame, *keys: str, text: str = "feed", properties: tuple[str, ...] = ("waterway",)) -> DataFrame:
    """The LineString features of at least two points: place among all features, points as (x, y) arrays, and some properties."""
    fields = ", ".join(f"`{p}`: STRING" for p in properties)
    kind = f"features ARRAY<STRUCT<geometry: STRUCT<`type`: STRING, coordinates: STRING>, properties: STRUCT<{fields}>>>"
    rows = docs.select(*keys, F.posexplode(F.from_json(text, kind)["features"]).alias("feature", "f"))
    lines = rows.where("f.geometry.type = 'LineString'").withColumn("points", F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<DOUBLE>>"))
    return lines.where(F.size("points") >= 2).select(*keys, "feature", "points", *(F.col("f")["properties"][p].alias(p) for p in properties))


def way_lines(elements: DataFrame) -> DataFrame:
    """Map ways with their points in order; unknown nodes are left out, and ways of fewer than two known ones.

    elements: type (node or way), id, lon, lat, nodes (ids). Nodes are joined by id, so a way's nodes may stand anywhere in the table;
    a way's points are put together per way only.
    """
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    steps = elements.where("type = 'way'").select(F.col("id").alias("way"), F.posexplode("nodes").alias("place", "node"))
    known = steps.join(nodes.hint("merge"), "node")
    points: Column = F.transform(F.array_sort(F.collect_list(F.struct("place", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    return known.groupBy("way").agg(points.alias("points")).where(F.size("points") >= 2)
