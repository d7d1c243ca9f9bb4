"""Wards, volumes, way-points, resampled series and comparability of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.policy import impact_class
from rillspark.functions.shared import small
from rillspark.operators.roads import steady

FRAME = ("scenario_id", "lead_minutes")


def rainfall_volume(rates: DataFrame, *by: str, cell_m2: float = 900.0, seconds: float = 900.0) -> DataFrame:
    """Volume (m3) of rain rates in mm/h over cells and one interval."""
    return rates.groupBy(*by).agg(F.round(F.sum("rate_mmh") / 3.6e6 * cell_m2 * seconds + 1e-6, 3).alias("volume_m3"), F.count(F.lit(1)).alias("cells"))


def ward_summary(depth: DataFrame, road_cells: DataFrame, assets: DataFrame, side: int = 10, cell_m: float = 30.0) -> DataFrame:
    """Per frame and ward (square of `side` cells): wet and severe area, depths, wet road length (a cell's side each) and flooded assets.

    Roads and assets are counted on cells first, so that a ward's rows are summed once, before the shuffle to wards.
    road_cells: road_id, r, c, and roads (how many a row stands for) if they are lines that roads share.
    """
    counted = F.sum("roads") if "roads" in road_cells.columns else F.countDistinct("road_id")
    each = road_cells.select("road_id", "r", "c", "roads").distinct() if "roads" in road_cells.columns else road_cells
    roads = each.groupBy("r", "c").agg(counted.alias("roads"))
    sites = assets.groupBy("r", "c").agg(F.count(F.lit(1)).alias("sites"))
    cells = depth.join(roads.hint("merge"), ["r", "c"], "left").join(sites.hint("merge"), ["r", "c"], "left")
    wet, severe = F.col("depth_m") > 0.05, F.col("depth_m") > 0.30
    return cells.groupBy(*FRAME, F.expr(f"CAST(r div {side} AS INT)").alias("ward_r"), F.expr(f"CAST(c div {side} AS INT)").alias("ward_c")).agg(
        (F.count_if(wet) * cell_m * cell_m).alias("wet_area_m2"), (F.count_if(severe) * cell_m * cell_m).alias("severe_area_m2"), F.max("depth_m").alias("max_depth_m"), steady(F.avg("depth_m")).alias("mean_depth_m"),
        (F.coalesce(F.sum(F.when(wet, F.col("roads"))), F.lit(0)) * cell_m).alias("wet_road_m"), F.coalesce(F.sum(F.when(severe, F.col("sites"))), F.lit(0)).alias("flooded_assets"),
    )


def polyline_lengths(points: DataFrame, floor_m: float = 10.0) -> DataFrame:
    """Length of each feature's line through its points in order of i, at least `floor_m`. points: feature, i, x, y."""
    w = Window.partitionBy("feature").orderBy("i")
    step = points.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)})
    return step.groupBy("feature").agg(F.count(F.lit(1)).alias("points"), steady(F.greatest(F.lit(floor_m), F.coalesce(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), F.lit(0.0)))).alias("length_m"))


def resampled(series: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """Each series (key, t, v) at other times, linearly between its neighbours, held at its ends.

    Both are sorted together once per series; the neighbours are the last and next known values of a window.
    """
    asked = series.select(key).distinct().crossJoin(small(times)).select(key, "t", F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked"))
    both = series.select(key, "t", "v", F.lit(False).alias("asked")).unionByName(asked)
    known = F.when(~F.col("asked"), F.struct("t", "v"))
    back = Window.partitionBy(key).orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("t", F.desc("asked")).rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumns({"a": F.last(known, ignorenulls=True).over(back), "b": F.first(known, ignorenulls=True).over(ahead)}).where("asked")
    a, b = F.col("a"), F.col("b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"])
    value = F.when(F.col("a").isNull(), b["v"]).when(F.col("b").isNull() | (b["t"] == a["t"]), a["v"]).otherwise(line)
    return near.select(key, "t", steady(value).alias("v"))


def controls(summaries: DataFrame, *columns: str) -> DataFrame:
    """For each controlled column, its distinct values over all scenarios and whether they are all equal."""
    long = summaries.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "control", "value")
    return long.groupBy("control").agg(F.count_distinct("value").alias("distinct_values"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values_seen")).withColumn("all_equal", F.col("distinct_values") <= 1)


def waypoint_hazard(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every way-point for every profile: depth times speed of the water, whether it is blocked, and where the path goes instead.

    points: x, y, i (place in the path), depth_m, velocity_ms; profiles: profile, max_depth_m, max_dv. Blocked is beyond either limit;
    a blocked way-point moves by 20 m and 80 m for each metre of depth beyond the limit (and by half of that along y), at
    even places forwards, at odd ones back.
    """
    every = points.crossJoin(F.broadcast(profiles))
    dv = F.col("depth_m") * F.col("velocity_ms")
    blocked = (F.col("depth_m") > F.col("max_depth_m")) | (dv > F.col("max_dv"))
    move = F.when(blocked, ((F.col("depth_m") - F.col("max_depth_m")) * 80.0 + 20.0) * F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    return every.select(*points.columns, "profile", steady(dv).alias("hazard_dv"), blocked.alias("blocked"), steady(F.col("x") + move).alias("x_out"), steady(F.col("y") + move * 0.5).alias("y_out"), impact_class(F.col("depth_m")).alias("class"))
