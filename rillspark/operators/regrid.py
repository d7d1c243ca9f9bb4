"""Fields on geographic axes brought to a grid of cells: positions of cells, brackets on uneven axes, bilinear values.

A bracket is an interval between two neighbours of a sorted axis. Intervals are cut into slots of the axis's mean step, and points are
joined by slot, so that there is neither a product of points and axis nor a search outside Spark: an axis of n values gives at most 2 n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.projection import with_lonlat
from rillspark.functions.shared import settled, small

# Seconds of an hour (for rates in kg/m2/s), and the range of rates.
HOUR, LEAST_MMH, MOST_MMH = 3600.0, 0.0, 300.0


def cell_positions(cells: DataFrame, west: float, north: float, cell_m: float, zone: int) -> DataFrame:
    """`cells` (r, c) with lon and lat of their centres, on a grid of UTM squares whose corner is (west, north)."""
    placed = cells.withColumns({"x": west + (F.col("c") + 0.5) * cell_m, "y": north - (F.col("r") + 0.5) * cell_m})
    return with_lonlat(placed, "x", "y", zone).drop("x", "y")


def brackets(values: DataFrame, axis: DataFrame, value: str, low: str, share: str) -> DataFrame:
    """`values` with `low`, the place of the axis value before, and `share` of the way to the next one (below 0 or above 1 outside the axis).

    axis: place (from 0, without gaps) and at, rising with place. An axis of one value has share 0 everywhere; an empty one gives no rows. Null values are left out.
    """
    # one row of the axis's ends; its window is over a list of axis values, never over points
    ends = axis.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    slot = lambda x: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor((x - F.col("first")) / (F.col("last") - F.col("first")) * F.col("n")))).cast("int")
    slot_of = lambda x: F.when(F.col("n") > 1, slot(x)).otherwise(F.lit(0))
    # neighbours by an equi-join of places, not by a window over the whole axis
    nexts = axis.select((F.col("place") - 1).alias("place"), F.col("at").alias("next"))
    steps = axis.join(nexts.hint("merge"), "place", "left").crossJoin(F.broadcast(ends)).where((F.col("n") == 1) | F.col("next").isNotNull())
    spans = steps.select("place", "at", "next", (F.col("place") == 0).alias("open_low"), (F.col("place") >= F.col("n") - 2).alias("open_high"), F.explode(F.sequence(slot_of(F.col("at")), slot_of(F.coalesce("next", "at")))).alias("slot"))
    spread = values.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("slot", slot_of(F.col(value))).drop("first", "last", "n")
    inside = (F.col("open_low") | (F.col(value) >= F.col("at"))) & (F.col("open_high") | (F.col(value) < F.col("next")))
    found = spread.join(spans.hint("shuffle_hash"), "slot").where(inside)
    return found.withColumns({low: F.col("place"), share: F.when(F.col("next").isNull(), 0.0).otherwise((F.col(value) - F.col("at")) / (F.col("next") - F.col("at")))}).drop("slot", "place", "at", "next", "open_low", "open_high")


def axis_of(field: DataFrame, column: str) -> DataFrame:
    """The distinct values of a coordinate, numbered from 0: place, at. One window over an axis (not over a field)."""
    distinct = field.select(F.col(column).alias("at")).where("at IS NOT NULL").distinct()
    return settled(distinct.select((F.row_number().over(Window.orderBy("at")) - 1).alias("place"), "at"), "axis")


def on_cells(field: DataFrame, cells: DataFrame, per_second: bool = False) -> DataFrame:
    """Rates of every frame at every cell: bilinear between the axes' values, linear beyond them, within 0 to 300 mm/h.

    field: frame, lat, lon, rate; cells: r, c, lon, lat. A rate that is missing, null, NaN or infinite counts as 0. Rates in kg/m2/s (`per_second`) become mm/h.
    """
    lats, lons = axis_of(field, "lat"), axis_of(field, "lon")
    placed = brackets(brackets(cells.select("r", "c", "lon", "lat"), lats, "lat", "i", "fi"), lons, "lon", "j", "fj")
    parts = F.array(*(F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), ((F.col("fi") if di else 1 - F.col("fi")) * (F.col("fj") if dj else 1 - F.col("fj"))).alias("k")) for di in (0, 1) for dj in (0, 1)))
    corners = placed.select("r", "c", F.explode(parts).alias("p")).select("r", "c", "p.*")
    known = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x)
    numbered = field.join(lats.select(F.col("at").alias("lat"), F.col("place").alias("i")).hint("merge"), "lat").join(lons.select(F.col("at").alias("lon"), F.col("place").alias("j")).hint("merge"), "lon")
    source = numbered.select("frame", "i", "j", (known(F.col("rate")) * (HOUR if per_second else 1.0)).alias("rate"))
    found = corners.join(source.hint("merge"), ["i", "j"]).groupBy("frame", "r", "c").agg(F.sum(F.col("k") * F.col("rate")).alias("rate"))
    # a frame without any of the four corners still has its cells, at 0
    every = cells.select("r", "c").crossJoin(small(field.select("frame").distinct()))
    return every.join(found.hint("merge"), ["frame", "r", "c"], "left").select("frame", "r", "c", F.greatest(F.lit(LEAST_MMH), F.least(F.lit(MOST_MMH), F.coalesce("rate", F.lit(0.0)))).alias("rate_mmh"))
