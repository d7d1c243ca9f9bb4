"""Depth frames: statistics, peaks, interpolation between key leads, scenario comparison, placement of points."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.shared import settled, tiled
from rillspark.operators.roads import steady

FRAME = ("scenario_id", "lead_minutes")
# The grid's origin (easting, northing), cell size and rows in the metric projection.
ORIGIN_X, ORIGIN_Y, CELL_M, ROWS = 300000.0, 2500000.0, 30.0, 134


def cell_to_projected(r: Column, c: Column) -> tuple[Column, Column]:
    """Easting and northing of a cell's centre; rows run southwards."""
    return ORIGIN_X + (c + 0.5) * CELL_M, ORIGIN_Y + ROWS * CELL_M - (r + 0.5) * CELL_M


def projected_to_cell(x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column (whole numbers, towards zero) of a point."""
    return ((ORIGIN_Y + ROWS * CELL_M - y) / CELL_M).cast("int"), ((x - ORIGIN_X) / CELL_M).cast("int")


def snapshots(depth: DataFrame, wet_m: float = 0.05) -> DataFrame:
    """Per frame: largest depth, flooded cells and area (deeper than `wet_m`), mean depth and stored volume."""
    area = CELL_M * CELL_M
    return depth.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("cells"), F.max("depth_m").alias("max_depth_m"), F.count_if(F.col("depth_m") > wet_m).alias("flooded_cells"),
        (F.count_if(F.col("depth_m") > wet_m) * area).alias("flooded_area_m2"), steady(F.avg("depth_m")).alias("mean_depth_m"), F.round(F.sum("depth_m") * area + 1e-6, 3).alias("storage_m3"),
    )


def peaks(stats: DataFrame) -> DataFrame:
    """Per scenario: largest depth with the earliest lead that reaches it, and largest area (of any lead)."""
    return stats.groupBy("scenario_id").agg(
        F.max("max_depth_m").alias("peak_depth_m"), F.max_by("lead_minutes", F.struct(F.col("max_depth_m"), -F.col("lead_minutes"))).alias("peak_lead_minutes"), F.max("flooded_area_m2").alias("peak_area_m2")
    )


def interpolated(depth: DataFrame, leads: DataFrame, keys: DataFrame) -> DataFrame:
    """Depth at any lead between key leads, linearly, 4 digits; cells that both key frames hold.

    leads and keys are short lists of lead_minutes; their brackets are one small table, and each cell is joined twice on its key.
    """
    near = leads.crossJoin(F.broadcast(keys.withColumnRenamed("lead_minutes", "k"))).groupBy("lead_minutes").agg(F.max(F.when(F.col("k") <= F.col("lead_minutes"), F.col("k"))).alias("low"), F.min(F.when(F.col("k") >= F.col("lead_minutes"), F.col("k"))).alias("high"))
    low = depth.withColumnRenamed("lead_minutes", "low").withColumnRenamed("depth_m", "a")
    high = depth.withColumnRenamed("lead_minutes", "high").withColumnRenamed("depth_m", "b")
    both = low.join(F.broadcast(near.where("low IS NOT NULL AND high IS NOT NULL")), "low").join(high.hint("merge"), ["scenario_id", "high", "r", "c"])
    alpha = F.when(F.col("high") > F.col("low"), (F.col("lead_minutes") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return both.select(*FRAME, "r", "c", steady(F.greatest(F.lit(0.0), (1.0 - alpha) * F.col("a") + alpha * F.col("b")), 4).alias("depth_m"))


def accepted(depth: DataFrame, leads: int) -> DataFrame:
    """Per scenario: whether all depths are finite and not negative (to 1e-12) and all its leads are there."""
    bad = F.col("depth_m").isNull() | F.isnan("depth_m") | (F.abs("depth_m") == F.lit(float("inf")))
    found = depth.groupBy("scenario_id").agg(F.count_if(bad).alias("not_finite"), F.count_if(F.col("depth_m") < -1e-12).alias("negative"), F.countDistinct("lead_minutes").alias("leads"))
    return found.withColumn("accepted", (F.col("not_finite") == 0) & (F.col("negative") == 0) & (F.col("leads") == leads))


def blends(depth: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of two tables side by side (full outer): matched, or which one lacks them."""
    keys = [*FRAME, "r", "c"]
    both = depth.select(*keys, F.col("depth_m").alias("a")).join(other.select(*keys, F.col("depth_m").alias("b")).hint("merge"), keys, "full")
    return both.groupBy(*FRAME).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


def nearest_nodes(points: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """The nearest node of each point (point_id, x, y) among nodes (node, nx, ny); ties go to the smaller node. Exact.

    Nodes fall into square bins; a point is joined with its own bin and the eight around it, on equal keys. What it finds within
    one bin's width is certainly the nearest; the other points go on with bins of twice the width, until a bin is as wide as all points and nodes
    together: then nothing is out of reach. Points and nodes with a null or NaN coordinate are left out; without nodes there are no rows.
    """
    real = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    left, nodes = points.where(real("x", "y")), nodes.where(real("nx", "ny"))
    both = left.select("x", "y").unionByName(nodes.select(F.col("nx").alias("x"), F.col("ny").alias("y")))
    reach = both.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0.0
    rounds = max(0, math.ceil(math.log2(max(1.0, 2.0 * reach / cell)))) + 1
    found = []
    for k in range(rounds):
        size = cell * 2**k
        binned = nodes.withColumns({"bx": F.floor(F.col("nx") / size), "by": F.floor(F.col("ny") / size)})
        around = F.expr("transform(sequence(0, 8), k -> struct(k div 3 - 1 AS dx, k % 3 - 1 AS dy))")
        asked = left.withColumn("o", F.explode(around)).withColumns({"bx": F.floor(F.col("x") / size) + F.col("o.dx"), "by": F.floor(F.col("y") / size) + F.col("o.dy")})
        near = asked.join(binned.hint("merge"), ["bx", "by"])
        d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
        best = settled(near.groupBy("point_id").agg(F.min(F.struct(d2.alias("d2"), F.col("node"))).alias("b")).where(F.col("b.d2") <= size * size), "near")
        found.append(best.select("point_id", "b.node", F.sqrt("b.d2").alias("distance")))
        left = settled(left.join(best.select("point_id").hint("merge"), "point_id", "left_anti"), "left")
        if left.isEmpty() or (k == 0 and nodes.isEmpty()):
            break
    return reduce(DataFrame.unionByName, found)


def clear_window(cells: DataFrame, size: int, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """The first size x size window without a bad cell, in raster order from the cell `start`, of a dense grid (r, c, bad): its upper left cell, or no row.

    Bad cells are summed along rows, then along columns; each partition is a tile of one line of cells.
    """
    along = lambda line, place: Window.partitionBy(line, "tile").orderBy(place).rangeBetween(0, size - 1)
    n = lambda x, w: F.sum(x).over(w)
    wide = tiled(cells, "c", size - 1).select("r", "c", "own", n(F.col("bad").cast("int"), along("r", "c")).alias("bad"), F.count(F.lit(1)).over(along("r", "c")).alias("n")).where("own").drop("own")
    full = tiled(wide, "r", size - 1).select("r", "c", "own", n("bad", along("c", "r")).alias("bad"), n("n", along("c", "r")).alias("n")).where("own")
    on = (F.col("r") > start[0]) | ((F.col("r") == start[0]) & (F.col("c") >= start[1]))
    return full.where((F.col("bad") == 0) & (F.col("n") == size * size) & on).agg(F.min(F.struct("r", "c")).alias("w")).where("w IS NOT NULL").select("w.*")


def nearest_within(points: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """The nearest node of each point that has one within `most`; other points are left out. Ties go to the smaller node.

    Bins of the width `most`: a point's own bin and the eight around it hold every node in reach, so one equi-join is enough.
    """
    binned = nodes.withColumns({"bx": F.floor(F.col("nx") / most), "by": F.floor(F.col("ny") / most)})
    around = F.expr("transform(sequence(0, 8), k -> struct(k div 3 - 1 AS dx, k % 3 - 1 AS dy))")
    asked = points.withColumn("o", F.explode(around)).withColumns({"bx": F.floor(F.col("x") / most) + F.col("o.dx"), "by": F.floor(F.col("y") / most) + F.col("o.dy")})
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    near = asked.join(binned.hint("merge"), ["bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= most * most)
    best = near.groupBy("point_id").agg(F.min(F.struct("d2", "node")).alias("b"))
    return best.select("point_id", "b.node", F.sqrt("b.d2").alias("distance"))


def scenario_rows(stats: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row a scenario: its peaks, summed balance terms, the highest surcharge and whether there was any."""
    sums = ledger.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("runs"), *(F.round(F.sum(f"{x}_m3") + 1e-6, 3).alias(f"{x}_m3") for x in ("rain", "s2d", "d2s", "outfall")), F.max("max_surcharge_m").alias("max_surcharge_m"))
    return peaks(stats).join(sums.hint("merge"), "scenario_id").withColumn("surcharged", F.col("max_surcharge_m") > 0)
