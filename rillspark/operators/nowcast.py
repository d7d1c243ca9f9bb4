"""Rain nowcasts on dense frames: gradients, motion, semi-Lagrangian advection, persistence and blending.

Frames are tables (frame, r, c, rate_mmh). Windows run along one tile of a row or a column of a frame, so a partition holds a few
cells, however large frames are; gathers are equi-joins on cells.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.shared import tiled

#: Decay time of advected rain in minutes, and the longest lead that is blended with radar.
DECAY_MINUTES = 180.0
#: What keeps the determinant of a window without structure from zero.
FLOW_FLOOR = 1e-5


def gradients(frames: DataFrame, value: str = "rate_mmh") -> DataFrame:
    """Per cell gx (along columns) and gy (along rows): central differences, one-sided at the edges."""

    def along(cells: DataFrame, line: str, place: str, name: str) -> DataFrame:
        w = Window.partitionBy("frame", line, "tile").orderBy(place)
        v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        slope = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2.0)
        return tiled(cells, place, 1).withColumn(name, slope).where("own").drop("tile", "own")

    return along(along(frames, "r", "c", "gx"), "c", "r", "gy")


def centroids(frames: DataFrame, value: str = "rate_mmh") -> DataFrame:
    """Per frame: mass and mass-weighted centre."""
    mass = F.sum(value)
    return frames.groupBy("frame").agg(mass.alias("mass"), (F.sum(F.col("c") * F.col(value)) / mass).alias("cx"), (F.sum(F.col("r") * F.col(value)) / mass).alias("cy"))


def storm_motion(frames: DataFrame, before: int, after: int, cell_m: float = 30.0, seconds: float = 900.0) -> DataFrame:
    """One row: velocity (u along columns, v along rows) of the storm's centre in m/s; (3, 2) if either frame is dry."""
    at = centroids(frames)
    a, b = at.where(F.col("frame") == before).alias("a"), at.where(F.col("frame") == after).alias("b")
    wet = (F.col("a.mass") > 1.0) & (F.col("b.mass") > 1.0)
    speed = lambda x: (F.col(f"b.{x}") - F.col(f"a.{x}")) * cell_m / max(seconds, 1.0)
    return a.crossJoin(b).select(F.when(wet, speed("cx")).otherwise(3.0).alias("u_mps"), F.when(wet, speed("cy")).otherwise(2.0).alias("v_mps"))


def motion_field(frames: DataFrame, before: int, after: int, cell_m: float = 30.0, seconds: float = 900.0) -> DataFrame:
    """Per cell of the later frame: local flow (regularised by 1), blended with the storm's motion by gradient, within +-50 m/s."""
    steep = gradients(frames.where(F.col("frame") == after))
    past = frames.where(F.col("frame") == before).select("r", "c", F.col("rate_mmh").alias("past"))
    both = steep.join(past.hint("merge"), ["r", "c"]).crossJoin(F.broadcast(storm_motion(frames, before, after, cell_m, seconds)))  # the right side is one row
    g2 = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    weight = g2 / (g2 + 0.1)

    def blended(g: str, overall: str) -> Column:
        local = -(F.col(g) * (F.col("rate_mmh") - F.col("past"))) / (g2 + 1.0) * cell_m / max(seconds, 1.0)
        return F.greatest(F.lit(-50.0), F.least(F.lit(50.0), weight * local + (1.0 - weight) * F.col(overall)))

    return both.select("r", "c", "rate_mmh", blended("gx", "u_mps").alias("u"), blended("gy", "v_mps").alias("v"))


def windowed_flow(frames: DataFrame, before: int, after: int, window: int = 5) -> DataFrame:
    """Per cell of the later frame: flow u (along columns) and v (along rows) in cells a step, from gradients gathered in a window.

    Products of gradients are weighted by a Gaussian of the window's half width and summed over its cells; the flow solves the two
    equations of each cell, with FLOW_FLOOR added to their determinant. The weights are a product of one along rows and one along columns, so there are two
    passes of 2 * half + 1 cells instead of one of their square. Gradients are central; beyond the frame's edge stands the edge's own value. Cells
    nearer than the half width to the edge have no flow (0). Cells of a dense frame that have no earlier value are left out.
    """
    half = max(1, window // 2)
    weights = [math.exp(-(d * d) / (2.0 * half * half)) for d in range(-half, half + 1)]
    size = frames.where(F.col("frame") == after).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))  # one row
    past = frames.where(F.col("frame") == before).select("r", "c", F.col("rate_mmh").alias("past"))
    cells = frames.where(F.col("frame") == after).select("r", "c", "rate_mmh").join(past.hint("merge"), ["r", "c"]).withColumn("it", F.col("rate_mmh") - F.col("past"))
    products = {"xx": ("ix", "ix"), "yy": ("iy", "iy"), "xy": ("ix", "iy"), "xt": ("ix", "it"), "yt": ("iy", "it")}

    def slope(w) -> Column:
        v = F.col("rate_mmh")
        return (F.coalesce(F.lead(v).over(w), v) - F.coalesce(F.lag(v).over(w), v)) * 0.5

    def gathered(name: str, w) -> Column:
        return sum((F.coalesce(F.lag(name, -d).over(w), F.lit(0.0)) * k for d, k in zip(range(-half, half + 1), weights, strict=True)), F.lit(0.0))

    row, column = Window.partitionBy("r", "tile").orderBy("c"), Window.partitionBy("c", "tile").orderBy("r")
    steep = tiled(cells, "c", 1).withColumn("ix", slope(row)).where("own").select("r", "c", "rate_mmh", "it", "ix")
    both = tiled(steep, "r", half + 1).withColumn("iy", slope(column)).withColumns({n: F.col(a) * F.col(b) for n, (a, b) in products.items()})
    down = both.withColumns({f"{n}_down": gathered(n, column) for n in products}).where("own").select("r", "c", *(F.col(f"{n}_down").alias(n) for n in products))
    all_round = tiled(down, "c", half).withColumns({f"g{n}": gathered(n, row) for n in products}).where("own").crossJoin(F.broadcast(size))
    g = {n: F.col(f"g{n}") for n in products}
    determinant = g["xx"] * g["yy"] - g["xy"] * g["xy"] + FLOW_FLOOR
    inside = F.col("r").between(half, F.col("h") - half - 1) & F.col("c").between(half, F.col("w") - half - 1)
    u, v = -(g["yy"] * g["xt"] - g["xy"] * g["yt"]) / determinant, -(g["xx"] * g["yt"] - g["xy"] * g["xt"]) / determinant
    return all_round.select("r", "c", F.when(inside, u).otherwise(0.0).alias("u"), F.when(inside, v).otherwise(0.0).alias("v"))


def advected(field: DataFrame, leads: DataFrame, cell_m: float = 30.0, decay: float | None = DECAY_MINUTES) -> DataFrame:
    """Rates at every lead: each cell takes the rate at the end of its backward path, bilinearly, decayed; lead 0 is unchanged.

    field: r, c, rate_mmh, u, v of a dense frame with origin (0, 0), a row a cell; leads: lead_minutes. The four corners of a path's end are gathered once for each
    cell, whatever the number of leads, so that a path's end is one row that meets one row. A corner that the frame lacks counts as 0; without any there is no row.
    """
    size = field.agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))  # one row
    paths = field.crossJoin(F.broadcast(leads)).crossJoin(F.broadcast(size))
    t = F.col("lead_minutes") * 60.0
    clip = lambda x, n: F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, x))
    ends = paths.withColumns({"x": clip(F.col("c") - F.col("u") * t / cell_m, "w"), "y": clip(F.col("r") - F.col("v") * t / cell_m, "h")})
    corner = ends.withColumns({"x0": F.floor("x").cast("int"), "y0": F.floor("y").cast("int")})
    wanted = corner.select("lead_minutes", "r", "c", "y0", "x0", (F.col("x") - F.col("x0")).alias("fx"), (F.col("y") - F.col("y0")).alias("fy"))
    near = F.array(*(F.struct((F.col("r") - dy).alias("y0"), (F.col("c") - dx).alias("x0"), F.lit(2 * dy + dx).alias("at")) for dy in (0, 1) for dx in (0, 1)))
    each = field.select(F.explode(near).alias("p"), "rate_mmh").select("p.*", "rate_mmh")
    corners = each.groupBy("y0", "x0").agg(*(F.max(F.when(F.col("at") == k, F.col("rate_mmh"))).alias(f"v{k}") for k in range(4)))
    fx, fy = F.col("fx"), F.col("fy")
    weights = ((1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy)
    # beyond the last line there is no corner, and its weight is 0 there
    rate = reduce(Column.__add__, (F.coalesce(k * F.col(f"v{n}"), F.lit(0.0)) for n, k in enumerate(weights)))
    moved = wanted.join(corners.hint("merge"), ["y0", "x0"]).select("lead_minutes", "r", "c", rate.alias("rate"))
    factor = F.when(F.col("lead_minutes") <= 0, 1.0).otherwise(F.exp(-F.col("lead_minutes") / decay)) if decay else F.lit(1.0)
    return moved.select("lead_minutes", "r", "c", (F.greatest(F.lit(0.0), F.col("rate")) * factor).alias("rate_mmh"))


def persisted(field: DataFrame, leads: DataFrame) -> DataFrame:
    """The same field at every lead."""
    return field.select("r", "c", "rate_mmh").crossJoin(F.broadcast(leads)).select("lead_minutes", "r", "c", "rate_mmh")


def radar_weight(lead: Column) -> Column:
    """Share of radar: 1 to 30 minutes, then falling to 0 at 150 (4 digits)."""
    return F.round(F.when(lead <= 30, 1.0).when(lead >= 150, 0.0).otherwise(1.0 - (lead - 30.0) / 120.0) + 1e-9, 4)


def nearest_step(leads: DataFrame, steps: DataFrame) -> DataFrame:
    """For each lead the nearest forecast step, ties to the smaller. Both sides are short lists of leads."""
    return leads.crossJoin(F.broadcast(steps)).groupBy("lead_minutes").agg(F.min_by("step_minutes", F.struct(F.abs(F.col("lead_minutes") - F.col("step_minutes")), F.col("step_minutes"))).alias("step_minutes"))


def blended(radar: DataFrame, forecast: DataFrame, step_of_lead: DataFrame) -> DataFrame:
    """Radar and forecast mixed by lead, within 0 to 300 mm/h; without a forecast for a cell, radar alone."""
    weighted = radar.join(F.broadcast(step_of_lead), "lead_minutes", "left").withColumn("w_radar", radar_weight(F.col("lead_minutes")))
    other = forecast.select("step_minutes", "r", "c", F.col("rate_mmh").alias("nwp"))
    both = weighted.join(other.hint("merge"), ["step_minutes", "r", "c"], "left")
    mixed = F.when(F.col("nwp").isNull(), F.col("rate_mmh")).otherwise(F.col("w_radar") * F.col("rate_mmh") + (1.0 - F.col("w_radar")) * F.col("nwp"))
    mode = F.when(F.col("nwp").isNull(), "FALLBACK_RADAR_ONLY").when(F.col("w_radar") == 1.0, "RADAR_ONLY").when(F.col("w_radar") == 0.0, "NWP_ONLY").otherwise("BLENDED_LINEAR")
    return both.select("lead_minutes", "r", "c", F.greatest(F.lit(0.0), F.least(F.lit(300.0), mixed)).alias("rate_mmh"), mode.alias("blending_mode"))


def resampled(frames: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every frame on a grid of rows x columns, bilinearly between evenly spread coordinates. Frames need two lines each way."""
    size = frames.groupBy("frame").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))  # a row a frame
    target = size.where("h >= 2 AND w >= 2").withColumn("tr", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("tc", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    at = target.withColumns({"y": F.col("tr") * (F.col("h") - 1.0) / max(rows - 1, 1), "x": F.col("tc") * (F.col("w") - 1.0) / max(columns - 1, 1)})
    base = at.withColumns({"y0": F.least(F.floor("y"), F.col("h") - 2).cast("int"), "x0": F.least(F.floor("x"), F.col("w") - 2).cast("int")}).withColumns({"fy": F.col("y") - F.col("y0"), "fx": F.col("x") - F.col("x0")})
    corners = [(dy, dx, (F.col("fy") if dy else 1 - F.col("fy")) * (F.col("fx") if dx else 1 - F.col("fx"))) for dy in (0, 1) for dx in (0, 1)]
    parts = F.array(*(F.struct((F.col("y0") + dy).alias("r"), (F.col("x0") + dx).alias("c"), k.alias("k")) for dy, dx, k in corners))
    wanted = base.select("frame", "tr", "tc", F.explode(parts).alias("p")).select("frame", "tr", "tc", "p.*")
    found = wanted.join(frames.select("frame", "r", "c", "rate_mmh").hint("merge"), ["frame", "r", "c"]).groupBy("frame", "tr", "tc").agg(F.sum(F.col("k") * F.col("rate_mmh")).alias("rate_mmh"))
    return found.select("frame", F.col("tr").alias("r"), F.col("tc").alias("c"), "rate_mmh")
