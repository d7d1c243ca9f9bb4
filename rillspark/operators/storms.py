"""Design storms and rain depth formulas as columns and grouped jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.roads import steady

# Published durations in hours with intensities (mm/h) of 2 and 100 years.
IDF = ((1.0, 45.05, 105.20), (2.0, 28.40, 66.27), (6.0, 18.05, 45.24), (12.0, 12.15, 28.70), (24.0, 7.90, 18.22), (48.0, 5.30, 12.03))


def kothyari_garde(c: Column, rain_24h: Column, years: Column, hours: Column) -> Column:
    """Intensity (mm/h) from the 24-hour rain of two years."""
    return c * F.pow(rain_24h, F.lit(0.33)) * F.pow(years, F.lit(0.20)) / F.pow(hours, F.lit(0.71))


def sherman(k: Column, m: Column, d: Column, n: Column, years: Column, minutes: Column) -> Column:
    return k * F.pow(years, m) / F.pow(minutes + d, n)


def short_duration_depth(depth_24h: Column, hours: Column) -> Column:
    return depth_24h * F.pow(hours / 24.0, F.lit(0.45))


def published_depths(requests: DataFrame) -> DataFrame:
    """Depth (mm) and intensity for each (hours, years >= 2) by the published table: growth with years by node, log-log between nodes.

    Outside of the nodes the intensity of the nearest one holds. The nodes are six rows, so they are columns of literals.
    """
    node = lambda k: F.lit(IDF[k][1]) * F.pow(F.col("years") / 2.0, F.ln(F.lit(IDF[k][2] / IDF[k][1])) / F.ln(F.lit(50.0))) * IDF[k][0]
    h = F.col("hours")
    depth = F.when(h <= IDF[0][0], node(0) / IDF[0][0] * h)
    for k in range(len(IDF) - 1):
        share = (F.ln(h) - F.ln(F.lit(IDF[k][0]))) / (F.ln(F.lit(IDF[k + 1][0])) - F.ln(F.lit(IDF[k][0])))
        depth = depth.when(h <= IDF[k + 1][0], F.exp(F.ln(node(k)) + (F.ln(node(k + 1)) - F.ln(node(k))) * share))
    depth = depth.otherwise(node(len(IDF) - 1) / IDF[-1][0] * h)
    return requests.where((h > 0) & (F.col("years") >= 2)).withColumn("d", depth).select(*requests.columns, steady(F.col("d")).alias("depth_mm"), steady(F.col("d") / h).alias("intensity_mmh"))


def alternating_blocks(storms: DataFrame, exponent: float = 0.4) -> DataFrame:
    """Hyetographs by alternating blocks: storm_id, slot (from 0), rate_mmh. storms: storm_id, total_mm, n (blocks), minutes (a block).

    The depth-duration curve is a power law, scaled to the total; its increments fall with duration, so the block of rank j goes
    to the middle (j = 0), (j + 1) / 2 to the left of it (odd j) or j / 2 to the right (even j).
    """
    blocks = storms.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    share = lambda k: F.pow(k / F.col("n"), F.lit(exponent))
    depth = F.col("total_mm") * (share(F.col("k")) - F.when(F.col("k") > 1, share(F.col("k") - 1)).otherwise(0.0))
    j, mid = F.col("k") - 1, F.expr("n div 2")
    slot = F.when(j == 0, mid).when(j % 2 == 1, mid - (j + 1) / 2).otherwise(mid + j / 2)
    return blocks.select("storm_id", slot.cast("int").alias("slot"), steady(depth / (F.col("minutes") / 60.0)).alias("rate_mmh"))


def blocks_around_peak(storms: DataFrame, exponent: float = 0.4) -> DataFrame:
    """The other variant of alternating blocks: storm_id, slot, rate_mmh (2 digits).

    Increments in descending order go to the middle and on to the left (even ranks, from 0), and to the right of the middle (odd ranks); an increment whose side is
    full is lost, and slots without one are 0. So the total can be smaller than the storm's.
    """
    blocks = storms.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = lambda k: F.pow(k / F.col("n"), F.lit(exponent))
    depth = F.col("total_mm") * (share(F.col("k") + 1) - F.when(F.col("k") > 0, share(F.col("k"))).otherwise(0.0))
    mid = F.expr("n div 2")
    slot = F.when(F.col("k") % 2 == 0, mid - F.expr("k div 2")).otherwise(mid + 1 + F.expr("(k - 1) div 2")).cast("int")
    placed = blocks.select("storm_id", "n", "k", slot.alias("slot"), F.round(depth * 60.0 / F.col("minutes") + 1e-9, 2).alias("rate_mmh")).where("slot >= 0 AND slot < n")
    every = storms.select("storm_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("slot"))
    return every.join(placed.select("storm_id", "slot", "rate_mmh").hint("merge"), ["storm_id", "slot"], "left").fillna(0.0, ["rate_mmh"])


def chicago(storms: DataFrame, peak_share: float = 0.35) -> DataFrame:
    """Chicago storms: storm_id, slot, rate_mmh (2 digits), scaled to the total. storms: storm_id, total_mm, n, minutes."""
    slots = storms.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    away = F.abs((F.col("slot") + 0.5) * F.col("minutes") - F.col("n") * F.col("minutes") * peak_share)
    shaped = slots.withColumn("i", F.round(F.col("total_mm") * 1.5 / F.pow(away + 10.0, F.lit(0.75)) + 1e-9, 2))
    total = F.sum("i").over(Window.partitionBy("storm_id")) * (F.col("minutes") / 60.0)
    return shaped.select("storm_id", "slot", F.round(F.col("i") * (F.col("total_mm") / F.greatest(total, F.lit(1e-3))) + 1e-9, 2).alias("rate_mmh"))


def excess(rates: DataFrame, store_mm: float = 2.0, f0: float = 25.0, fmin: float = 2.0, decay: float = 1.0 / 1800) -> DataFrame:
    """Rain excess by storm and slot: a small store fills first, then infiltration takes what Horton's capacity allows.

    rates: storm_id, slot, rate_mmh, minutes. The store's filling is a running sum; no row needs its neighbour's result.
    """
    w = Window.partitionBy("storm_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rain = rates.withColumn("mm", F.col("rate_mmh") * F.col("minutes") / 60.0)
    summed = rain.withColumn("total", F.sum("mm").over(w))
    after_store = F.greatest(F.lit(0.0), F.col("total") - store_mm) - F.greatest(F.lit(0.0), F.col("total") - F.col("mm") - store_mm)
    capacity = (fmin + (f0 - fmin) * F.exp(-decay * F.col("slot") * F.col("minutes") * 60.0)) * F.col("minutes") / 60.0
    return summed.withColumn("left", after_store).select("storm_id", "slot", steady(F.col("left")).alias("surface_mm"), steady(F.greatest(F.lit(0.0), F.col("left") - capacity)).alias("excess_mm"))


def ponded(rates: DataFrame, store_mm: float = 2.0, f0: float = 25.0, fmin: float = 2.0, decay: float = 1.0 / 1800) -> DataFrame:
    """Water that stands by storm and slot when nothing flows off: rain beyond a small store is added, and infiltration takes what there is, of this slot and the ones before.

    rates: storm_id, slot, rate_mmh, minutes (a slot). Horton's capacity falls with the time that it has rained so far (this slot included). What stands after slot t is
    max(0, what stood + added - capacity), which is S(t) - min(0, least S so far) for the running sum S of added - capacity: two windows, no step by step.
    """
    w = Window.partitionBy("storm_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rain = rates.withColumn("mm", F.col("rate_mmh") * F.col("minutes") / 60.0)
    summed = rain.withColumns({"total": F.sum("mm").over(w), "wet": F.sum(F.when(F.col("rate_mmh") > 0, F.col("minutes")).otherwise(0)).over(w)})
    added = F.greatest(F.lit(0.0), F.col("total") - store_mm) - F.greatest(F.lit(0.0), F.col("total") - F.col("mm") - store_mm)
    capacity = (fmin + (f0 - fmin) * F.exp(-decay * F.col("wet") * 60.0)) * F.col("minutes") / 60.0
    walk = summed.withColumns({"added": added, "capacity": capacity}).withColumn("s", F.sum(F.col("added") - F.col("capacity")).over(w))
    stands = walk.withColumn("stands", F.greatest(F.lit(0.0), F.col("s") - F.least(F.lit(0.0), F.min("s").over(w))))
    before = F.coalesce(F.lag("stands").over(Window.partitionBy("storm_id").orderBy("slot")), F.lit(0.0))
    return stands.select("storm_id", "slot", steady(F.col("added")).alias("surface_mm"), steady(before + F.col("added") - F.col("stands")).alias("infiltrated_mm"), steady(F.col("stands")).alias("ponded_mm"))
