"""Interventions on depth grids: layered abatement, effects, costs and the best package for a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.functions.shared import settled
from rillspark.operators.roads import steady

FRAME = ("scenario_id", "lead_minutes")
CELL_M2 = 900.0

# Rates in rupees.
COSTS = {"permeable_m2": 1800.0, "impervious_area_m2": 100000.0, "basin_m3": 450.0, "pump_m3s": 2500000.0, "desilting": 1500000.0}
DAMAGES = {"area_m2": 1200.0, "volume_m3": 180.0, "road": 2500000.0, "asset": 5000000.0}


def abated(depth: DataFrame, packages: DataFrame, unblocked: DataFrame | None = None) -> DataFrame:
    """Depth of every cell under every package: relief of the blocked culvert, permeable surfaces, basins and pumps, in that order.

    Each layer acts on what the one before leaves. Basins share their volume among cells of 15 cm or more, pumps among cells of
    10 cm or more, so each needs a count per frame and package: an aggregate of a row each, joined back.
    packages: package, lid, basin_m3, pump_m3s, unblock. unblocked: scenario_id, lead_minutes, r, c, clean_depth_m of frames that
    have a counterpart without blockage; other frames have no such relief.
    """
    depth = settled(depth.select(*FRAME, "r", "c", "depth_m"), "depth")  # read for each layer's count and for the cells
    base = depth.select(*FRAME, "r", "c", F.col("depth_m").alias("base_m")).crossJoin(F.broadcast(packages))
    if unblocked is None:
        base = base.withColumn("d", F.col("base_m"))
    else:
        base = base.join(unblocked.hint("merge"), [*FRAME, "r", "c"], "left")
        relief = F.greatest(F.lit(0.0), F.col("base_m") - F.col("clean_depth_m")) + F.when(F.col("base_m") > 0.20, F.least(F.col("base_m"), F.lit(0.08))).otherwise(0.0)
        base = base.withColumn("d", F.when(F.col("unblock") & F.col("clean_depth_m").isNotNull(), F.greatest(F.lit(0.0), F.col("base_m") - relief)).otherwise(F.col("base_m"))).drop("clean_depth_m")
    base = base.withColumn("d", F.greatest(F.lit(0.0), F.col("d") - F.least(F.col("d"), 0.0125 * F.col("lid"))))

    def shared(df: DataFrame, least: float, volume: F.Column) -> DataFrame:
        deep = df.groupBy(*FRAME, "package").agg(F.count_if(F.col("d") >= least).alias("n_deep"))
        each = volume / (F.col("n_deep") * CELL_M2)
        lowered = F.when((F.col("d") >= least) & (volume > 0), F.greatest(F.lit(0.0), F.col("d") - F.least(F.col("d"), each))).otherwise(F.col("d"))
        return df.join(deep.hint("merge"), [*FRAME, "package"]).withColumn("d", lowered).drop("n_deep")

    done = shared(shared(base, 0.15, F.col("basin_m3")), 0.10, F.col("pump_m3s") * 1800.0)
    return done.select(*FRAME, "package", "r", "c", "base_m", F.col("d").alias("depth_m"))


def effects(grids: DataFrame, roads: DataFrame) -> DataFrame:
    """Per frame and package: largest depth, area (>= 5 cm) and volume before and after, reductions, reopened roads and the index.

    roads: scenario_id, lead_minutes, package, before_m, after_m (largest depth on the road), roads (how many roads a row stands for).
    """
    sums = grids.groupBy(*FRAME, "package").agg(
        F.max("base_m").alias("d0"), F.max("depth_m").alias("d1"), (F.count_if(F.col("base_m") >= 0.05) * CELL_M2).alias("a0"), (F.count_if(F.col("depth_m") >= 0.05) * CELL_M2).alias("a1"),
        (F.sum("base_m") * CELL_M2).alias("v0"), (F.sum("depth_m") * CELL_M2).alias("v1"),
    )
    of = lambda met: F.coalesce(F.sum(F.when(met, F.col("roads"))), F.lit(0))
    shut = roads.groupBy(*FRAME, "package").agg(of(F.col("before_m") > 0.5).alias("impassable_before"), of((F.col("before_m") > 0.5) & ~(F.col("after_m") > 0.5)).alias("reopened_roads"))
    both = sums.join(shut.hint("merge"), [*FRAME, "package"], "left").fillna(0, ["impassable_before", "reopened_roads"])
    less = lambda x: F.greatest(F.lit(0.0), F.col(f"{x}0") - F.col(f"{x}1"))
    part = lambda x: F.when(F.col(f"{x}0") > 0, F.least(F.lit(1.0), less(x) / F.col(f"{x}0"))).otherwise(0.0)
    road_part = F.when(F.col("impassable_before") > 0, F.col("reopened_roads") / F.col("impassable_before")).otherwise(1.0)
    return both.select(
        *FRAME, "package", steady(less("d"), 3).alias("depth_reduction_m"), steady(part("d") * 100, 1).alias("depth_reduction_pct"), steady(less("a"), 1).alias("area_reduction_m2"),
        steady(part("a") * 100, 1).alias("area_reduction_pct"), F.round(less("v") + 1e-6, 1).alias("volume_reduction_m3"), "impassable_before", "reopened_roads",
        steady(0.4 * part("d") + 0.4 * part("a") + 0.2 * road_part, 4).alias("effectiveness_index"),
    )


def priced(found: DataFrame, packages: DataFrame) -> DataFrame:
    """Effects with capital cost, avoided losses (rupees, and crores to 3 digits) and their ratio."""
    cost = F.col("lid") * COSTS["impervious_area_m2"] * COSTS["permeable_m2"] + F.col("basin_m3") * COSTS["basin_m3"] + F.col("pump_m3s") * COSTS["pump_m3s"] + F.when(F.col("unblock"), COSTS["desilting"]).otherwise(0.0)
    gain = F.col("area_reduction_m2") * DAMAGES["area_m2"] + F.col("volume_reduction_m3") * DAMAGES["volume_m3"] + F.col("reopened_roads") * DAMAGES["road"]
    both = found.join(F.broadcast(packages), "package").withColumns({"cost": cost, "gain": gain})
    return both.select(
        *found.columns, steady(F.col("cost"), 2).alias("capex_inr"), steady(F.col("cost") / 1e7, 3).alias("capex_crores"), steady(F.col("gain"), 2).alias("avoided_losses_inr"),
        steady(F.when(F.col("cost") > 0, F.col("gain") / F.col("cost")).otherwise(0.0), 4).alias("benefit_cost_ratio"),
    )


def best_within(packages: DataFrame, budget_crores: float) -> DataFrame:
    """Per frame: the package of best ratio (then index, then name) within a budget; NO_FEASIBLE_PACKAGE if none fits."""
    fits = F.col("capex_crores") <= budget_crores
    best = F.max_by("package", F.when(fits, F.struct("benefit_cost_ratio", "effectiveness_index", "package")))
    return packages.groupBy(*FRAME).agg(F.coalesce(best, F.lit("NO_FEASIBLE_PACKAGE")).alias("package"), F.count_if(fits).alias("feasible"))
