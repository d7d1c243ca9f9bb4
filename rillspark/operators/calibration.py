"""Calibration sweeps as data: candidate grids, simulated hydrographs, scoring of all candidates at once, best and history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.operators.roads import steady
from rillspark.operators.scores import hydrograph_fit


def grid(spark: SparkSession, bounds: dict[str, tuple[float, float]], budget: int) -> DataFrame:
    """Candidates on an even grid within bounds: max(2, round(budget ** (1 / d))) steps an axis, the first `budget` of them.

    candidate counts from 0, the last parameter running fastest.
    """
    steps = max(2, round(budget ** (1 / len(bounds))))
    axes = [spark.range(steps).select(F.col("id").alias(f"k_{name}"), (F.lit(low) + (high - low) * F.col("id") / (steps - 1)).alias(name)) for name, (low, high) in bounds.items()]
    every = reduce(DataFrame.crossJoin, axes)
    number = reduce(lambda a, name: a * steps + F.col(f"k_{name}"), bounds, F.lit(0))
    return every.select(number.cast("int").alias("candidate"), *bounds).where(F.col("candidate") < budget)


def gamma_hydrograph(t: Column, base: Column, peak: Column, t_peak: Column, shape: Column) -> Column:
    """Flow at t: base plus a gamma-shaped wave that reaches `peak` at t_peak."""
    x = t / t_peak
    return base + (peak - base) * F.when(t <= 0, 0.0).otherwise(F.pow(x, shape) * F.exp(shape * (1.0 - x)))


def swept(observed: DataFrame, candidates: DataFrame, simulated: Column, *by: str) -> DataFrame:
    """Metrics and loss of every candidate for every group. observed: by, t, o; `simulated` may use t and the candidate's columns.

    A loss that is not finite counts as 1e6. Candidates are few, so they are broadcast; the rows are aggregated before any shuffle.
    """
    fits = hydrograph_fit(observed.crossJoin(F.broadcast(candidates)).withColumn("s", simulated), *by, "candidate")
    loss = F.when(F.col("loss").isNull() | F.isnan("loss") | (F.abs("loss") == F.lit(float("inf"))), 1e6).otherwise(F.col("loss"))
    return fits.withColumn("loss", loss)


def best(losses: DataFrame, *by: str) -> DataFrame:
    """Per group: the candidate of least loss, the first of equals, and what it improves on candidate 0 (per cent)."""
    first = F.max(F.when(F.col("candidate") == 0, F.col("loss")))
    found = losses.groupBy(*by).agg(F.min_by("candidate", F.struct("loss", "candidate")).alias("candidate"), F.min("loss").alias("loss"), first.alias("initial_loss"))
    return found.withColumn("improvement_pct", steady(F.when(F.col("initial_loss") > 0, (F.col("initial_loss") - F.col("loss")) / F.col("initial_loss") * 100.0).otherwise(0.0), 4))


def history(losses: DataFrame, *by: str) -> DataFrame:
    """The least loss so far, candidate by candidate."""
    return losses.select(*by, "candidate", "loss", F.min("loss").over(Window.partitionBy(*by).orderBy("candidate").rowsBetween(Window.unboundedPreceding, 0)).alias("best_loss"))


def sensitivity(observed: DataFrame, default: dict[str, float], bounds: dict[str, tuple[float, float]], simulated: Column, *by: str, share: float = 0.15) -> DataFrame:
    """One parameter at a time, lowered and raised by `share` within bounds: elasticity of the loss, ranked."""
    spark, rows = observed.sparkSession, []
    for k, name in enumerate(default):
        for j, factor in enumerate((1.0 - share, 1.0, 1.0 + share)):
            low, high = bounds[name]
            rows.append((3 * k + j, name, ("low", "base", "high")[j], *(min(high, max(low, v * factor)) if n == name else v for n, v in default.items())))
    runs = spark.createDataFrame(rows, f"candidate int, parameter string, side string, {', '.join(f'{n} double' for n in default)}")
    losses = swept(observed, runs.drop("parameter", "side"), simulated, *by).join(F.broadcast(runs.select("candidate", "parameter", "side", *(F.col(n).alias(f"p_{n}") for n in default))), "candidate")
    value = F.coalesce(*(F.when(F.col("parameter") == n, F.col(f"p_{n}")) for n in default))
    at = lambda side, x: F.max(F.when(F.col("side") == side, x))
    wide = losses.groupBy(*by, "parameter").agg(*(at(s, F.col("loss")).alias(f"loss_{s}") for s in ("low", "base", "high")), *(at(s, value).alias(f"value_{s}") for s in ("low", "base", "high")))
    change = F.abs(F.col("loss_high") - F.col("loss_low")) / F.greatest(F.col("loss_base"), F.lit(1e-9)) / ((F.col("value_high") - F.col("value_low")) / F.col("value_base"))
    ranked = wide.withColumn("elasticity", steady(change, 4))
    return ranked.select(*by, "parameter", "loss_low", "loss_base", "loss_high", "elasticity", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("elasticity"), "parameter")).alias("rank"))
