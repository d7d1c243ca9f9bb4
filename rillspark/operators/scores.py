"""Forecast verification, calibration and validation metrics, ensemble probabilities.

Everything is a grouped aggregate in one pass, so partial sums are combined before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.shared import tiled
from rillspark.operators.roads import steady


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def continuous(pairs: DataFrame, *by: str) -> DataFrame:
    """MAE, RMSE, bias and correlation of forecast f against observation o (0 where either does not vary)."""
    e = F.col("f") - F.col("o")
    flat = (F.stddev_pop("f") < 1e-12) | (F.stddev_pop("o") < 1e-12)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), steady(F.avg(F.abs(e))).alias("mae"), steady(F.sqrt(F.avg(e * e))).alias("rmse"), steady(F.avg(e)).alias("bias"),
        steady(F.when(flat, 0.0).otherwise(F.corr("f", "o"))).alias("correlation"),
    )


def categorical(pairs: DataFrame, thresholds: DataFrame, *by: str) -> DataFrame:
    """Per threshold (events are >=): the contingency counts and CSI, POD, FAR and ETS (0 where undefined)."""
    f, o = F.col("f") >= F.col("threshold"), F.col("o") >= F.col("threshold")
    counted = pairs.crossJoin(F.broadcast(thresholds)).groupBy(*by, "threshold").agg(
        F.count_if(f & o).alias("hits"), F.count_if(~f & o).alias("misses"), F.count_if(f & ~o).alias("false_alarms"), F.count_if(~f & ~o).alias("correct_negatives")
    )
    h, m, a, z = (F.col(c).cast("double") for c in ("hits", "misses", "false_alarms", "correct_negatives"))
    by_chance = (h + m) * (h + a) / (h + m + a + z)
    return counted.select(
        *by, "threshold", "hits", "misses", "false_alarms", "correct_negatives", steady(ratio(h, h + m + a)).alias("csi"), steady(ratio(h, h + m)).alias("pod"),
        steady(ratio(a, h + a)).alias("far"), steady(ratio(h - by_chance, h + m + a - by_chance)).alias("ets"),
    )


def fraction_skill(pairs: DataFrame, threshold: float = 1.0, window: int = 5) -> DataFrame:
    """Fractions skill score of a dense grid (r, c, f, o): event shares in windows, zero beyond the edges, compared.

    The square window is two one-way windows, one after the other, each within a tile of a line of cells.
    """
    half = window // 2
    along = lambda line, place: Window.partitionBy(line, "tile").orderBy(place).rangeBetween(-half, half)
    events = pairs.select("r", "c", *((F.col(x) >= threshold).cast("double").alias(x) for x in ("f", "o")))
    wide = tiled(events, "c", half).select("r", "c", "own", *(F.sum(x).over(along("r", "c")).alias(x) for x in ("f", "o"))).where("own").drop("own")
    share = tiled(wide, "r", half).select("own", *((F.sum(x).over(along("c", "r")) / float(window * window)).alias(x) for x in ("f", "o"))).where("own")
    mse, worst = F.avg((F.col("f") - F.col("o")) * (F.col("f") - F.col("o"))), F.avg(F.col("f") * F.col("f")) + F.avg(F.col("o") * F.col("o"))
    return share.agg(mse.alias("mse"), worst.alias("worst")).select(steady(F.when(F.col("worst") <= 1e-12, F.when(F.col("mse") <= 1e-12, 1.0).otherwise(0.0)).otherwise(1.0 - F.col("mse") / F.col("worst"))).alias("fss"))


def hydrograph_fit(series: DataFrame, *by: str, step_minutes: float = 1.0, weights: tuple[float, float, float] = (0.50, 0.25, 0.15)) -> DataFrame:
    """Calibration metrics of simulated s against observed o in order of t: NSE, KGE (sample deviations), peak, timing and volume errors, RMSE, loss."""
    o, s, e = F.col("o"), F.col("s"), F.col("s") - F.col("o")
    sums = series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o").alias("mo"), F.avg("s").alias("ms"), F.sum("o").alias("so"), F.sum("s").alias("ss"), F.sum(e * e).alias("sse"),
        F.var_pop("o").alias("vo"), F.stddev_samp("o").alias("do"), F.stddev_samp("s").alias("ds"), F.covar_samp("o", "s").alias("cov"), F.max("o").alias("po"), F.max("s").alias("ps"),
        F.max_by("t", F.struct(o, -F.col("t"))).alias("to"), F.max_by("t", F.struct(s, -F.col("t"))).alias("ts"),
    )
    c = F.col
    flat = (c("do") < 1e-12) | (c("ds") < 1e-12)
    parts = sums.where("n >= 2").withColumns({
        "nse": F.when(c("vo") * c("n") < 1e-12, F.when(c("sse") < 1e-12, 1.0).otherwise(-1e6)).otherwise(1.0 - c("sse") / (c("vo") * c("n"))),
        "r": F.when(flat, F.when(F.abs(c("mo") - c("ms")) < 1e-6, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("cov") / (c("do") * c("ds"))))),
        "alpha": F.when(c("do") > 1e-12, c("ds") / c("do")).otherwise(F.when(c("ds") < 1e-12, 1.0).otherwise(10.0)),
        "beta": F.when(F.abs(c("mo")) > 1e-12, c("ms") / c("mo")).otherwise(F.when(F.abs(c("ms")) < 1e-12, 1.0).otherwise(10.0)),
        "pfe_pct": F.when(c("po") < 1e-12, F.when(c("ps") < 1e-12, 0.0).otherwise(100.0)).otherwise(F.abs(c("ps") - c("po")) / c("po") * 100.0),
        "tpe_minutes": F.abs(c("ts") - c("to")) * step_minutes,
        "pbias_pct": F.when(F.abs(c("so")) < 1e-12, F.when(F.abs(c("ss")) < 1e-12, 0.0).otherwise(100.0)).otherwise((c("ss") - c("so")) / c("so") * 100.0),
        "rmse": F.sqrt(c("sse") / c("n")),
    }).withColumn("kge", 1.0 - F.sqrt((c("r") - 1) * (c("r") - 1) + (c("alpha") - 1) * (c("alpha") - 1) + (c("beta") - 1) * (c("beta") - 1)))
    k, p, b = weights
    loss = (k * F.greatest(F.lit(0.0), 1.0 - c("kge")) + p * F.least(F.lit(5.0), c("pfe_pct") / 100.0) + b * F.least(F.lit(5.0), F.abs(c("pbias_pct")) / 100.0)) / (k + p + b)
    return parts.withColumn("loss", loss).select(*by, "n", *(steady(c(x)).alias(x) for x in ("nse", "kge", "r", "alpha", "beta", "pfe_pct", "tpe_minutes", "pbias_pct", "rmse", "loss")))


def extent_scores(pairs: DataFrame, *by: str, threshold: float = 0.05) -> DataFrame:
    """Flood extent (>=) of simulation s against reference o: CSI and POD are 1, FAR is 0, where undefined; and depth errors."""
    s, o, e = F.col("s") >= threshold, F.col("o") >= threshold, F.col("s") - F.col("o")
    counted = pairs.groupBy(*by).agg(
        F.count_if(s & o).alias("hits"), F.count_if(~s & o).alias("misses"), F.count_if(s & ~o).alias("false_alarms"), F.count_if(~s & ~o).alias("correct_negatives"),
        steady(F.sqrt(F.avg(e * e))).alias("rmse_m"), steady(F.avg(F.abs(e))).alias("mae_m"), steady(F.max(F.abs(e))).alias("max_abs_m"), steady(F.avg(e)).alias("bias_m"),
    )
    h, m, a = (F.col(c).cast("double") for c in ("hits", "misses", "false_alarms"))
    return counted.withColumns({"csi": steady(ratio(h, h + m + a, 1.0)), "pod": steady(ratio(h, h + m, 1.0)), "far": steady(ratio(a, h + a)), "f1": steady(ratio(2 * h, 2 * h + m + a, 1.0))})


def member_depths(depth: DataFrame, members: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every ensemble member's grid: depth times a multiplier, shifted with wrap-around."""
    many = depth.crossJoin(F.broadcast(members))
    return many.select(
        "scenario_id", "lead_minutes", "member_id", F.pmod(F.col("r") + F.col("dr"), F.lit(rows)).cast("int").alias("r"), F.pmod(F.col("c") + F.col("dc"), F.lit(columns)).cast("int").alias("c"),
        (F.col("depth_m") * F.col("multiplier")).alias("depth_m"),
    )


def member_metrics(grids: DataFrame, cell_m2: float = 900.0) -> DataFrame:
    """Per member: largest depth (3 digits) and inundated area (>= 5 cm)."""
    return grids.groupBy("scenario_id", "lead_minutes", "member_id").agg(steady(F.max("depth_m"), 3).alias("max_depth_m"), (F.count_if(F.col("depth_m") >= 0.05) * cell_m2).alias("inundated_area_m2"))


def confidence_bounds(metrics: DataFrame) -> DataFrame:
    """P10, P50 and P90 of the members' largest depths, between values linearly, and P90 - P10."""
    p = metrics.groupBy("scenario_id", "lead_minutes").agg(F.percentile("max_depth_m", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return p.select("scenario_id", "lead_minutes", *(steady(F.col("p")[k], 3).alias(f"p{n}_max_depth_m") for k, n in enumerate((10, 50, 90))), steady(F.col("p")[2] - F.col("p")[0], 3).alias("interquartile_range_m"))


def exceedance(grids: DataFrame, thresholds: DataFrame, members: int, cells: int) -> DataFrame:
    """Per threshold (>=): cells by probability over all members (cells that no member holds have none), and its mean over the grid's `cells` and its largest."""
    cell = grids.groupBy("scenario_id", "lead_minutes", "r", "c").agg(F.collect_list("depth_m").alias("d"))  # one value a member
    p = cell.crossJoin(F.broadcast(thresholds)).withColumn("p", F.size(F.filter("d", lambda x: x >= F.col("threshold"))) / float(members))
    return p.groupBy("scenario_id", "lead_minutes", "threshold").agg(
        F.count_if(F.col("p") > 0).alias("cells_any"), F.count_if(F.col("p") >= 0.5).alias("cells_likely"), F.count_if(F.col("p") >= 0.9).alias("cells_certain"),
        steady(F.sum("p") / float(cells)).alias("mean_probability"), steady(F.max("p")).alias("max_probability"),
    )


def brier(grids: DataFrame, base: DataFrame, members: int, threshold: float = 0.10) -> DataFrame:
    """Mean squared difference between the members' probability and the base grid's event, over the base grid's cells."""
    p = grids.groupBy("scenario_id", "lead_minutes", "r", "c").agg((F.count_if(F.col("depth_m") >= threshold) / float(members)).alias("p"))
    both = base.join(p.hint("merge"), ["scenario_id", "lead_minutes", "r", "c"], "left").withColumn("e", F.coalesce("p", F.lit(0.0)) - (F.col("depth_m") >= threshold).cast("double"))
    return both.groupBy("scenario_id", "lead_minutes").agg(steady(F.avg(F.col("e") * F.col("e"))).alias("brier_score"))


def side_by_side(grids: DataFrame, members: list[int]) -> DataFrame:
    """Grids of members as one row a cell: scenario_id, lead_minutes, r, c and a column m<id> for each member (a short list)."""
    return grids.groupBy("scenario_id", "lead_minutes", "r", "c").agg(*(F.max(F.when(F.col("member_id") == m, F.col("depth_m"))).alias(f"m{m}") for m in members))


def one_by_one(wide: DataFrame, members: list[int], *keys: str) -> DataFrame:
    """The inverse for values by member in columns m<id>: keys, member_id, d; members without a value have no row."""
    each = F.array(*(F.struct(F.lit(m).alias("member_id"), F.col(f"m{m}").alias("d")) for m in members))
    return wide.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*").where("d IS NOT NULL")


def road_risk(worst: DataFrame) -> DataFrame:
    """Per road: probabilities over members of being impassable (>= .30), in caution (.10 to .30) and dry, mean and P90 of the members' largest depth.

    worst: scenario_id, lead_minutes, road_id, member_id, d (the largest depth on the road).
    """
    share = lambda x: steady(F.avg(F.when(x, 1.0).otherwise(0.0)), 3)
    return worst.groupBy("scenario_id", "lead_minutes", "road_id").agg(
        share(F.col("d") >= 0.30).alias("prob_impassable"), share((F.col("d") >= 0.10) & (F.col("d") < 0.30)).alias("prob_caution"), share(F.col("d") < 0.10).alias("prob_dry"),
        steady(F.avg("d"), 3).alias("expected_depth_m"), steady(F.percentile("d", 0.9), 3).alias("depth_p90_m"),
    )


def benchmark_tiers(pairs: DataFrame, own: Column, column: int, residual_pct: float | None, *by: str, threshold: float = 0.05) -> DataFrame:
    """Per benchmark and frame: efficiency along one column of the grid, extent score (>=), and the tier that they reach.

    pairs: by, c, s (simulated), o (benchmark). `own` tells a comparison with oneself, which cannot be of the first tier, nor can a run with
    an unknown or large residual of its water balance. A benchmark column that does not vary has efficiency 1 if met, else none.
    """
    e, along = F.col("s") - F.col("o"), F.col("c") == column
    s, o = F.col("s") >= threshold, F.col("o") >= threshold
    sums = pairs.withColumn("own", own).groupBy(*by, "own").agg(
        F.sum(F.when(along, e * e)).alias("sse"), (F.var_pop(F.when(along, F.col("o"))) * F.count(F.when(along, 1))).alias("sso"), F.count_if(s & o).alias("hits"), F.count_if(s | o).alias("either")
    )
    nse = F.when((F.col("sso") <= 1e-12) | F.col("sso").isNull(), F.when(F.col("sse") <= 1e-12, 1.0)).otherwise(1.0 - F.col("sse") / F.col("sso"))
    scored = sums.withColumns({"nse": nse, "csi": ratio(F.col("hits").cast("double"), F.col("either").cast("double"), 1.0)})
    closed = F.lit(residual_pct is not None and residual_pct <= 0.05)
    tier = F.when(~F.col("own") & closed & (F.col("nse") >= 0.75) & (F.col("csi") >= 0.70), "TIER_1_PUBLICATION_GRADE").when((F.col("nse") >= 0.50) & (F.col("csi") >= 0.50), "TIER_2_OPERATIONAL_GRADE").otherwise("TIER_3_DIAGNOSTIC_GRADE")
    return scored.select(*by, steady(F.col("nse"), 4).alias("nse"), steady(F.col("csi"), 4).alias("csi"), tier.alias("tier"))


def masked_rmse(pairs: DataFrame, mask: Column, *by: str) -> DataFrame:
    """Cells within the mask and their RMSE of simulation s against reference o (null where there are none)."""
    e = F.col("s") - F.col("o")
    return pairs.groupBy(*by).agg(F.count_if(mask).alias("cells"), steady(F.sqrt(F.avg(F.when(mask, e * e)))).alias("rmse_m"))
