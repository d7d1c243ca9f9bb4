"""Water balance of runs: residuals, closing status, acceptance, and the comparison of a clean run with a blocked one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.roads import steady

# Relative residuals up to which a balance passes, or is warned of.
PASS_RELATIVE, WARN_RELATIVE = 0.01, 0.05


def residuals(ledger: DataFrame) -> DataFrame:
    """Residuals of the surface, the drainage and both together, the relative one, and pass, warning or fail.

    ledger: rain, ext_in, losses, surf_out, s2d, d2s, flood_export, outfall (all _m3), storages s_s0, s_s1 (surface) and s_d0, s_d1 (drainage).
    What flows between surface and drainage cancels in the total. Terms that are null or not finite fail.
    """
    v = lambda name: F.col(f"{name}_m3")
    on_surface, in_pipes = F.col("s_s1") - F.col("s_s0"), F.col("s_d1") - F.col("s_d0")
    surface = v("rain") - v("losses") - v("surf_out") - v("s2d") + v("d2s") + v("flood_export") - on_surface
    drainage = v("ext_in") + v("s2d") - v("d2s") - v("flood_export") - v("outfall") - in_pipes
    total = v("rain") + v("ext_in") - v("losses") - v("surf_out") - v("outfall") - on_surface - in_pipes
    found = ledger.withColumns({"rs": surface, "rd": drainage, "rt": total}).withColumn("rel", F.abs("rt") / F.greatest(F.abs(v("rain")) + F.abs(v("ext_in")), F.lit(1e-6)))
    still = (F.abs("rt") <= 1e-6) & (v("rain") == 0) & (v("ext_in") == 0)
    bad = F.col("rel").isNull() | F.isnan("rel") | (F.col("rel") == F.lit(float("inf")))
    status = F.when(bad, "fail").when((F.col("rel") <= PASS_RELATIVE) | still, "pass").when(F.col("rel") <= WARN_RELATIVE, "warning").otherwise("fail")
    return found.select(*(c for c in ledger.columns), steady(F.col("rs")).alias("residual_surface_m3"), steady(F.col("rd")).alias("residual_drainage_m3"), steady(F.col("rt")).alias("residual_total_m3"), steady(F.col("rel")).alias("relative_total"), status.alias("balance_status"))


def blockage(ledger: DataFrame, clean: str, blocked: str) -> DataFrame:
    """Per run, what the blocked scenario has more (or lets through less) than the clean one, and how far that is physically consistent."""
    columns = ("peak_depth_m", "max_flooded_area_m2", "max_surcharge_m", "s2d_m3", "d2s_m3", "outfall_m3")
    stored = F.col("s_s1") - F.col("s_s0")
    side = lambda k, p: ledger.where(F.col("scenario_id") == k).select("run_id", *(F.col(x).alias(f"{p}_{x}") for x in columns), stored.alias(f"{p}_stored"))
    both = side(clean, "a").join(side(blocked, "b").hint("merge"), "run_id")
    more = lambda x: F.col(f"b_{x}") - F.col(f"a_{x}")
    status = (
        F.when((more("d2s_m3") > 0) & (more("outfall_m3") < 0) & (more("peak_depth_m") >= 0), "PHYSICALLY CONSISTENT")
        .when((F.col("a_d2s_m3") == 0) & (F.col("b_d2s_m3") == 0), "NO SURCHARGE \u2014 REVIEW").otherwise("REVIEW REQUIRED")
    )
    deltas: dict[str, tuple[Column, int]] = {
        "delta_peak_depth_m": (more("peak_depth_m"), 6), "delta_flooded_area_m2": (more("max_flooded_area_m2"), 4), "delta_surface_storage_change_m3": (more("stored"), 4), "delta_max_surcharge_m": (more("max_surcharge_m"), 6),
        "capture_reduction_m3": (-more("s2d_m3"), 4), "additional_spill_m3": (more("d2s_m3"), 4), "outfall_reduction_m3": (-more("outfall_m3"), 4),
    }
    return both.select("run_id", *(steady(x, n).alias(name) for name, (x, n) in deltas.items()), status.alias("interpretation_status"))


def accepted_runs(balances: DataFrame) -> DataFrame:
    """Per scenario: runs by balance status, the largest relative residual, and whether all pass, some are warned of, or any fails."""
    n = lambda s: F.count_if(F.col("balance_status") == s)
    overall = F.when(n("fail") > 0, "fail").when(n("warning") > 0, "warning").otherwise("pass")
    return balances.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("runs"), n("pass").alias("passed"), n("warning").alias("warned"), n("fail").alias("failed"), F.max("relative_total").alias("worst_relative"), overall.alias("overall_status"))


def identity(ledger: DataFrame) -> DataFrame:
    """The balance of every run as signed terms, inputs above 0 and outputs below, which add up to the change of storage and the residual."""
    v = lambda name: F.col(f"{name}_m3")
    stored = F.col("s_s1") - F.col("s_s0") + F.col("s_d1") - F.col("s_d0")
    terms = {"rain": v("rain"), "external": v("ext_in"), "losses": -v("losses"), "surface_outflow": -v("surf_out"), "outfall": -v("outfall"), "storage_change": -stored}
    return ledger.select("run_id", "scenario_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*terms.values()))).alias("term", "volume_m3"))
