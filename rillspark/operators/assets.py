"""Critical assets: site depth, access roads, operational status and the intervention queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.shared import looked_up, small
from rillspark.operators.roads import steady

KEYS = ("scenario_id", "lead_minutes")


def site_depths(assets: DataFrame, depth: DataFrame, frames: DataFrame, default: float = 0.0) -> DataFrame:
    """Depth at every asset's cell for every frame; `default` where the grid has no such cell. Cells are looked up once for all assets there."""
    every = assets.select("r", "c").distinct().crossJoin(small(frames))  # frames: the (scenario, lead) pairs, a short list as a rule
    known = every.join(depth.select(*KEYS, "r", "c", "depth_m").hint("merge"), [*KEYS, "r", "c"], "left").withColumn("site_depth_m", F.coalesce("depth_m", F.lit(default))).drop("depth_m")
    return looked_up(assets, known, "r", "c")


def access_depths(sites: DataFrame, links: DataFrame, road_max: DataFrame) -> DataFrame:
    """Largest depth over an asset's access roads that are known; else 0.2 if its site is wet (> 0.1), else 0.

    links: asset_id, road_id; road_max: scenario_id, lead_minutes, road_id, max_depth_m.
    """
    worst = links.join(road_max.hint("merge"), "road_id").groupBy(*KEYS, "asset_id").agg(F.max("max_depth_m").alias("known"))
    guess = F.when(F.col("site_depth_m") > 0.1, 0.2).otherwise(0.0)
    return sites.join(worst.hint("merge"), [*KEYS, "asset_id"], "left").withColumn("access_depth_m", F.coalesce("known", guess)).drop("known")


def assessed(sites: DataFrame) -> DataFrame:
    """Status, people affected, vulnerability and priority of each asset."""
    site, access = F.col("site_depth_m"), F.col("access_depth_m")
    status = F.when(site >= F.col("failure_depth_m"), "CRITICAL_FAILURE").when(site >= F.col("critical_depth_m"), "DIRECT_INUNDATION").when(access >= 0.15, "ACCESS_IMPAIRED").otherwise("NORMAL")
    of = lambda a, b, c: F.when(F.col("status") == "CRITICAL_FAILURE", a).when(F.col("status") == "DIRECT_INUNDATION", b).when(F.col("status") == "ACCESS_IMPAIRED", c)
    term = F.when(F.col("failure_depth_m") > 0, F.least(F.lit(1.0), site / F.col("failure_depth_m"))).otherwise(0.0)
    score = F.when(F.col("status") == "NORMAL", 0.0).otherwise(0.6 * term + 0.4 * F.least(F.lit(1.0), access / 0.5))
    cm = lambda x: F.format_string("%.0f", F.round(x * 100 + 1e-9, 0))
    # fixed values: the texts of the four actions
    action = (
        F.when(F.col("status") == "CRITICAL_FAILURE", F.concat(F.lit("EMERGENCY SHUTDOWN / EVACUATE: Severe inundation ("), cm(site), F.lit(" cm) exceeds failure threshold.")))
        .when(F.col("status") == "DIRECT_INUNDATION", F.concat(F.lit("DEPLOY FLOOD BARRIERS: Site flooded ("), cm(site), F.lit(" cm). Deploy mobile dewatering pumps immediately.")))
        .when(F.col("status") == "ACCESS_IMPAIRED", F.concat(F.lit("TRAFFIC DIVERSION: Facility site is dry ("), cm(site), F.lit(" cm) but access road is submerged ("), cm(access), F.lit(" cm).")))
        .otherwise("CONTINUOUS MONITORING: Facility and ingress corridors remain fully operational.")
    )
    found = sites.withColumn("status", status).withColumn("score", score)
    return found.select(
        *KEYS, "asset_id", "criticality_weight", "site_depth_m", "access_depth_m", "status", steady(F.col("score")).alias("vulnerability_score"),
        F.floor(F.col("service_population") * of(1.0, 0.8, 0.4).otherwise(0.0) + 1e-9).cast("long").alias("impacted_population"),
        steady(F.col("criticality_weight") * F.col("score") * F.when(F.col("status") == "CRITICAL_FAILURE", 1.5).otherwise(1.0)).alias("priority_score"), action.alias("recommended_action"),
    )


def rolled_up(assessments: DataFrame) -> DataFrame:
    """Per frame: assets by status, people exposed and the catchment's vulnerability index (0 to 100)."""
    w = F.col("criticality_weight")
    return assessments.groupBy(*KEYS).agg(
        *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("NORMAL", "ACCESS_IMPAIRED", "DIRECT_INUNDATION", "CRITICAL_FAILURE")),
        F.sum("impacted_population").alias("exposed_population"), steady(F.sum(w * F.col("vulnerability_score")) / F.sum(w) * 100.0, 4).alias("vulnerability_index"),
    )


def intervention_queue(assessments: DataFrame) -> DataFrame:
    """Assets that are not normal, ranked in each frame by priority; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("priority_score"), "asset_id"))
    return assessments.where("status <> 'NORMAL'").select(*KEYS, rank.alias("rank"), "asset_id", "status", "priority_score")
