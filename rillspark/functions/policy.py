"""Policy and catalog values as data, and the column functions that read them.

A policy is a small dictionary that callers may replace; the functions turn it into Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Passability thresholds in metres, speed factors, speeds in km/h.
PASSABILITY = {
    "dry_m": 0.05, "low_m": 0.15, "caution_m": 0.30, "impassable_m": 0.50, "impacted_m": 0.05,
    "factors": {"DRY": 1.0, "LOW_IMPACT": 0.7, "CAUTION": 0.5, "HIGH_IMPACT": 0.3},
    "speeds": {"primary": 50.0, "secondary": 40.0, "local": 30.0},
}

# Vehicle profiles as (id, deepest water in metres, speed in km/h, least speed factor).
VEHICLES = (
    ("AMBULANCE", 0.20, 45.0, 0.30),
    ("SUV", 0.30, 45.0, 0.25),
    ("RESCUE_4X4", 0.60, 35.0, 0.25),
    ("HEAVY_RESCUE", 0.45, 30.0, 0.25),
    ("LIGHT_VEHICLE", 0.10, 50.0, 0.20),
    ("PEDESTRIAN", 0.05, 4.5, 0.40),
)

# Ensemble members as (id, multiplier, rows shifted, columns shifted, weight).
MEMBERS = (
    ("ENS_01_P10", 0.75, 0, 0, 0.10),
    ("ENS_02_P50", 1.00, 0, 0, 0.20),
    ("ENS_03_P90", 1.25, 0, 0, 0.10),
    ("ENS_04_NORTH", 1.05, -2, 0, 0.10),
    ("ENS_05_SOUTH", 1.05, 2, 0, 0.10),
    ("ENS_06_EAST", 1.10, 0, 2, 0.10),
    ("ENS_07_WEST", 1.10, 0, -2, 0.10),
    ("ENS_08_BURST", 1.20, 1, 1, 0.10),
    ("ENS_09_DRY", 0.80, -1, -1, 0.05),
    ("ENS_10_HIGH_STORM", 1.15, 1, -1, 0.05),
)

# Way-point profiles as (id, deepest water in metres, largest depth times velocity in m2/s).
WAYPOINT_PROFILES = (
    ("CIVILIAN_VEHICLE", 0.20, 0.35),
    ("PEDESTRIAN", 0.10, 0.25),
    ("EMERGENCY_RESCUE", 0.40, 0.60),
)

# Z-R profiles as (a, b) and the range of reflectivity that is converted.
ZR = {"marshall_palmer": (200.0, 1.6), "convective": (300.0, 1.4), "tropical": (250.0, 1.2)}
MIN_DBZ, MAX_DBZ = 10.0, 55.0

# Mitigation packages as (id, permeable share, basin m3, pump m3/s, unblocked).
PACKAGES = (("T1", 0.0, 0.0, 3.0, True), ("T2", 0.15, 50000.0, 5.0, True), ("T3", 0.35, 100000.0, 10.0, True))


def values(rows: tuple, names: str) -> str:
    """A VALUES list that both Spark and DuckDB read: `SELECT * FROM (VALUES ...) AS t(names)`."""

    def text(x) -> str:
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, float):
            return f"CAST({x!r} AS DOUBLE)"
        return f"'{x}'" if isinstance(x, str) else str(x)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({names})"


def catalog(spark: SparkSession, rows: tuple, names: str) -> DataFrame:
    """A small catalog as a table (its size is fixed by the code)."""
    return spark.sql(values(rows, names))


def impact_class(depth: Column, policy: dict = PASSABILITY) -> Column:
    """DRY, LOW_IMPACT, CAUTION, HIGH_IMPACT or IMPASSABLE; each limit belongs to the lower class. Null stays null."""
    t = policy
    return (
        F.when(depth.isNull(), None).when(depth <= t["dry_m"], "DRY").when(depth <= t["low_m"], "LOW_IMPACT").when(depth <= t["caution_m"], "CAUTION")
        .when(depth <= t["impassable_m"], "HIGH_IMPACT").otherwise("IMPASSABLE")
    )


def passability(classification: Column) -> Column:
    return F.when(classification == "IMPASSABLE", "IMPASSABLE").otherwise("PASSABLE")


def speed_factor(classification: Column, policy: dict = PASSABILITY) -> Column:
    """Null for a class without a factor, so that its road is excluded."""
    out = F.lit(None).cast("double")
    for name, factor in policy["factors"].items():
        out = F.when(classification == name, F.lit(factor)).otherwise(out)
    return out


def effective_speed(depth: Column, deepest: Column, speed: Column, least: Column) -> Column:
    """Speed in water: unchanged to 1 cm, then falling linearly to `least` of it at the deepest; 0 beyond."""
    degraded = speed * F.greatest(least, 1.0 - (depth / deepest) * (1.0 - least))
    return F.when(depth <= 0.01, speed).when(depth > deepest, F.lit(0.0)).otherwise(degraded)


def class_sql(depth: str, policy: dict = PASSABILITY) -> str:
    """The same as impact_class, as SQL text."""
    return (
        f"CASE WHEN {depth} <= {policy['dry_m']} THEN 'DRY' WHEN {depth} <= {policy['low_m']} THEN 'LOW_IMPACT' WHEN {depth} <= {policy['caution_m']} THEN 'CAUTION' "
        f"WHEN {depth} <= {policy['impassable_m']} THEN 'HIGH_IMPACT' ELSE 'IMPASSABLE' END"
    )
