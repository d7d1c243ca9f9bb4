"""Gauge and radar observations: standard rates, quality, intervals, latest and nearest observations, provider health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.policy import MAX_DBZ, MIN_DBZ, ZR
from rillspark.operators.roads import steady

# Minutes.
FRESH, STALE = 30.0, 120.0
# Minutes; ages of a provider's newest observation.
YOUNG, AGING, EXPIRED = 20.0, 45.0, 90.0
NEGATIVE_TOLERANCE = -0.001


def rain_rate(dbz: Column, profile: str = "convective") -> Column:
    """Rain rate (mm/h) of a reflectivity: nothing below MIN_DBZ, capped at MAX_DBZ; what is not finite gives 0."""
    a, b = ZR[profile]
    rate = F.pow(F.pow(F.lit(10.0), F.least(dbz, F.lit(MAX_DBZ)) / 10.0) / a, F.lit(1.0 / b))
    return F.when(dbz.isNull() | F.isnan(dbz) | (dbz < MIN_DBZ), 0.0).otherwise(rate)


def reflectivity(rate: Column, profile: str = "convective") -> Column:
    """The inverse; -30 dBZ for no rain."""
    a, b = ZR[profile]
    return F.when(rate.isNull() | F.isnan(rate) | (rate <= 0), -30.0).otherwise(10.0 * F.log10(a * F.pow(F.greatest(rate, F.lit(1e-6)), F.lit(b))))


def standardised(obs: DataFrame) -> DataFrame:
    """rate_mmh of each observation by its product type: reflectivity by Z-R, rates and sums as they are, not below 0; other types are null."""
    raw = F.col("raw_value").cast("double")
    direct = F.when(raw.isNull() | F.isnan(raw), 0.0).otherwise(F.greatest(F.lit(0.0), raw))
    kind = F.col("product_type")
    return obs.withColumn("rate_mmh", F.when(kind == "REFLECTIVITY_DBZ", rain_rate(raw)).when(kind.isin("RAIN_RATE_MMH", "SATELLITE_QPE", "ACCUMULATION_MM"), direct))


def frame_statistics(rates: DataFrame, *by: str) -> DataFrame:
    """Mean, largest and smallest rate, and the share of wet (>= 0.1 mm/h)."""
    return rates.groupBy(*by).agg(
        F.count("rate_mmh").alias("n"), steady(F.avg("rate_mmh")).alias("mean_mmh"), steady(F.max("rate_mmh")).alias("max_mmh"), steady(F.min("rate_mmh")).alias("min_mmh"),
        steady(F.avg(F.when(F.col("rate_mmh") >= 0.1, 1.0).when(F.col("rate_mmh").isNotNull(), 0.0))).alias("wet_fraction"),
    )


def quality(obs: DataFrame, now: Column) -> DataFrame:
    """Freshness, errors and warnings of each observation at a time, and whether it may be used.

    errors and warnings are texts joined by "; "; an observation is valid without errors, observable if also FRESH or STALE.
    """
    age = (F.unix_micros(now) - F.unix_micros(F.col("observation_time").cast("timestamp"))) / 6e7
    minutes = F.format_string("%.1f", F.round(F.abs(F.col("age")) + 1e-9, 1))
    raw = F.col("raw_value").cast("double")
    errors = F.array(
        F.when(raw.isNull() | F.isnan(raw), "RATE_NOT_FINITE"),
        F.when(raw < NEGATIVE_TOLERANCE, F.concat(F.lit("RATE_BELOW_ZERO "), F.format_string("%.4f", F.round(raw - 1e-9, 4)), F.lit(" mm/h"))),
        F.when(F.col("age") < -FRESH, F.concat(F.lit("AHEAD_OF_TIME "), minutes, F.lit(" minutes"))),
        F.when(F.col("age") > STALE, F.concat(F.lit("AGE "), minutes, F.lit(" min too old"))),
    )
    warnings = F.array(
        F.when((F.col("age") < 0) & (F.col("age") >= -FRESH), F.concat(F.lit("AHEAD_OF_TIME "), minutes, F.lit(" minutes"))),
        F.when((F.col("age") > FRESH) & (F.col("age") <= STALE), F.concat(F.lit("AGE "), minutes, F.lit(" min old"))),
    )
    fresh = F.when(F.col("age") < -FRESH, "INVALID").when(F.col("age") <= FRESH, "FRESH").when(F.col("age") <= 2 * STALE, "STALE").otherwise("MISSING")
    found = obs.withColumn("age", age).withColumns({"freshness": fresh, "errors": F.array_join(errors, "; "), "warnings": F.array_join(warnings, "; ")})
    valid = F.col("errors") == ""
    return found.withColumns({"valid": valid, "observable": valid & F.col("freshness").isin("FRESH", "STALE")}).drop("age")


def accumulated(rates: DataFrame, minutes: int = 15) -> DataFrame:
    """Mean rate and depth (mm) per sensor and half-open interval of so many minutes."""
    timed = rates.withColumn("t", F.col("observation_time").cast("timestamp"))
    found = timed.groupBy("sensor_id", F.window("t", f"{minutes} minutes").alias("w")).agg(F.count("rate_mmh").alias("n"), F.avg("rate_mmh").alias("mean"))
    return found.select("sensor_id", F.col("w.start").cast("timestamp_ntz").alias("valid_from"), F.col("w.end").cast("timestamp_ntz").alias("valid_to"), "n", steady(F.col("mean")).alias("rate_mmh"), steady(F.col("mean") * minutes / 60.0).alias("depth_mm"))


def latest(obs: DataFrame, *by: str) -> DataFrame:
    """The newest observation of each group; of equal times, the one of the largest id."""
    rest = [c for c in obs.columns if c not in by]
    return obs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("observation_time", "obs_id")).alias("o")).select(*by, "o.*")


def health(obs: DataFrame, now: Column, *by: str) -> DataFrame:
    """Per provider (columns `by`): number, newest time, status and message by the age of the newest observation at a time.

    Up to 45 minutes HEALTHY (AGING beyond 20), up to 90 DEGRADED, then UNAVAILABLE; without any observation time UNCONFIGURED.
    """
    found = obs.groupBy(*by).agg(F.count("observation_time").alias("observations"), F.max(F.col("observation_time").cast("timestamp")).alias("last"))
    age = (F.unix_micros(now) - F.unix_micros("last")) / 6e7
    status = F.when(F.col("last").isNull(), "UNCONFIGURED").when(age <= AGING, "HEALTHY").when(age <= EXPIRED, "DEGRADED").otherwise("UNAVAILABLE")
    word = F.when(F.col("last").isNull(), "NO_OBSERVATION").when(age <= YOUNG, "FRESH").when(age <= AGING, "AGING").when(age <= EXPIRED, "STALE").otherwise("EXPIRED")
    text = F.concat_ws(", ", word, F.concat(F.format_string("%.1f", F.when(F.col("last").isNotNull(), age)), F.lit(" min")), F.concat(F.col("observations").cast("string"), F.lit(" observations")))
    text = F.when(F.col("last").isNull(), word).otherwise(text)
    return found.select(*by, "observations", F.col("last").cast("timestamp_ntz").alias("last_observation"), status.alias("status"), text.alias("message"))


def nearest_in_time(wanted: DataFrame, obs: DataFrame, minutes: int = 15) -> DataFrame:
    """For each wanted (sensor_id, t) the nearest observation within so many minutes; ties to the earlier, then the smaller id.

    Where there is none, the sensor's latest observation is given (fallback is true; its gap may be of any length). Times fall into buckets of that length and
    stand in one order with the bucket's observations, the last one of the bucket before and the first one of the bucket after: the nearest is the neighbour on
    either side, so no pair of a time and an observation is made, however dense they are.
    """
    size = minutes * 60
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(F.col(c) / (size * 1e6)).alias("bucket")
    asked = wanted.select("sensor_id", "t").distinct().withColumn("tm", micros("t")).select("sensor_id", bucket("tm"), "tm", "t", F.lit(True).alias("asked"))
    have = obs.select("sensor_id", "obs_id", micros("observation_time").alias("om")).where("om IS NOT NULL").groupBy("sensor_id", "om").agg(F.min("obs_id").alias("obs_id")).select("sensor_id", bucket("om"), F.struct("om", "obs_id").alias("o"))
    ends = have.groupBy("sensor_id", "bucket").agg(F.array(F.struct((F.col("bucket") - 1).alias("bucket"), F.min("o").alias("o")), F.struct((F.col("bucket") + 1).alias("bucket"), F.max("o").alias("o"))).alias("e"))
    near = have.unionByName(ends.select("sensor_id", F.explode("e").alias("e")).select("sensor_id", "e.*")).withColumns({"tm": F.col("o.om"), "asked": F.lit(False)})
    place = Window.partitionBy("sensor_id", "bucket")
    back, ahead = place.orderBy("tm", "asked"), place.orderBy(F.desc("tm"), "asked")  # an observation of the very time stands before it
    so_far = lambda w: F.last("o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = asked.unionByName(near, allowMissingColumns=True).withColumn("before", so_far(back)).withColumn("after", so_far(ahead)).where("asked")
    found = lambda c: F.when(F.abs(F.col("tm") - F.col(f"{c}.om")) <= size * 1000000, F.struct(F.abs(F.col("tm") - F.col(f"{c}.om")).alias("gap"), F.col(f"{c}.om"), F.col(f"{c}.obs_id")))
    best = both.select("sensor_id", "t", "tm", F.least(found("before"), found("after")).alias("b"))
    last = obs.groupBy("sensor_id").agg(F.max(F.struct(micros("observation_time").alias("om"), F.col("obs_id"))).alias("l"))
    known = best.join(last.hint("merge"), "sensor_id")
    return known.select(
        "sensor_id", "t", F.coalesce("b.obs_id", "l.obs_id").alias("obs_id"), (F.coalesce("b.gap", F.abs(F.col("tm") - F.col("l.om"))) / 1000000).cast("double").alias("gap_seconds"), F.col("b").isNull().alias("fallback")
    )
