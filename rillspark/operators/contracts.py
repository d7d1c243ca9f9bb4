"""Checks that input must pass: grids, rain frames, forecasts, cubes and tagged fields; and rules that read a catalog by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.policy import VEHICLES
from rillspark.operators.roads import steady

# The leads of a projection and its interval, in minutes.
VALID_LEADS, INTERVAL = (0, 15, 30, 45, 60), 15
# Other names of vehicle profiles, and the profile that counts for an unknown name.
ALIASES = {
    "CAR": "LIGHT_VEHICLE",
    "AUTO": "LIGHT_VEHICLE",
    "SEDAN": "LIGHT_VEHICLE",
    "LIGHT": "LIGHT_VEHICLE",
    "4X4": "RESCUE_4X4",
    "RESCUE": "RESCUE_4X4",
    "TRUCK": "HEAVY_RESCUE",
    "HEAVY": "HEAVY_RESCUE",
    "MEDIC": "AMBULANCE",
    "FOOT": "PEDESTRIAN",
    "WALK": "PEDESTRIAN",
}
DEFAULT_PROFILE = "LIGHT_VEHICLE"
# Elevations outside are no data (metres); rates are clipped to this range (mm/h).
LEAST_Z, MOST_Z, MOST_RATE = -100.0, 9000.0, 300.0


def texts(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds (null counts as not), joined by "; "."""
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in pairs)), lambda x: x.isNotNull()), "; ")


def checked_frames(cells: DataFrame, heads: DataFrame, *key: str) -> DataFrame:
    """Errors of every rain frame: cells against the head's size, finite and not negative rates, units, time zone and interval.

    cells: key, r, c, rate_mmh; heads: key, width, height, units, zoned, valid_from, valid_to. A head without cells is checked too.
    """
    rate = F.col("rate_mmh")
    odd = rate.isNull() | F.isnan(rate) | (F.abs(rate) == F.lit(float("inf")))
    sums = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("last_r"), F.max("c").alias("last_c"), F.count_if(rate < 0).alias("negative"), F.count_if(odd).alias("odd"))
    both = heads.join(sums.hint("merge"), list(key), "left")
    wrong = (F.coalesce("n", F.lit(0)) != F.col("width") * F.col("height")) | (F.col("last_r") != F.col("height") - 1) | (F.col("last_c") != F.col("width") - 1)
    errors = texts((~F.col("zoned"), "TIME_WITHOUT_ZONE"), (F.col("valid_to") <= F.col("valid_from"), "EMPTY_INTERVAL"), (F.col("units") != "mm/h", "UNITS_NOT_MM_PER_HOUR"), (wrong, "CELLS_DO_NOT_FILL_GRID"), (F.col("odd") > 0, "RATE_NOT_FINITE"), (F.col("negative") > 0, "RATE_BELOW_ZERO"))
    return both.select(*key, errors.alias("errors")).withColumn("accepted", F.col("errors") == "")


def checked_forecasts(frames: DataFrame, *key: str, leads: tuple[int, ...] = VALID_LEADS) -> DataFrame:
    """Errors of every forecast: the exact set of leads, units, one shape, one reference system and one resolution.

    frames: key, lead_minutes, units, width, height, reference, resolution_m; one row a frame.
    """
    found = frames.groupBy(*key).agg(
        F.array_sort(F.collect_set("lead_minutes")).alias("have"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("units") != "mm/h").alias("units"), F.count_distinct("width", "height").alias("shapes"),
        F.count_distinct("reference").alias("systems"), (F.max("resolution_m") - F.min("resolution_m")).alias("spread"),
    )
    exact = (F.col("have") == F.array(*map(F.lit, leads))) & (F.col("n") == len(leads))
    errors = texts((~exact, "LEADS_DIFFER"), (F.col("units") > 0, "UNITS_NOT_MM_PER_HOUR"), (F.col("shapes") > 1, "SHAPES_DIFFER"), (F.col("systems") > 1, "REFERENCES_DIFFER"), (F.col("spread") > 1e-9, "RESOLUTIONS_DIFFER"))
    return found.select(*key, F.col("n").alias("frames"), errors.alias("errors")).withColumn("accepted", F.col("errors") == "")


def forcing(frames: DataFrame, horizon: int, *key: str, interval: int = INTERVAL) -> DataFrame:
    """Frames of forecasts that drive a run: leads below the horizon, if there are exactly horizon / interval of them."""
    early = frames.where(F.col("lead_minutes") < horizon)
    whole = early.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == horizon // interval).drop("n")
    return early.join(whole.hint("merge"), list(key), "left_semi")


def forecast_intervals(issues: DataFrame, horizon: int, step: int) -> DataFrame:
    """Half-open intervals [issue + lead, issue + lead + step) up to the horizon, which must be a multiple of the step."""
    if step <= 0 or horizon % step:
        raise ValueError("the horizon must be a multiple of the step")
    lead = F.explode(F.sequence(F.lit(0), F.lit(horizon - step), F.lit(step)))
    after = lambda minutes: F.col("issue") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return issues.withColumn("lead_minutes", lead).withColumns({"valid_from": after(F.col("lead_minutes")), "valid_to": after(F.col("lead_minutes") + step)})


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def checked_grids(grids: DataFrame, *key: str) -> DataFrame:
    """Errors of grid descriptions: a projected system, north-up, cell size and bounds that agree with the affine transform, 2 x 2 cells at least.

    grids: key, projected, width, height, cell_m, a, b, c, d, e, f (the affine transform), xmin, ymin, xmax, ymax.
    """
    v = F.col
    errors = texts(
        ((v("width") < 2) | (v("height") < 2), "TOO_FEW_CELLS"), (~v("projected"), "NOT_PROJECTED"), ((v("b") != 0) | (v("d") != 0), "ROTATED"), ((v("a") <= 0) | (v("e") >= 0), "NOT_NORTH_UP"),
        (~close(v("a"), F.abs("e")) | ~close(v("a"), v("cell_m")), "CELL_SIZE_DIFFERS"), ((v("xmin") >= v("xmax")) | (v("ymin") >= v("ymax")), "BOUNDS_REVERSED"),
        (~close(v("c"), v("xmin")) | ~close(v("f"), v("ymax")), "ORIGIN_DIFFERS"),
        (~close(v("xmax") - v("xmin"), v("a") * v("width")) | ~close(v("ymax") - v("ymin"), F.abs("e") * v("height")), "EXTENT_DIFFERS"),
    )
    return grids.select(*key, errors.alias("errors")).withColumn("accepted", v("errors") == "")


def in_domain(points: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Points (x, y) within a box that is padded by 15 % of its larger side, 1,000 m at least."""
    pad = max(1000.0, 0.15 * max(right - left, top - bottom))
    return points.where(F.col("x").between(left - pad, right + pad) & F.col("y").between(bottom - pad, top + pad))


def conditioned(cells: DataFrame, *key: str) -> DataFrame:
    """Elevations z with no-data cells (outside (-100, 9000), null or not finite) set to the grid's least valid one; `filled` marks these.

    A grid without any valid cell keeps nulls.
    """
    valid = (F.col("z") > LEAST_Z) & (F.col("z") < MOST_Z) & ~F.isnan("z")
    least = cells.groupBy(*key).agg(F.min(F.when(valid, F.col("z"))).alias("least"))
    both = cells.join(least.hint("merge"), list(key))
    good = F.coalesce(valid, F.lit(False))
    return both.select(*cells.columns, F.when(good, F.col("z")).otherwise(F.col("least")).alias("z_out"), (~good).alias("filled"))


def conditioning_report(done: DataFrame, *key: str, cell_m2: float = 900.0) -> DataFrame:
    """Per grid: cells, no-data cells, cells changed by more than 1e-9, the change in volume over valid cells, and whether all is no data."""
    change = F.col("z_out") - F.col("z")
    moved = ~F.col("filled") & (F.abs(change) > 1e-9 + 1e-5 * F.abs(F.col("z")))
    return done.groupBy(*key).agg(F.count(F.lit(1)).alias("cells"), F.count_if("filled").alias("nodata_cells"), F.count_if(F.col("filled") | moved).alias("changed_cells"), steady(F.coalesce(F.sum(F.when(~F.col("filled"), change)), F.lit(0.0)) * cell_m2, 3).alias("volume_change_m3"), F.bool_and("filled").alias("all_nodata"))


def cube_leads(cube: DataFrame, *key: str) -> DataFrame:
    """A model cube as rates by lead: minutes since the first step by the unit of time, rates in mm/h, NaN and null as 0, clipped to 0 to 300.

    cube: key, step (time value), time_unit (hours, seconds, or minutes), unit (kg m-2 s-1, m s-1 or mm/h), value.
    """
    first = cube.groupBy(*key).agg(F.min("step").alias("first"))
    both = cube.join(first.hint("merge"), list(key))
    since = F.col("step") - F.col("first")
    minutes = F.when(F.col("time_unit") == "hours", since * 60).when(F.col("time_unit") == "seconds", since / 60).otherwise(since)
    factor = F.when(F.col("unit") == "kg m-2 s-1", 3600.0).when(F.col("unit") == "m s-1", 3600.0 * 1000.0).otherwise(1.0)
    rate = F.when(F.col("value").isNull() | F.isnan("value"), 0.0).otherwise(F.least(F.lit(MOST_RATE), F.greatest(F.lit(0.0), F.col("value") * factor)))
    return both.select(*cube.columns, F.round(minutes).cast("int").alias("lead_minutes"), steady(rate).alias("rate_mmh"))


def tagged_rates(fields: DataFrame) -> DataFrame:
    """The factor that makes a field a rate in mm/h by its unit, or why it is rejected.

    fields: unit, hours (of an accumulation). Rates per second count 3,600 fold and rates per hour once; sums need the hours that they
    were gathered in (metres count 1,000 fold); no unit counts as mm/h; any other unit is rejected.
    """
    unit = F.coalesce(F.col("unit"), F.lit(""))
    sums = unit.isin("mm", "kg m-2", "m", "meter", "metre")
    timed = F.coalesce(F.col("hours") > 0, F.lit(False))
    factor = F.when(unit.isin("kg m-2 s-1", "mm s-1"), 3600.0).when(unit.isin("mm/h", "mm h-1", ""), 1.0).when(sums & timed, F.when(unit.isin("m", "meter", "metre"), 1000.0).otherwise(1.0) / F.col("hours"))
    reason = F.when(sums & ~timed, "ACCUMULATION_WITHOUT_INTERVAL").when(factor.isNull(), "UNSUPPORTED_UNIT")
    return fields.withColumns({"factor": factor, "reason": reason})


def raster_audit(cells: DataFrame, expected_m: float, *key: str, warn: float = 1.5, fail: float = 3.0) -> DataFrame:
    """Errors, warnings and status of elevation rasters: size, resolution against the expected one, no data, values that are not finite.

    cells: key, r, c, z, cell_m, projected. Beyond `fail` times the expected resolution (or below a `fail`-th) is an error, beyond `warn` a warning.
    """
    bad = F.isnan("z") | (F.abs("z") == F.lit(float("inf")))
    found = cells.groupBy(*key).agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.max("cell_m").alias("cell_m"), F.bool_and("projected").alias("projected"), F.count_if(bad).alias("odd"), F.count(F.when(~bad & (F.col("z") > LEAST_Z) & (F.col("z") < MOST_Z), 1)).alias("valid"))
    off = F.greatest(F.col("cell_m") / expected_m, expected_m / F.col("cell_m"))
    errors = texts(((F.col("height") < 2) | (F.col("width") < 2), "raster is smaller than 2 x 2"), (off > fail, "resolution is far from the expected one"), (F.col("valid") == 0, "raster holds no data"), (F.col("odd") > 0, "raster holds values that are not finite"))
    warnings = texts((~F.col("projected"), "reference system differs"), ((off > warn) & (off <= fail), "resolution differs from the expected one"))
    return found.select(*key, "height", "width", "valid", errors.alias("errors"), warnings.alias("warnings")).withColumn("status", F.when(F.col("errors") == "", "VALIDATED").otherwise("BLOCKED"))


def profile_of(name: Column) -> Column:
    """The vehicle profile of a name: trimmed, in any case, by itself or an alias; unknown names count as the default."""
    key = F.upper(F.trim(name))
    known = reduce(lambda out, v: F.when(key == v[0], v[0]).otherwise(out), VEHICLES, F.lit(None).cast("string"))
    other = reduce(lambda out, v: F.when(key == v[0], v[1]).otherwise(out), ALIASES.items(), F.lit(None).cast("string"))
    return F.coalesce(known, other, F.lit(DEFAULT_PROFILE))


def interval_index(lead: Column, interval: int, n: int) -> Column:
    """Which of n rain intervals a lead falls into; the last one goes on."""
    return F.least(F.floor(lead / interval), F.lit(n - 1)).cast("int")


def result_labels(status: Column, classification: Column) -> Column:
    """Three labels as an array: ingestion status, classification, and what the data stand for (NO_DATA, SYNTHETIC or REAL_DATA)."""
    stands = F.when(status.isin("NOT_FETCHED", "BLOCKED"), "NO_DATA").when(classification.isin("SYNTHETIC", "SIMULATED", "FIXTURE"), "SYNTHETIC").otherwise("REAL_DATA")
    return F.array(status, classification, stands)


def readiness(available: DataFrame, required: tuple[str, ...], *key: str) -> DataFrame:
    """Each required attribute of every data set with its availability (MISSING if not named), and whether the set is ready: all PRESENT or DERIVED.

    available: key, attribute, availability.
    """
    wanted = F.explode(F.array(*map(F.lit, required)))
    have = available.groupBy(*key, "attribute").agg(F.min("availability").alias("availability"))
    every = available.select(*key).distinct().withColumn("attribute", wanted).join(have.hint("merge"), [*key, "attribute"], "left").fillna("MISSING", "availability")
    ready = every.groupBy(*key).agg(F.bool_and(F.col("availability").isin("PRESENT", "DERIVED")).alias("ready"))
    return every.join(ready.hint("merge"), list(key))


def known_frames(wanted: DataFrame, inventory: DataFrame, *key: str) -> DataFrame:
    """Wanted frames with UNKNOWN for those that the inventory does not have; callers refuse or report these."""
    have = inventory.select(*key).distinct().withColumn("have", F.lit(True))
    return wanted.join(have.hint("merge"), list(key), "left").select(*wanted.columns, F.when(F.col("have"), "KNOWN").otherwise("UNKNOWN").alias("status"))


def verification_status(cells: DataFrame, *key: str) -> DataFrame:
    """Whether the forecast and the observation of each key can be compared: EVALUATED if both hold the same cells, INSUFFICIENT_DATA if not, NOT_EVALUATED without either.

    cells: key, r, c, f, o (null where a side has no such cell).
    """
    both, any_f, any_o = F.count_if(F.col("f").isNotNull() & F.col("o").isNotNull()), F.count("f"), F.count("o")
    status = F.when((any_f == 0) | (any_o == 0), "NOT_EVALUATED").when((both == any_f) & (both == any_o), "EVALUATED").otherwise("INSUFFICIENT_DATA")
    return cells.groupBy(*key).agg(both.alias("pairs"), status.alias("status"))


def iso_utc(time: Column) -> Column:
    """A UTC time as text, to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_display(time: Column, zone: str = "Asia/Kolkata") -> Column:
    """A UTC time as a local text, to the minute."""
    return F.date_format(F.from_utc_timestamp(time.cast("timestamp"), zone), "yyyy-MM-dd HH:mm")
