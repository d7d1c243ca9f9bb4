"""Rain and depth fields: storm cells, ponding indices, forecast steps by lead, one-minute frames, unified nowcasts, fused feeds, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.nowcast import gradients, radar_weight
from rillspark.operators.roads import steady

# Tides in metres that count where none is given, and beyond which there is a surge.
USUAL_TIDE, SURGE_TIDE = 0.40, 2.5
# Parameters of the two ponding indices.
INFILTRATION_MMH, DRAIN_MMH = 12.0, 25.0


def moving_cell(cells: DataFrame, frames: DataFrame, height: int, width: int) -> DataFrame:
    """A Gaussian rain cell whose centre moves linearly with the lead (to 180 min), clipped to 0 to 120 mm/h.

    frames: lead_minutes and rate_mmh of each (a short list); cells: r, c.
    """
    every = cells.crossJoin(F.broadcast(frames))
    part = F.col("lead_minutes") / 180.0
    dx = (F.col("c") - width * (0.35 + 0.3 * part)) / (width * 0.28)
    dy = (F.col("r") - height * (0.30 + 0.4 * part)) / (height * 0.28)
    rate = F.col("rate_mmh") * F.exp(-0.5 * (dx * dx + dy * dy))
    return every.select("lead_minutes", "r", "c", steady(F.least(F.lit(120.0), F.greatest(F.lit(0.0), rate)), 2).alias("rate_mmh"))


def convective_cell(cells: DataFrame, intervals: DataFrame, height: int, width: int, sigma: float = 0.1) -> DataFrame:
    """A base of 0.6 of the rate and a Gaussian cell of 2.5 of it that drifts eastwards with the interval's number; without random texture.

    intervals: place (number), rate_mmh; cells: r, c.
    """
    every = cells.crossJoin(F.broadcast(intervals))
    x, y = F.col("c") / float(width - 1), F.col("r") / float(height - 1)
    cx, cy = 0.25 + 0.05 * F.col("place"), 0.45 + 0.03 * F.sin(F.col("place") * 0.9)
    cell = 2.5 * F.col("rate_mmh") * F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * sigma * sigma))
    return every.select("place", "r", "c", steady(F.greatest(F.lit(0.0), 0.6 * F.col("rate_mmh") + cell)).alias("rate_mmh"))


def topographic_ponding(dem: DataFrame, frames: DataFrame) -> DataFrame:
    """A screening depth from elevation only: runoff of the rain so far, gathered below the 35th percentile of the elevation, with a surcharge where it is lowest.

    dem: r, c, z, land (1 is land); frames: scenario_id, lead_minutes, rate_mmh, surcharge_m (0 for none). Depths below 1 mm are 0. Not hydraulics.
    """
    good = (F.col("land") == 1) & ~F.isnan("z") & (F.abs("z") < F.lit(float("inf"))) & (F.col("z") > -50)
    levels = dem.where(good).agg(F.percentile("z", F.array(F.lit(0.05), F.lit(0.35))).alias("p"), F.count(F.lit(1)).alias("n"))
    levels = levels.select(F.when(F.col("n") > 50, F.col("p")[0]).otherwise(0.0).alias("low"), F.when(F.col("n") > 50, F.col("p")[1]).otherwise(15.0).alias("middle"))
    every = dem.crossJoin(F.broadcast(levels)).crossJoin(F.broadcast(frames))
    lead, hours, half = F.col("lead_minutes"), F.col("lead_minutes") / 60.0, 1.5707963267948966
    early = F.greatest(F.lit(0.20), F.sin(F.greatest(F.lit(0.10), lead / 90.0 * half)))
    late = F.greatest(F.lit(0.25), F.cos(F.least(F.lit(half), (lead - 90.0) / 90.0 * half)))
    runoff = F.when(lead == 0, 0.0).otherwise(F.least(F.lit(0.92), 0.28 + 0.64 * F.tanh(hours * 1.5)))
    net = F.col("rate_mmh") * hours * F.when(lead <= 90, early).otherwise(late) / 1000.0 * runoff
    eta = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("middle") - F.col("z")) / F.greatest(F.lit(1.0), F.col("middle") - F.col("low"))))
    over = F.when((lead > 0) & (F.col("eta") > 0.45), F.col("surcharge_m") * F.tanh(hours * 2.2) * (F.col("eta") - 0.45) / 0.55).otherwise(0.0)
    found = every.withColumn("eta", eta).withColumn("d", net * (0.05 + 2.6 * F.pow("eta", F.lit(1.4))) + over)
    depth = F.when(~good | (F.col("d") < 0.001), 0.0).otherwise(F.col("d"))
    return found.select("scenario_id", "lead_minutes", "r", "c", steady(depth, 4).alias("depth_m"))


def city_ponding(dem: DataFrame, frames: DataFrame, half: int = 15) -> DataFrame:
    """`lowland_ponding` with the slope of the ground itself, on land only, and with the surcharge of a culvert in the middle of the grid.

    dem: r, c, z, land of a dense grid; frames: as for lowland_ponding, with culvert_m (depth that a box of `half` cells each way has more at the peak, 0 for none).
    """
    steep = gradients(dem.withColumn("frame", F.lit(0)), "z").withColumn("slope", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    size = dem.agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))  # one row
    lead = F.col("lead_minutes")
    factor = F.when(lead <= 90, F.sin(lead / 90.0 * 1.5707963267948966)).otherwise(F.exp(-(lead - 90.0) / 45.0))
    pond = lowland_ponding(steep.select("r", "c", "z", "slope"), frames)
    cells = pond.join(dem.select("r", "c", "land").hint("merge"), ["r", "c"]).join(F.broadcast(frames.select("scenario_id", "lead_minutes", "culvert_m")), ["scenario_id", "lead_minutes"]).crossJoin(F.broadcast(size))
    middle = lambda x, n: (F.col(x) >= F.floor(F.col(n) / 2) - half) & (F.col(x) < F.floor(F.col(n) / 2) + half)
    more = F.when(middle("r", "h") & middle("c", "w"), F.col("culvert_m") * factor).otherwise(0.0)
    return cells.select("scenario_id", "lead_minutes", "r", "c", steady(F.when(F.col("land") == 1, F.greatest(F.lit(0.0), F.col("depth_m") + more)).otherwise(0.0), 5).alias("depth_m"))


def lowland_ponding(dem: DataFrame, frames: DataFrame) -> DataFrame:
    """A screening depth from slope and height: excess rain over infiltration and drains, gathered on flat and low ground.

    dem: r, c, z, slope (of z, a cell a unit); frames: scenario_id, lead_minutes, rate_mmh (at the peak), drained (share of the drains that works).
    """
    ends = dem.agg(F.max("z").alias("high"), (F.max("z") - F.min("z")).alias("span"))
    every = dem.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(frames))
    lead = F.col("lead_minutes")
    factor = F.when(lead <= 90, F.sin(lead / 90.0 * 1.5707963267948966)).otherwise(F.exp(-(lead - 90.0) / 45.0))
    excess = F.greatest(F.lit(0.0), F.col("rate_mmh") * factor - (INFILTRATION_MMH + DRAIN_MMH * F.col("drained")))
    low = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("high") - F.col("z")) / F.greatest(F.col("span"), F.lit(1.0))))
    depth = excess / 1000.0 * (lead / 60.0) * (0.6 * F.exp(-8.0 * F.col("slope")) + 1.4 * F.pow(low, F.lit(1.8)))
    return every.select("scenario_id", "lead_minutes", "r", "c", steady(depth).alias("depth_m"))


def nearest_step(wanted: DataFrame, steps: DataFrame, *key: str) -> DataFrame:
    """For each wanted lead the forecast step of the nearest lead; ties go to the smaller. steps: key, step_minutes: a few a key."""
    both = wanted.join(steps.hint("merge"), list(key)) if key else wanted.crossJoin(F.broadcast(steps))
    best = F.min(F.struct(F.abs(F.col("lead_minutes") - F.col("step_minutes")).alias("gap"), F.col("step_minutes")))
    return both.groupBy(*key, "lead_minutes").agg(best.alias("b")).select(*key, "lead_minutes", F.col("b.step_minutes").alias("step_minutes"), F.col("b.gap").alias("gap_minutes"))


def floor_intervals(times: DataFrame, series: DataFrame, minutes: int, *key: str) -> DataFrame:
    """For each time the interval that it falls into, from the start of its series, kept within the first and the last.

    times: key, t; series: key, start, n (how many intervals).
    """
    both = times.join(series.hint("merge"), list(key))
    k = F.floor((F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / (minutes * 6e7))
    place = F.greatest(F.lit(0), F.least(F.col("n").cast("long") - 1, k)).cast("int")
    return both.select(*times.columns, place.alias("place")).withColumn("interval_seconds", (F.col("place") * minutes * 60).cast("long"))


def minute_frames(metrics: DataFrame, leads: DataFrame, step: int = 5) -> DataFrame:
    """Frame metrics at every lead between key frames `step` minutes apart, and which key frame gives the road impacts (the lower below half way).

    metrics: scenario_id, lead_minutes, max_depth_m, flooded_area_m2, storage_m3; leads: lead_minutes (a short list). Where one side is missing, the
    other is taken as it is.
    """
    asked = metrics.select("scenario_id").distinct().crossJoin(F.broadcast(leads)).withColumn("low", (F.floor(F.col("lead_minutes") / step) * step).cast("int")).withColumn("high", F.col("low") + step)
    names = ("max_depth_m", "flooded_area_m2", "storage_m3")
    side = lambda k: metrics.select("scenario_id", F.col("lead_minutes").alias(k), *(F.col(x).alias(f"{k}_{x}") for x in names), F.lit(True).alias(f"has_{k}"))
    both = asked.join(side("low").hint("merge"), ["scenario_id", "low"], "left").join(side("high").hint("merge"), ["scenario_id", "high"], "left").where("has_low OR has_high")
    alpha = (F.col("lead_minutes") - F.col("low")) / float(step)
    mixed = lambda x: F.when(F.col("lead_minutes") == F.col("low"), F.col(f"low_{x}")).otherwise(F.coalesce(F.col(f"low_{x}") * (1 - alpha) + F.col(f"high_{x}") * alpha, F.col(f"low_{x}"), F.col(f"high_{x}")))
    roads = F.when(F.col("has_low").isNull(), F.col("high")).when(F.col("has_high").isNull() | (alpha < 0.5), F.col("low")).otherwise(F.col("high"))
    return both.select("scenario_id", "lead_minutes", steady(mixed("max_depth_m")).alias("max_depth_m"), F.round(mixed("flooded_area_m2") + 1e-9, 0).alias("flooded_area_m2"), steady(mixed("storage_m3"), 3).alias("storage_m3"), roads.alias("road_lead_minutes"))


def unified(advected: DataFrame, observed: DataFrame, leads: DataFrame) -> DataFrame:
    """The unified nowcast: advection to 30 minutes; then advection and the observation's mean by the blend weights; where advection has no such lead, the observation.

    advected: lead_minutes, r, c, rate_mmh; observed: r, c, rate_mmh; leads: lead_minutes (a short list).
    """
    mean = observed.agg(F.avg("rate_mmh").alias("mean"))
    every = observed.withColumnRenamed("rate_mmh", "now").crossJoin(F.broadcast(leads)).crossJoin(F.broadcast(mean))
    both = every.join(advected.hint("merge"), ["lead_minutes", "r", "c"], "left")
    w = radar_weight(F.col("lead_minutes"))
    mixed = F.when((F.col("lead_minutes") > 30) & (w < 1), w * F.col("rate_mmh") + (1 - w) * F.col("mean")).otherwise(F.col("rate_mmh"))
    return both.select("lead_minutes", "r", "c", steady(F.greatest(F.lit(0.0), F.coalesce(mixed, F.col("now")))).alias("rate_mmh"))


def dispatched_methods(requests: DataFrame, nowcasts: DataFrame, default: str = "persistence", methods: tuple[str, ...] = ()) -> DataFrame:
    """The cells of the nowcast that each request names; a name that no nowcast has gets the default method.

    requests: request, method (a short list); nowcasts: method, lead_minutes, r, c, rate_mmh; methods: the methods of the nowcasts, which are worked out once more if these are not given.
    """
    named = requests.sparkSession.createDataFrame([(m,) for m in methods], "method string") if methods else nowcasts.select("method").distinct()
    known = named.withColumn("known", F.lit(True))
    chosen = requests.join(F.broadcast(known), "method", "left").select("request", F.when(F.col("known"), F.col("method")).otherwise(default).alias("method"))
    return nowcasts.join(F.broadcast(chosen), "method").select("request", "method", "lead_minutes", "r", "c", "rate_mmh")


def fused(weather: DataFrame, satellite: DataFrame, tide: DataFrame, river: DataFrame, *key: str) -> DataFrame:
    """One row a key of `weather`: the mean of both rain rates (0 where one is missing), tide with surge flag, and discharge.

    weather, satellite: key, rate_mmh; tide: key, tide_m; river: key, discharge_cms; one row a key each.
    """
    both = weather.withColumnRenamed("rate_mmh", "w").join(satellite.withColumnRenamed("rate_mmh", "s").hint("merge"), list(key), "left").join(tide.hint("merge"), list(key), "left").join(river.hint("merge"), list(key), "left")
    mean = (F.coalesce("w", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))) / 2
    level = F.coalesce("tide_m", F.lit(USUAL_TIDE))
    return both.select(*key, steady(mean).alias("fused_rate_mmh"), level.alias("tide_m"), (level > SURGE_TIDE).alias("surge"), F.coalesce("discharge_cms", F.lit(0.0)).alias("discharge_cms"))


def increments(series: DataFrame, *key: str) -> DataFrame:
    """Depth of each step from cumulative ones. series: key, step, cumulative_mm."""
    return series.withColumn("depth_mm", steady(F.col("cumulative_mm") - F.lag("cumulative_mm", 1, 0.0).over(Window.partitionBy(*key).orderBy("step"))))


def trapezoid_volumes(series: DataFrame, seconds: float, *key: str) -> DataFrame:
    """Volume of each step of a rate (m3/s) by trapezoids, the rate before the first step being 0, and the sum so far. series: key, step, rate."""
    w = Window.partitionBy(*key).orderBy("step")
    each = series.withColumn("v", (F.col("rate") + F.lag("rate", 1, 0.0).over(w)) / 2 * seconds)
    return each.select(*key, "step", steady(F.col("v"), 3).alias("volume_m3"), steady(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("total_m3"))


def blocked_diameter(diameter: Column, blockage: Column) -> Column:
    """The diameter that carries what is left of a full pipe's capacity: D * max(0.01, 1 - blockage) ** (3 / 8), blockage within 0 and 0.95."""
    left = F.greatest(F.lit(0.01), 1.0 - F.least(F.lit(0.95), F.greatest(F.lit(0.0), blockage)))
    return diameter * F.pow(left, F.lit(3.0 / 8.0))


def clipped(value: Column, least: Column, most: Column, default: Column) -> Column:
    """A parameter within its bounds; the default where it is null or not finite."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(odd, default).otherwise(F.greatest(least, F.least(most, value)))


def normalised(value: Column, least: Column, most: Column, default: Column) -> Column:
    """A parameter's place between its bounds, 0 to 1; 0.5 where they are equal."""
    return F.when(most - least <= 1e-12, 0.5).otherwise((clipped(value, least, most, default) - least) / (most - least))


def denormalised(place: Column, least: Column, most: Column) -> Column:
    return least + F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)) * (most - least)


def random_sweep(candidates: DataFrame, parameters: DataFrame, seed: int = 20260825) -> DataFrame:
    """A uniform point for every candidate: a hash of the seed, the candidate and the parameter, so the same on every run.

    candidates: candidate; parameters: name, least, most (a short list).
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "candidate", "name"), F.lit(1 << 40)) / float(1 << 40)
    return candidates.crossJoin(F.broadcast(parameters)).select("candidate", "name", u.alias("place"), denormalised(u, F.col("least"), F.col("most")).alias("value"))


def custom_hyetographs(rates: DataFrame, minutes: int, *key: str) -> DataFrame:
    """Totals of given rates: steps, duration, total depth and peak, of rates that are not below 0 and rounded to 2 digits, and an id that tells them.

    rates: key, rate_mmh.
    """
    clean = rates.withColumn("x", F.round(F.greatest(F.lit(0.0), F.coalesce("rate_mmh", F.lit(0.0))), 2))
    sums = clean.groupBy(*key).agg(F.count(F.lit(1)).alias("steps"), (F.sum(F.round(F.col("x") * 100).cast("long")) / 100.0 * (minutes / 60.0)).alias("total"), F.max("x").alias("peak_mmh"))
    name = F.concat(F.lit("P_CUSTOM_"), F.floor("total").cast("string"), F.lit("MM_"), F.col("steps").cast("string"), F.lit("STEPS"))
    return sums.select(*key, name.alias("profile_id"), "steps", (F.col("steps") * minutes).alias("duration_minutes"), steady(F.col("total"), 2).alias("total_mm"), "peak_mmh")
