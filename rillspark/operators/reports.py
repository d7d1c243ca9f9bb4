"""Reports: dossiers of frames, wards with their roads and sites, itemised costs, alert messages, fits of validation, catalogs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.functions.shared import small
from rillspark.operators.mitigation import COSTS, DAMAGES
from rillspark.operators.nowcast import radar_weight
from rillspark.operators.roads import steady
from rillspark.operators.summaries import ward_summary

FRAME = ("scenario_id", "lead_minutes")
# Severity by depth (m) and roads, the balance that counts as closed (per cent), and labels of results by what they are made of.
GRADES = (("EXTREME RED", 0.50, 2, 0), ("SEVERE ORANGE", 0.30, 1, 0), ("MODERATE AMBER", 0.15, 0, 2))
CLOSED_PCT = 0.05
LABELS = {"REAL_TERRAIN_SYNTHETIC_HYDRAULICS": "REAL_TERRAIN+SYNTHETIC_HYDRAULICS", "REAL_TERRAIN_REAL_DRAINAGE": "REAL_TERRAIN+REAL_DRAINAGE_GEOMETRY"}
OTHER_LABEL = "SYNTHETIC"
#: The weight of the spatial term of the loss, and the cap of each of its terms.
SPATIAL, CAP = 0.10, 5.0


def dossiers(depth: DataFrame, impact: DataFrame, ledger: DataFrame, alerts: DataFrame, cell_m: float = 30.0) -> DataFrame:
    """One row a frame: summary, water balance, roads, alert and provenance side by side; every frame at once.

    ledger: runs by scenario, summed up here; alerts: scenario_id, lead_minutes, alert_id, headline, severity, instruction. What a part lacks for a frame is null (or 0 roads). The ids of closed
    roads may be many, so they are a table of their own (`closed_roads`), not a list in a row.
    """
    area = cell_m * cell_m
    flood = depth.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("cells"), F.max("depth_m").alias("max_depth_m"), (F.count_if(F.col("depth_m") > 0.05) * area).alias("flooded_area_m2"), F.round(F.sum("depth_m") * area + 1e-6, 3).alias("surface_storage_m3")
    )
    peak = flood.groupBy("scenario_id").agg(F.max_by("lead_minutes", F.struct(F.col("max_depth_m"), -F.col("lead_minutes"))).alias("peak_lead_minutes"))
    of = lambda name: F.count_if(F.col("classification") == name)
    roads = impact.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("total_roads"), of("IMPASSABLE").alias("impassable_roads"), of("CAUTION").alias("caution_roads"), of("DRY").alias("dry_roads"))
    v = lambda x: F.sum(f"{x}_m3")
    stored = F.sum(F.col("s_s1") - F.col("s_s0") + F.col("s_d1") - F.col("s_d0"))
    left = v("rain") + v("ext_in") - v("losses") - v("surf_out") - v("outfall") - stored
    balance = ledger.groupBy("scenario_id").agg(F.round(v("rain") + 1e-6, 3).alias("rainfall_m3"), F.round(v("outfall") + 1e-6, 3).alias("outfall_m3"), F.round(left + 1e-6, 3).alias("residual_m3"), steady(F.abs(left) / F.greatest(F.abs(v("rain")) + F.abs(v("ext_in")), F.lit(1e-6)) * 100.0, 4).alias("relative_error_pct"))
    said = alerts.select(*FRAME, "alert_id", "headline", F.col("severity").alias("alert_severity"), "instruction")
    both = flood.join(roads.hint("merge"), list(FRAME), "left").join(peak.hint("merge"), "scenario_id").join(balance.hint("merge"), "scenario_id", "left").join(said.hint("merge"), list(FRAME), "left")
    counts = both.fillna(0, ["total_roads", "impassable_roads", "caution_roads", "dry_roads"])
    grade = F.lit("MINOR GREEN")
    for name, deep, shut, slow in reversed(GRADES):
        met = F.col("max_depth_m") >= deep
        met = met | (F.col("impassable_roads") >= shut) if shut else met | (F.col("caution_roads") >= slow)
        grade = F.when(met, name).otherwise(grade)
    share = steady(F.col("flooded_area_m2") / (F.col("cells") * area) * 100.0, 4)
    weight = radar_weight(F.col("lead_minutes"))
    text = F.concat(F.lit("Scenario "), "scenario_id", F.lit(": water up to "), F.format_string("%.2f", steady(F.col("max_depth_m"), 2)), F.lit(" m, "), F.format_string("%.1f", steady(F.col("inundated_pct"), 1)), F.lit("% of the area wet, "), F.col("impassable_roads").cast("string"), F.lit(" roads closed."))
    found = counts.withColumn("inundated_pct", share).withColumns({
        "dossier_id": F.concat_ws("-", F.lit("DOSSIER"), "scenario_id", F.lpad(F.col("lead_minutes").cast("string"), 3, "0")), "severity_level": grade, "summary_text": text,
        "conduit_storage_m3": F.round(F.greatest(F.lit(0.0), F.col("rainfall_m3") - F.col("outfall_m3") - F.col("surface_storage_m3")) + 1e-6, 3), "closed_balance": F.coalesce(F.col("relative_error_pct") < CLOSED_PCT, F.lit(False)),
        "radar_weight_pct": F.round(weight * 100.0, 2), "nwp_weight_pct": F.round((1.0 - weight) * 100.0, 2),
    })
    return found.select(
        "dossier_id", *FRAME, "severity_level", "max_depth_m", "flooded_area_m2", "surface_storage_m3", "inundated_pct", "peak_lead_minutes", "rainfall_m3", "outfall_m3", "conduit_storage_m3", "residual_m3", "relative_error_pct",
        "closed_balance", "total_roads", "impassable_roads", "caution_roads", "dry_roads", "alert_id", "headline", "alert_severity", "instruction", "radar_weight_pct", "nwp_weight_pct", "summary_text",
    )


def closed_roads(impact: DataFrame) -> DataFrame:
    """The ids that a dossier refers to: dossier_id and road_id of every impassable road."""
    return impact.where("classification = 'IMPASSABLE'").select(F.concat_ws("-", F.lit("DOSSIER"), "scenario_id", F.lpad(F.col("lead_minutes").cast("string"), 3, "0")).alias("dossier_id"), "road_id")


def ward_report(depth: DataFrame, road_cells: DataFrame, impact: DataFrame, assets: DataFrame, side: int = 10, cell_m: float = 30.0) -> DataFrame:
    """`ward_summary` with closed and slow roads (each once a ward that it passes), and the names of the sites in more than 0.30 m of water, in order.

    assets: name, r, c. Sites are listed by name: a ward has few.
    """
    ward = lambda x: F.expr(f"CAST({x} div {side} AS INT)")
    keys = [*FRAME, "ward_r", "ward_c"]
    passed = road_cells.select("road_id", ward("r").alias("ward_r"), ward("c").alias("ward_c")).distinct()
    rated = impact.where(F.col("classification").isin("IMPASSABLE", "CAUTION", "HIGH_IMPACT")).select(*FRAME, "road_id", "classification")
    roads = passed.join(rated.hint("merge"), "road_id").groupBy(*keys).agg(F.count_if(F.col("classification") == "IMPASSABLE").alias("impassable_roads"), F.count_if(F.col("classification") != "IMPASSABLE").alias("caution_roads"))
    deep = depth.where("depth_m > 0.30").join(assets.select("name", "r", "c").hint("merge"), ["r", "c"])
    sites = deep.groupBy(*FRAME, ward("r").alias("ward_r"), ward("c").alias("ward_c")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("facilities_at_risk"))
    summary = ward_summary(depth, road_cells, assets, side, cell_m)
    return summary.join(roads.hint("merge"), keys, "left").join(sites.hint("merge"), keys, "left").fillna(0, ["impassable_roads", "caution_roads"]).fillna("", ["facilities_at_risk"])


def itemised(found: DataFrame, packages: DataFrame) -> DataFrame:
    """Each package's costs and avoided losses part by part, in rupees, with totals in crores. found: effects with protected_assets."""
    cost = {
        "lid_cost_inr": F.col("lid") * COSTS["impervious_area_m2"] * COSTS["permeable_m2"], "basin_cost_inr": F.col("basin_m3") * COSTS["basin_m3"], "pump_cost_inr": F.col("pump_m3s") * COSTS["pump_m3s"],
        "desilting_cost_inr": F.when(F.col("unblock"), F.lit(float(COSTS["desilting"]))).otherwise(0.0),
    }
    gain = {
        "property_inr": F.col("area_reduction_m2") * DAMAGES["area_m2"], "volume_inr": F.col("volume_reduction_m3") * DAMAGES["volume_m3"], "traffic_inr": F.col("reopened_roads") * float(DAMAGES["road"]),
        "assets_inr": F.col("protected_assets") * float(DAMAGES["asset"]),
    }
    both = found.join(F.broadcast(packages), "package")  # a handful of packages
    whole = lambda parts: sum(parts.values(), F.lit(0.0))
    return both.select(
        *FRAME, "package", *(steady(x, 2).alias(n) for n, x in (cost | gain).items()), steady(whole(cost), 2).alias("capex_inr"), steady(whole(cost) / 1e7, 3).alias("capex_crores"),
        steady(whole(gain), 2).alias("avoided_inr"), steady(whole(gain) / 1e7, 3).alias("avoided_crores"),
    )


def protected_assets(grids: DataFrame, assets: DataFrame) -> DataFrame:
    """Per frame and package: sites that the base depth reaches to their critical depth and the lowered one does not. grids: base_m and depth_m by cell and package."""
    sites = assets.groupBy("r", "c", "critical_depth_m").agg(F.count(F.lit(1)).alias("sites"))  # alike ones are looked up once
    at = grids.join(sites.hint("merge"), ["r", "c"])
    saved = F.when((F.col("base_m") >= F.col("critical_depth_m")) & (F.col("depth_m") < F.col("critical_depth_m")), F.col("sites"))
    return at.groupBy(*FRAME, "package").agg(F.coalesce(F.sum(saved), F.lit(0)).alias("protected_assets"))


def ring(r0: Column, c0: Column, r1: Column, c1: Column, west: float, north: float, cell_m: float) -> Column:
    """The corners of a box of cells as points of a closed ring in metres, from the north-west clockwise."""
    x, y = lambda c: west + c * cell_m, lambda r: north - r * cell_m
    corner = lambda r, c: F.struct(x(c).alias("x"), y(r).alias("y"))
    return F.array(corner(r0, c0), corner(r0, c1 + 1), corner(r1 + 1, c1 + 1), corner(r1 + 1, c0), corner(r0, c0))


def alert_messages(alerts: DataFrame, sender: str) -> DataFrame:
    """Each alert as one JSON message, its polygon as text (latitude,longitude pairs), and the digest of the message.

    alerts: columns of `alerts.records`, with ring (an array of lon, lat) and parameters (a map). The message holds the same keys in the same order for every alert.
    """
    pairs = F.array_join(F.transform("ring", lambda p: F.concat_ws(",", F.format_string("%.6f", p["lat"]), F.format_string("%.6f", p["lon"]))), " ")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    area = F.struct(F.col("area").alias("area_desc"), pairs.alias("polygon"))
    info = F.struct("headline", "description", "instruction", "urgency", "severity", "certainty", stamp("valid_from").alias("effective"), stamp("expires").alias("expires"), area.alias("area"), F.array_sort(F.transform(F.map_entries("parameters"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))).alias("parameters"))
    message = F.to_json(F.struct(F.col("alert_id").alias("identifier"), F.lit(sender).alias("sender"), stamp("valid_from").alias("sent"), "status", F.lit("Alert").alias("msg_type"), F.lit("Public").alias("scope"), F.array(info).alias("info")))
    return alerts.select("alert_id", pairs.alias("polygon"), message.alias("message")).withColumn("digest", F.sha2("message", 256))


def validation_fit(pairs: DataFrame, *by: str) -> DataFrame:
    """Efficiencies of validation (4 digits) of s against o, with deviations of the whole set: nse, kge, r, alpha, beta.

    Equal series (to 1e-6 and 1e-5 of the observed) have 1 throughout. Of observations that do not vary, nse is 1 if they are met and minus infinity if not, alpha 0. A mean of zero has
    beta 1 if it is met, else the simulated mean if that is above 0, else 0.
    """
    s, o = F.col("s"), F.col("o")
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("ms"), F.avg(o).alias("mo"), F.stddev_pop(s).alias("ds"), F.stddev_pop(o).alias("do"), F.covar_pop(s, o).alias("cov"), F.sum((s - o) * (s - o)).alias("sse"),
        F.bool_and(F.abs(s - o) <= 1e-6 + 1e-5 * F.abs(o)).alias("equal"),
    )
    c = F.col
    spread = c("do") * c("do") * c("n")
    nse = F.when(spread <= 1e-12, F.when(c("sse") <= 1e-12, F.lit(1.0)).otherwise(F.lit(float("-inf")))).otherwise(1.0 - c("sse") / spread)
    r = F.when((c("ds") > 1e-12) & (c("do") > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("cov") / (c("ds") * c("do"))))).otherwise(0.0)
    alpha = F.when(c("do") > 1e-12, c("ds") / c("do")).otherwise(0.0)
    beta = F.when(F.abs(c("mo")) > 1e-12, c("ms") / c("mo")).when(F.abs(c("ms") - c("mo")) <= 1e-6, 1.0).when(c("ms") > 0, c("ms")).otherwise(0.0)
    one = lambda x: F.when(c("equal"), 1.0).otherwise(x)
    found = sums.withColumns({"nse": nse, "r": one(r), "alpha": one(alpha), "beta": one(beta)})
    kge = 1.0 - F.sqrt((c("r") - 1) * (c("r") - 1) + (c("alpha") - 1) * (c("alpha") - 1) + (c("beta") - 1) * (c("beta") - 1))
    rounded = lambda x: F.when(F.abs(x) == F.lit(float("inf")), x).otherwise(steady(x, 4))
    return found.withColumn("kge", one(kge)).select(*by, "n", *(rounded(c(x)).alias(x) for x in ("nse", "kge", "r", "alpha", "beta")))


def with_spatial_loss(fits: DataFrame, spatial: DataFrame, *by: str) -> DataFrame:
    """`fits` of hydrographs with the loss that also counts depths: fits without a spatial comparison keep theirs, whose weights add up to 1.

    spatial: by, spatial_rmse, max_observed.
    """
    term = F.least(F.lit(CAP), F.col("spatial_rmse") / F.greatest(F.col("max_observed"), F.lit(0.01)))
    loss = F.when(F.col("spatial_rmse").isNull(), F.col("loss")).otherwise(F.col("loss") * (1.0 - SPATIAL) + SPATIAL * term)
    return fits.join(spatial.hint("merge"), list(by), "left").select(*fits.columns, steady(F.col("spatial_rmse")).alias("spatial_rmse"), steady(loss).alias("composite_loss"))


def blend_statistics(blended: DataFrame) -> DataFrame:
    """Per lead and mode of blending: cells, least, largest and mean rate."""
    return blended.groupBy("lead_minutes", "blending_mode").agg(F.count(F.lit(1)).alias("cells"), steady(F.min("rate_mmh")).alias("min_mmh"), steady(F.max("rate_mmh")).alias("max_mmh"), steady(F.avg("rate_mmh")).alias("mean_mmh"))


def acceptance(frames: DataFrame, balances: DataFrame) -> DataFrame:
    """Per scenario: whether its frames are accepted, whether its runs' balances hold, and both. frames: accepted by scenario; balances: overall_status by scenario."""
    both = frames.select("scenario_id", F.col("accepted").alias("frames_accepted")).join(balances.select("scenario_id", "overall_status").hint("merge"), "scenario_id", "full")
    fine = F.coalesce("frames_accepted", F.lit(False)) & F.coalesce(F.col("overall_status") == "pass", F.lit(False))
    return both.select("scenario_id", F.coalesce("frames_accepted", F.lit(False)).alias("frames_accepted"), F.coalesce("overall_status", F.lit("missing")).alias("balance_status"), fine.alias("accepted"))


def unresolved_types(entities: DataFrame, features: DataFrame) -> DataFrame:
    """Source types without a rule among the features that were kept, and how many there are; a blank one is `<empty type>`."""
    name = F.coalesce(F.when(F.trim("source_type") != "", F.col("source_type")), F.lit("<empty type>"))
    kept = entities.where("status = 'UNRESOLVED_TYPE'").select("ord").join(features.select("ord", name.alias("source_type")).hint("merge"), "ord")
    return kept.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


def first_features(features: DataFrame, most: int, order: str, *by: str) -> DataFrame:
    """The first `most` features of each group, in order (a report of the first ones). Ranks are cut in each task before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return features.withColumn("place", place).where(F.col("place") <= most)


def in_boxes(points: DataFrame, cities: DataFrame) -> DataFrame:
    """`points` (x, y) with the city whose box holds them; of several, the first by id; none: left out. cities: city_id, west, south, east, north (few rows, counted)."""
    box = F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))
    held = points.join(small(cities), box)
    columns = [c for c in points.columns]
    return held.groupBy(*columns).agg(F.min("city_id").alias("city_id"))


def united(*catalogs: tuple[str, DataFrame]) -> DataFrame:
    """Catalogs of sites one below the other, each row with the catalog's name: catalog, site_id, name, x, y."""
    parts = [df.select(F.lit(name).alias("catalog"), F.col("site_id").cast("string").alias("site_id"), "name", "x", "y") for name, df in catalogs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def labelled(runs: DataFrame, crs_source: str, mode: str = "mode", crs: str = "crs") -> DataFrame:
    """`runs` with the label of their mode, and where their reference system is from: in the file, from outside, or not known."""
    label = F.lit(OTHER_LABEL)
    for name, text in LABELS.items():
        label = F.when(F.upper(F.trim(F.col(mode))) == name, text).otherwise(label)
    origin = F.when(F.coalesce(F.trim(F.col(crs)), F.lit("")) != "", "EMBEDDED").when(F.coalesce(F.trim(F.col(crs_source)), F.lit("")) != "", "AUTHORITATIVE_EXTERNAL").otherwise("UNVERIFIED")
    return runs.withColumns({"content_label": label, "crs_provenance": origin})
