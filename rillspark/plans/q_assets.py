"""Queries on critical assets and interventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.policy import PACKAGES, catalog, values
from rillspark.functions.shared import settled
from rillspark.operators import assets, mitigation, roads
from rillspark.plans.q_roads import CELLS_SQL
from rillspark.plans.testbed import view, with_views

PACKAGE_COLUMNS = "package, lid, basin_m3, pump_m3s, unblock"
FRAMES = "SELECT DISTINCT l_returnflag AS scenario_id, CAST((l_linenumber - 1) * 15 AS INT) AS lead_minutes FROM lineitem"


def _road_max(spark, sf, wanted):
    """Deepest water on the wanted roads (road_id), by frame; roads of the same ends share a line."""
    depth, segments = view(spark, sf, "depth"), view(spark, sf, "segment").join(wanted.distinct().hint("merge"), "road_id", "left_semi")
    lines = roads.by_road(roads.road_cells(roads.lines_of(segments)), depth, ("scenario_id",), ("depth_m",), roads.leads_of(depth), lambda d: {"max_depth_m": F.max(d)})
    return roads.for_roads(lines, segments)


def _sites(spark, sf):
    depth = view(spark, sf, "depth")
    return assets.site_depths(view(spark, sf, "asset"), depth, depth.select("scenario_id", "lead_minutes").distinct())


def _access(spark, sf):
    """Assets 3 k are linked with the roads 50 k and 50 (k + 1); others with none."""
    links = view(spark, sf, "asset").where("asset_id % 3 = 0").selectExpr("asset_id", "explode(array(asset_id div 3 * 50, (asset_id div 3 + 1) * 50)) AS road_id")
    return assets.access_depths(_sites(spark, sf), links, _road_max(spark, sf, links.select("road_id")))


def _assessed(spark, sf):
    return assets.assessed(_access(spark, sf))


def _packages(spark):
    return catalog(spark, PACKAGES, PACKAGE_COLUMNS)


def _grids(spark, sf):
    """Scenario R has a counterpart without blockage: scenario N."""
    depth = view(spark, sf, "depth")
    clean = depth.where("scenario_id = 'N'").select(F.lit("R").alias("scenario_id"), "lead_minutes", "r", "c", F.col("depth_m").alias("clean_depth_m"))
    return mitigation.abated(depth, _packages(spark), clean)


def _effects(spark, sf, grids=None):
    """Roads of the same ends share a line: depths are looked up once a line, and the line's roads are counted."""
    grids = settled(_grids(spark, sf), "grids") if grids is None else grids
    segments = view(spark, sf, "segment")
    cells = roads.road_cells(roads.lines_of(segments)).select("road_id", "r", "c")
    worst = roads.by_road(cells, grids, ("scenario_id", "package"), ("base_m", "depth_m"), roads.leads_of(grids), lambda b, d: {"before_m": F.max(b), "after_m": F.max(d)})
    return mitigation.effects(grids, worst.join(roads.line_counts(segments).hint("merge"), "road_id"))


def _priced(spark, sf):
    return mitigation.priced(_effects(spark, sf), _packages(spark))


QUERIES = {
    "j3_site_depths": lambda s, d: _sites(s, d).select("scenario_id", "lead_minutes", "asset_id", "site_depth_m"),
    "j18_access_depths": lambda s, d: _access(s, d).select("scenario_id", "lead_minutes", "asset_id", "access_depth_m"),
    "f35_assessments": _assessed,
    "a32_vulnerability": lambda s, d: assets.rolled_up(_assessed(s, d)),
    "t5_intervention_queue": lambda s, d: assets.intervention_queue(_assessed(s, d)),
    "f34_abated_depths": lambda s, d: _grids(s, d).select("scenario_id", "lead_minutes", "package", "r", "c", roads.steady(F.col("depth_m")).alias("depth_m")),
    "a33_mitigation_effects": _effects,
    "c6_priced_packages": _priced,
    "t7_best_package": lambda s, d: mitigation.best_within(_priced(s, d), 5.0),
}

ASSET_SQL = f"""
frames AS ({FRAMES}),
road_max AS (SELECT scenario_id, lead_minutes, road_id, max(depth_m) AS max_depth_m FROM cells JOIN depth USING (r, c) GROUP BY scenario_id, lead_minutes, road_id),
sites AS (SELECT f.scenario_id, f.lead_minutes, a.*, coalesce(d.depth_m, 0) AS site_depth_m FROM asset a CROSS JOIN frames f LEFT JOIN depth d ON d.scenario_id = f.scenario_id AND d.lead_minutes = f.lead_minutes AND d.r = a.r AND d.c = a.c),
links AS (SELECT asset_id, unnest([asset_id // 3 * 50, (asset_id // 3 + 1) * 50]) AS road_id FROM asset WHERE asset_id % 3 = 0),
worst AS (SELECT scenario_id, lead_minutes, asset_id, max(max_depth_m) AS known FROM links JOIN road_max USING (road_id) GROUP BY scenario_id, lead_minutes, asset_id),
access AS (SELECT s.*, coalesce(known, CASE WHEN site_depth_m > 0.1 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS access_depth_m FROM sites s LEFT JOIN worst USING (scenario_id, lead_minutes, asset_id)),
st AS (SELECT *, CASE WHEN site_depth_m >= failure_depth_m THEN 'CRITICAL_FAILURE' WHEN site_depth_m >= critical_depth_m THEN 'DIRECT_INUNDATION' WHEN access_depth_m >= 0.15 THEN 'ACCESS_IMPAIRED' ELSE 'NORMAL' END AS status FROM access),
sc AS (SELECT *, CASE WHEN status = 'NORMAL' THEN 0 ELSE CAST(0.6 AS DOUBLE) * least(CAST(1 AS DOUBLE), site_depth_m / failure_depth_m) + CAST(0.4 AS DOUBLE) * least(CAST(1 AS DOUBLE), access_depth_m / CAST(0.5 AS DOUBLE)) END AS score,
       printf('%.0f', round(site_depth_m * 100 + 1e-9, 0)) AS s_cm, printf('%.0f', round(access_depth_m * 100 + 1e-9, 0)) AS a_cm FROM st),
assessed AS (SELECT scenario_id, lead_minutes, asset_id, criticality_weight, site_depth_m, access_depth_m, status, round(score + 1e-9, 6) AS vulnerability_score,
  CAST(floor(service_population * CASE status WHEN 'CRITICAL_FAILURE' THEN CAST(1 AS DOUBLE) WHEN 'DIRECT_INUNDATION' THEN CAST(0.8 AS DOUBLE) WHEN 'ACCESS_IMPAIRED' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + 1e-9) AS BIGINT) AS impacted_population,
  round(criticality_weight * score * CASE WHEN status = 'CRITICAL_FAILURE' THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END + 1e-9, 6) AS priority_score,
  CASE status WHEN 'CRITICAL_FAILURE' THEN 'EMERGENCY SHUTDOWN / EVACUATE: Severe inundation (' || s_cm || ' cm) exceeds failure threshold.'
    WHEN 'DIRECT_INUNDATION' THEN 'DEPLOY FLOOD BARRIERS: Site flooded (' || s_cm || ' cm). Deploy mobile dewatering pumps immediately.'
    WHEN 'ACCESS_IMPAIRED' THEN 'TRAFFIC DIVERSION: Facility site is dry (' || s_cm || ' cm) but access road is submerged (' || a_cm || ' cm).'
    ELSE 'CONTINUOUS MONITORING: Facility and ingress corridors remain fully operational.' END AS recommended_action FROM sc)"""
MITIGATION_SQL = f"""
packages AS ({values(PACKAGES, PACKAGE_COLUMNS)}),
b0 AS (SELECT d.scenario_id, d.lead_minutes, d.r, d.c, d.depth_m AS base_m, p.*, n.depth_m AS clean FROM depth d CROSS JOIN packages p
       LEFT JOIN depth n ON d.scenario_id = 'R' AND n.scenario_id = 'N' AND n.lead_minutes = d.lead_minutes AND n.r = d.r AND n.c = d.c),
b1 AS (SELECT *, CASE WHEN unblock AND clean IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), base_m - (greatest(CAST(0 AS DOUBLE), base_m - clean) + CASE WHEN base_m > 0.2 THEN least(base_m, CAST(0.08 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END)) ELSE base_m END AS d1 FROM b0),
b2 AS (SELECT *, greatest(CAST(0 AS DOUBLE), d1 - least(d1, CAST(0.0125 AS DOUBLE) * lid)) AS d2 FROM b1),
b3 AS (SELECT *, count(*) FILTER (d2 >= 0.15) OVER (PARTITION BY scenario_id, lead_minutes, package) AS n2 FROM b2),
b4 AS (SELECT *, CASE WHEN d2 >= 0.15 AND basin_m3 > 0 THEN greatest(CAST(0 AS DOUBLE), d2 - least(d2, basin_m3 / (n2 * CAST(900 AS DOUBLE)))) ELSE d2 END AS d3 FROM b3),
b5 AS (SELECT *, count(*) FILTER (d3 >= 0.10) OVER (PARTITION BY scenario_id, lead_minutes, package) AS n3 FROM b4),
grids AS (SELECT scenario_id, lead_minutes, package, r, c, base_m, CASE WHEN d3 >= 0.10 AND pump_m3s > 0 THEN greatest(CAST(0 AS DOUBLE), d3 - least(d3, pump_m3s * 1800 / (n3 * CAST(900 AS DOUBLE)))) ELSE d3 END AS depth_m FROM b5),
worst AS (SELECT scenario_id, lead_minutes, package, road_id, max(base_m) AS b, max(depth_m) AS a FROM cells JOIN grids USING (r, c) GROUP BY scenario_id, lead_minutes, package, road_id),
shut AS (SELECT scenario_id, lead_minutes, package, count(*) FILTER (b > 0.5) AS impassable_before, count(*) FILTER (b > 0.5 AND NOT a > 0.5) AS reopened_roads FROM worst GROUP BY scenario_id, lead_minutes, package),
sums AS (SELECT scenario_id, lead_minutes, package, max(base_m) AS d0, max(depth_m) AS d1, count(*) FILTER (base_m >= 0.05) * CAST(900 AS DOUBLE) AS a0, count(*) FILTER (depth_m >= 0.05) * CAST(900 AS DOUBLE) AS a1,
                sum(base_m) * 900 AS v0, sum(depth_m) * 900 AS v1 FROM grids GROUP BY scenario_id, lead_minutes, package),
parts AS (SELECT s.*, coalesce(impassable_before, 0) AS impassable_before, coalesce(reopened_roads, 0) AS reopened_roads, CASE WHEN d0 > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), d0 - d1) / d0) ELSE 0 END AS pd,
                 CASE WHEN a0 > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), a0 - a1) / a0) ELSE 0 END AS pa FROM sums s LEFT JOIN shut USING (scenario_id, lead_minutes, package)),
effects AS (SELECT scenario_id, lead_minutes, package, round(greatest(CAST(0 AS DOUBLE), d0 - d1) + 1e-9, 3) AS depth_reduction_m, round(pd * 100 + 1e-9, 1) AS depth_reduction_pct, round(greatest(CAST(0 AS DOUBLE), a0 - a1) + 1e-9, 1) AS area_reduction_m2,
  round(pa * 100 + 1e-9, 1) AS area_reduction_pct, round(greatest(CAST(0 AS DOUBLE), v0 - v1) + 1e-6, 1) AS volume_reduction_m3, impassable_before, reopened_roads,
  round(CAST(0.4 AS DOUBLE) * pd + CAST(0.4 AS DOUBLE) * pa + CAST(0.2 AS DOUBLE) * CASE WHEN impassable_before > 0 THEN CAST(reopened_roads AS DOUBLE) / impassable_before ELSE 1 END + 1e-9, 4) AS effectiveness_index FROM parts),
money AS (SELECT e.*, lid * 100000 * 1800 + basin_m3 * 450 + pump_m3s * 2500000 + CASE WHEN unblock THEN 1500000 ELSE 0 END AS cost, area_reduction_m2 * 1200 + volume_reduction_m3 * 180 + reopened_roads * CAST(2500000 AS DOUBLE) AS gain
          FROM effects e JOIN packages USING (package)),
priced AS (SELECT * EXCLUDE (cost, gain), round(cost + 1e-9, 2) AS capex_inr, round(cost / 1e7 + 1e-9, 3) AS capex_crores, round(gain + 1e-9, 2) AS avoided_losses_inr, round(CASE WHEN cost > 0 THEN gain / cost ELSE 0 END + 1e-9, 4) AS benefit_cost_ratio FROM money)"""
_A = with_views("depth", "segment", "asset") + f",{CELLS_SQL},{ASSET_SQL}"
_M = with_views("depth", "segment") + f",{CELLS_SQL},{MITIGATION_SQL}"
ORACLES = {
    "j3_site_depths": _A + " SELECT scenario_id, lead_minutes, asset_id, site_depth_m FROM sites",
    "j18_access_depths": _A + " SELECT scenario_id, lead_minutes, asset_id, access_depth_m FROM access",
    "f35_assessments": _A + " SELECT * FROM assessed",
    "a32_vulnerability": _A + """
SELECT scenario_id, lead_minutes, count(*) FILTER (status = 'NORMAL') AS normal, count(*) FILTER (status = 'ACCESS_IMPAIRED') AS access_impaired, count(*) FILTER (status = 'DIRECT_INUNDATION') AS direct_inundation,
       count(*) FILTER (status = 'CRITICAL_FAILURE') AS critical_failure, CAST(sum(impacted_population) AS BIGINT) AS exposed_population,
       round(sum(criticality_weight * vulnerability_score) / sum(criticality_weight) * 100 + 1e-9, 4) AS vulnerability_index FROM assessed GROUP BY scenario_id, lead_minutes""",
    "t5_intervention_queue": _A + """
SELECT scenario_id, lead_minutes, CAST(row_number() OVER (PARTITION BY scenario_id, lead_minutes ORDER BY priority_score DESC, asset_id) AS INT) AS rank, asset_id, status, priority_score FROM assessed WHERE status <> 'NORMAL'""",
    "f34_abated_depths": _M + " SELECT scenario_id, lead_minutes, package, r, c, round(depth_m + 1e-9, 6) AS depth_m FROM grids",
    "a33_mitigation_effects": _M + " SELECT * FROM effects",
    "c6_priced_packages": _M + " SELECT * FROM priced",
    "t7_best_package": _M + """,
o AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, lead_minutes ORDER BY capex_crores > 5, benefit_cost_ratio DESC, effectiveness_index DESC, package DESC) AS k FROM priced)
SELECT scenario_id, lead_minutes, coalesce(max(CASE WHEN k = 1 AND capex_crores <= 5 THEN package END), 'NO_FEASIBLE_PACKAGE') AS package, count(*) FILTER (capex_crores <= 5) AS feasible FROM o GROUP BY scenario_id, lead_minutes""",
}
