"""Queries on routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.policy import VEHICLES, catalog, class_sql, values
from rillspark.operators import graph
from rillspark.operators.roads import steady
from rillspark.plans.testbed import view, with_views

VEHICLE_COLUMNS = "vehicle, deepest, speed, least"
#: Rounds of relaxation that the SQL unrolls; best paths of the test graph at sf0.01 have fewer edges. Soft routes have more, so they have no SQL (see the tests).
ROUNDS = 24
EDGE_DEPTH = "CAST((n1 * 7 + n2 * 7 + n1 * n2) % 71 AS DOUBLE) / CAST(100 AS DOUBLE)"
#: Wading limits in metres of the profiles of city routing, and the speed in km/h that travel times are given at.
SOFT_LIMITS = (("LIGHT_VEHICLE", 0.10), ("SUV", 0.30), ("RESCUE_4X4", 0.60), ("AMBULANCE", 0.20))


def edges_all(spark, sf):
    """Edges with an id, a speed and a depth (the same both ways)."""
    plain = view(spark, sf, "graph_edge").selectExpr("n1", "n2", "n1 * 1000000 + n2 AS road_id", "length_m", "CAST(30 + 10 * ((n1 + n2) % 3) AS DOUBLE) AS speed_kmh", f"{EDGE_DEPTH} AS depth_m")
    return graph.both_ways(plain.repartition(spark.sparkContext.defaultParallelism))  # a row becomes many, and the table is a small file


def directed(edges):
    return edges.select("n1", "n2", "road_id", graph.travel_ms(F.col("length_m"), F.col("speed_kmh")).alias("travel_ms"))


def shelters(spark, sf):
    """A shelter at every twentieth junction."""
    return view(spark, sf, "graph_edge").selectExpr("explode(array(n1, n2)) AS node").distinct().where("node % 20 = 7").selectExpr("node", "concat('S', node) AS shelter")


def origins(spark, sf, modes):
    """Every depot in every mode (modes: of edges)."""
    return view(spark, sf, "depot").withColumnRenamed("node", "origin").crossJoin(F.broadcast(modes))


def _modes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "mode string")


def _searches(spark, sf):
    return graph.flood_costs(edges_all(spark, sf)), origins(spark, sf, _modes(spark, "baseline", "avoid_impassable", "flood_aware"))


def _paths(spark, sf):
    return graph.shortest_paths(*_searches(spark, sf), text=True)


def _both_searches(spark, sf):
    """Edges and origins of the two modes that are compared."""
    edges = graph.flood_costs(edges_all(spark, sf)).where(F.col("mode").isin("baseline", "flood_aware"))
    return edges, origins(spark, sf, _modes(spark, "baseline", "flood_aware"))


def _vehicle_paths(spark, sf, *without):
    edges = graph.vehicle_costs(edges_all(spark, sf), catalog(spark, VEHICLES, VEHICLE_COLUMNS))
    return graph.shortest_paths(edges, origins(spark, sf, _modes(spark, *(v[0] for v in VEHICLES))), *without)


def _cutoffs(spark, sf):
    """Water rises by 0.1 m an hour: leads 0, 60, 120."""
    leads = spark.sql("SELECT CAST(id * 60 AS INT) AS lead_minutes FROM range(0, 3)")
    rising = edges_all(spark, sf).crossJoin(F.broadcast(leads)).withColumn("depth_m", F.col("depth_m") + F.col("lead_minutes") / 600.0)
    edges = graph.vehicle_costs(rising, catalog(spark, VEHICLES[1:4], VEHICLE_COLUMNS))
    modes = {(v[0], lead): 3 * k + i for k, v in enumerate(VEHICLES[1:4]) for i, lead in enumerate((0, 60, 120))}
    depots = view(spark, sf, "depot")
    found = graph.components(edges, depots, [f"{vehicle}@{lead}" for vehicle, lead in modes])
    return graph.component_cutoffs(found, depots.withColumnRenamed("node", "origin"), modes)


def _soft_paths(spark, sf):
    timed = edges_all(spark, sf).withColumn("time_s", F.col("length_m") / (F.col("speed_kmh") / 3.6))
    edges = graph.soft_costs(timed, catalog(spark, SOFT_LIMITS, "profile, limit_m"))
    return graph.shortest_paths(edges, origins(spark, sf, _modes(spark, *(p for p, _ in SOFT_LIMITS))), "path").join(F.broadcast(catalog(spark, SOFT_LIMITS, "profile, limit_m")), F.col("mode") == F.col("profile"))


QUERIES = {
    "g1_directed_edges": lambda s, d: directed(edges_all(s, d)),
    "g2_shortest_paths": lambda s, d: _paths(s, d).select("mode", "origin", "node", "cost_ms", "hops", "path"),
    "g4_compared_routes": lambda s, d: graph.searched_routes(*_both_searches(s, d)),
    "g5_vehicle_routes": lambda s, d: _vehicle_paths(s, d, "path").select("mode", "origin", "node", "cost_ms", "hops", "max_depth_m"),
    "g6_cutoffs": _cutoffs,
    "g7_nearest_shelter": lambda s, d: graph.nearest_shelter(graph.least_costs(*_searches(s, d)), shelters(s, d)),
    "g8_soft_routes": lambda s, d: _soft_paths(s, d).select("mode", "origin", "node", "cost_ms", steady(F.col("length_m"), 1).alias("length_m"), steady(F.col("length_m") / (35.0 * 1000.0 / 3600.0), 1).alias("travel_time_s"), steady(F.col("max_depth_m"), 3).alias("max_flood_depth_m"), (F.col("max_depth_m") <= F.col("limit_m")).alias("is_passable")),
    "j21_avoided_roads": lambda s, d: graph.searched_avoided(*_both_searches(s, d)),
}

EDGES_SQL = f"""
one AS (SELECT n1, n2, n1 * 1000000 + n2 AS road_id, length_m, CAST(30 + 10 * ((n1 + n2) % 3) AS DOUBLE) AS speed_kmh, {EDGE_DEPTH} AS depth_m FROM graph_edge),
edges AS (SELECT * FROM one UNION ALL SELECT n2 AS n1, n1 AS n2, road_id, length_m, speed_kmh, depth_m FROM one)"""
MODES_SQL = """
priced AS (
  SELECT n1, n2, 'baseline' AS mode, CAST(round(1000 * length_m / (speed_kmh / CAST(3.6 AS DOUBLE))) AS BIGINT) AS cost_ms, length_m, depth_m FROM edges
  UNION ALL SELECT n1, n2, 'avoid_impassable', CAST(round(1000 * length_m / (speed_kmh / CAST(3.6 AS DOUBLE))) AS BIGINT), length_m, depth_m FROM edges WHERE depth_m <= 0.5
  UNION ALL SELECT n1, n2, 'flood_aware', CAST(round(1000 * length_m / (speed_kmh * CASE WHEN depth_m <= 0.05 THEN CAST(1 AS DOUBLE) WHEN depth_m <= 0.15 THEN CAST(0.7 AS DOUBLE)
    WHEN depth_m <= 0.3 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END / CAST(3.6 AS DOUBLE))) AS BIGINT), length_m, depth_m FROM edges WHERE depth_m <= 0.5)"""
SPEED_SQL = "greatest(CAST(0.36 AS DOUBLE), CASE WHEN depth_m <= 0.01 THEN speed ELSE speed * greatest(least, 1 - depth_m / deepest * (1 - least)) END)"
VEHICLE_SQL = f"""
vehicles AS ({values(VEHICLES, VEHICLE_COLUMNS)}),
priced AS (SELECT n1, n2, vehicle AS mode, CAST(round(1000 * length_m / ({SPEED_SQL} / CAST(3.6 AS DOUBLE))) AS BIGINT) AS cost_ms, length_m, depth_m FROM edges CROSS JOIN vehicles WHERE depth_m <= deepest)"""


def relaxed(rounds: int = ROUNDS) -> str:
    """Rounds of relaxation; a label is one text: cost, hops, path, length and depth, so that its minimum is the best path."""
    text = "lpad(CAST({c} AS VARCHAR), 12, '0') || '|' || lpad(CAST({h} AS VARCHAR), 4, '0') || '|' || {p} || '|' || CAST({l} AS VARCHAR) || '|' || CAST({d} AS VARCHAR)"
    start = text.format(c="0", h="0", p="lpad(CAST(node AS VARCHAR), 12, '0')", l="CAST(0 AS DOUBLE)", d="CAST(0 AS DOUBLE)")
    out = [f"p0 AS MATERIALIZED (SELECT mode, node AS origin, node, {start} AS label FROM depot CROSS JOIN (SELECT DISTINCT mode FROM priced))"]
    for k in range(1, rounds + 1):
        part = lambda n: f"split_part(p.label, '|', {n})"
        longer = text.format(c=f"(CAST({part(1)} AS BIGINT) + e.cost_ms)", h=f"(CAST({part(2)} AS INT) + 1)", p=f"{part(3)} || '>' || lpad(CAST(e.n2 AS VARCHAR), 12, '0')", l=f"(CAST({part(4)} AS DOUBLE) + e.length_m)", d=f"greatest(CAST({part(5)} AS DOUBLE), e.depth_m)")
        out.append(f"p{k} AS MATERIALIZED (SELECT mode, origin, node, min(label) AS label FROM (SELECT * FROM p{k - 1} UNION ALL SELECT p.mode, p.origin, e.n2 AS node, {longer} AS label FROM p{k - 1} p JOIN priced e ON e.mode = p.mode AND e.n1 = p.node) GROUP BY mode, origin, node)")
    plain = "array_to_string(list_transform(string_split(split_part(label, '|', 3), '>'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), '>')"
    out.append(f"paths AS MATERIALIZED (SELECT mode, origin, node, CAST(split_part(label, '|', 1) AS BIGINT) AS cost_ms, CAST(split_part(label, '|', 2) AS INT) AS hops, {plain} AS path, CAST(split_part(label, '|', 4) AS DOUBLE) AS length_m, CAST(split_part(label, '|', 5) AS DOUBLE) AS max_depth_m FROM p{rounds})")
    return ",\n".join(out)


_G = with_views("graph_edge", "depot") + f",{EDGES_SQL}"
ORACLES = {
    "g1_directed_edges": _G + " SELECT n1, n2, road_id, CAST(round(1000 * length_m / (speed_kmh / CAST(3.6 AS DOUBLE))) AS BIGINT) AS travel_ms FROM edges",
    "g2_shortest_paths": _G + f",{MODES_SQL},{relaxed()} SELECT mode, origin, node, cost_ms, hops, path FROM paths",
    "g4_compared_routes": _G + f""",{MODES_SQL},{relaxed()}
SELECT b.origin, b.node, b.cost_ms AS base_cost_ms, s.cost_ms AS safe_cost_ms, s.cost_ms - b.cost_ms AS added_ms, round(s.length_m - b.length_m + 1e-9, 3) AS added_m,
       CASE WHEN s.path IS NULL THEN 'NO_SAFE_ROUTE' WHEN s.path = b.path THEN 'UNCHANGED' ELSE 'REROUTED' END AS status
FROM (SELECT * FROM paths WHERE mode = 'baseline' AND origin <> node) b LEFT JOIN (SELECT * FROM paths WHERE mode = 'flood_aware') s ON s.origin = b.origin AND s.node = b.node""",
    "g5_vehicle_routes": _G + f",{VEHICLE_SQL},{relaxed(60)} SELECT mode, origin, node, cost_ms, hops, max_depth_m FROM paths",
    "g7_nearest_shelter": _G + f""",{MODES_SQL},{relaxed()},
sh AS (SELECT node, 'S' || node AS shelter FROM (SELECT n1 AS node FROM graph_edge UNION SELECT n2 FROM graph_edge) WHERE node % 20 = 7),
r AS (SELECT mode, origin, cost_ms, shelter FROM paths JOIN sh USING (node))
SELECT mode, origin, split_part(min(lpad(CAST(cost_ms AS VARCHAR), 12, '0') || '|' || shelter), '|', 2) AS shelter, min(cost_ms) AS cost_ms, string_agg(shelter, ',' ORDER BY cost_ms, shelter) AS reachable FROM r GROUP BY mode, origin""",
    "g6_cutoffs": _G + f""",
leads AS (SELECT CAST(i * 60 AS INT) AS lead_minutes FROM range(0, 3) AS t(i)),
rising AS (SELECT n1, n2, road_id, length_m, speed_kmh, depth_m + lead_minutes / CAST(600 AS DOUBLE) AS depth_m, lead_minutes FROM edges CROSS JOIN leads),
vehicles AS ({values(VEHICLES[1:4], VEHICLE_COLUMNS)}),
priced AS (SELECT n1, n2, vehicle || '@' || lead_minutes AS mode, CAST(round(1000 * length_m / ({SPEED_SQL} / CAST(3.6 AS DOUBLE))) AS BIGINT) AS cost_ms, length_m, depth_m FROM rising CROSS JOIN vehicles WHERE depth_m <= deepest),
{relaxed(60)},
found AS (SELECT split_part(mode, '@', 1) AS vehicle, CAST(split_part(mode, '@', 2) AS INT) AS lead_minutes, origin, node FROM paths),
pairs AS (SELECT * FROM (SELECT DISTINCT vehicle, origin, node FROM found) CROSS JOIN leads)
SELECT p.vehicle, p.origin, p.node, min(CASE WHEN f.node IS NULL AND p.lead_minutes > 0 THEN p.lead_minutes END) AS cutoff_lead_minutes, bool_and(f.node IS NOT NULL) AS always_passable
FROM pairs p LEFT JOIN found f ON f.vehicle = p.vehicle AND f.lead_minutes = p.lead_minutes AND f.origin = p.origin AND f.node = p.node GROUP BY p.vehicle, p.origin, p.node""",
    "j21_avoided_roads": _G + f""",{MODES_SQL},{relaxed()},
l AS (SELECT mode, origin, node, list_transform(string_split(path, '>'), lambda x: CAST(x AS BIGINT)) AS p FROM paths WHERE hops > 0),
i AS (SELECT *, unnest(range(1, len(p))) AS k FROM l),
s AS (SELECT mode, origin, node, least(p[k], p[k + 1]) AS a, greatest(p[k], p[k + 1]) AS b FROM i),
w AS (SELECT least(n1, n2) AS a, greatest(n1, n2) AS b, max(depth_m) AS depth_m FROM edges GROUP BY 1, 2)
SELECT s.origin, s.node, s.a, s.b, w.depth_m, {class_sql("w.depth_m")} AS class FROM s JOIN w ON w.a = s.a AND w.b = s.b
WHERE mode = 'baseline' AND EXISTS (SELECT 1 FROM paths f WHERE f.mode = 'flood_aware' AND f.origin = s.origin AND f.node = s.node)
  AND NOT EXISTS (SELECT 1 FROM s f WHERE f.mode = 'flood_aware' AND f.origin = s.origin AND f.node = s.node AND f.a = s.a AND f.b = s.b)""",
}
