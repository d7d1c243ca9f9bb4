"""Batched shortest paths on road graphs, for all queries, scenarios, leads and vehicles at once.

Costs are whole milliseconds, so that sums are exact and ties are real; of equal costs the path with fewer hops wins, then the
smaller one, node by node from the start. All searches advance together, a round an edge (`searches`); the driver sees one count a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.policy import PASSABILITY, effective_speed, impact_class, speed_factor
from rillspark.functions.shared import settled, shared_root
from rillspark.operators import searches
from rillspark.operators.roads import steady

#: Searches of one mode that advance side by side, at most.
ORIGINS_AT_ONCE = 32


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (n1, n2) as two directed ones; other columns stay."""
    one = lambda a, b: F.struct(F.col(a).alias("n1"), F.col(b).alias("n2"))
    both = edges.withColumn("_ends", F.explode(F.array(one("n1", "n2"), one("n2", "n1"))))  # no union, which would compile and read everything twice
    return both.select(*(F.col(f"_ends.{c}") if c in ("n1", "n2") else c for c in edges.columns))


def travel_ms(length_m: Column, speed_kmh: Column) -> Column:
    return F.round(1000.0 * length_m / (speed_kmh / 3.6)).cast("long")


def flood_costs(edges: DataFrame, policy: dict = PASSABILITY) -> DataFrame:
    """Edges by mode with cost_ms: baseline; avoid_impassable (impassable edges left out); flood_aware (others slowed by class).

    edges: n1, n2, road_id, length_m, speed_kmh, depth_m; a null depth counts as dry.
    """
    named = edges.withColumn("class", impact_class(F.coalesce("depth_m", F.lit(0.0)), policy))
    mode = lambda m, speed: F.struct(F.lit(m).alias("mode"), travel_ms(F.col("length_m"), speed).alias("cost_ms"))
    passable = lambda m: F.when(F.col("class") != "IMPASSABLE", m)
    slowed = F.col("speed_kmh") * speed_factor(F.col("class"), policy)
    modes = F.array(mode("baseline", F.col("speed_kmh")), passable(mode("avoid_impassable", F.col("speed_kmh"))), passable(mode("flood_aware", slowed)))
    each = named.withColumn("_mode", F.explode(modes)).where("_mode IS NOT NULL")
    return each.select("n1", "n2", "road_id", "length_m", "depth_m", "_mode.mode", "_mode.cost_ms")


def vehicle_costs(edges: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Edges by vehicle (as mode; `vehicle@lead` if the edges have lead_minutes): those it can pass, at its effective speed (at least 0.1 m/s).

    vehicles: vehicle, deepest, speed, least.
    """
    d = F.coalesce("depth_m", F.lit(0.0))
    each = edges.crossJoin(F.broadcast(vehicles)).where(d <= F.col("deepest"))
    speed = F.greatest(F.lit(0.36), effective_speed(d, F.col("deepest"), F.col("speed"), F.col("least")))
    mode = F.concat_ws("@", "vehicle", F.col("lead_minutes").cast("string")) if "lead_minutes" in edges.columns else F.col("vehicle")
    return each.select("n1", "n2", "road_id", "length_m", "depth_m", mode.alias("mode"), travel_ms(F.col("length_m"), speed).alias("cost_ms"))


def soft_costs(edges: DataFrame, limits: DataFrame, penalty: float = 100_000.0, slope: float = 250.0, dry_m: float = 0.05) -> DataFrame:
    """Edges by profile (as mode): all stay passable; water costs seconds: `penalty` beyond the profile's limit, else depth / limit * `slope`.

    edges: n1, n2, road_id, length_m, depth_m, time_s; limits: profile, limit_m.
    """
    d = F.coalesce("depth_m", F.lit(0.0))
    more = F.when(d > F.col("limit_m"), F.lit(penalty)).when(d > dry_m, d / F.col("limit_m") * slope).otherwise(0.0)
    each = edges.crossJoin(F.broadcast(limits))
    return each.select("n1", "n2", "road_id", "length_m", "depth_m", F.col("profile").alias("mode"), F.round((F.col("time_s") + more) * 1000.0).cast("long").alias("cost_ms"))


def _known(edges: DataFrame) -> DataFrame:
    """Edges in the types of searches; those of unknown ends or cost lead nowhere."""
    plain = edges.select("mode", F.col("n1").cast("long").alias("node"), F.col("n2").cast("long").alias("next"), F.col("cost_ms").cast("long").alias("cost_ms"), F.col("length_m").cast("double").alias("length_m"), F.coalesce("depth_m", F.lit(0.0)).cast("double").alias("depth_m"))
    return plain.where("mode IS NOT NULL AND node IS NOT NULL AND next IS NOT NULL AND cost_ms IS NOT NULL")


def _numbered(known: DataFrame, modes: list[str]) -> DataFrame:
    """Edges of these modes, with the mode's number m."""
    numbers = known.sparkSession.createDataFrame(list(enumerate(modes)), "m int, mode string")
    return known.join(F.broadcast(numbers), "mode").select("m", "node", "next", "cost_ms", "length_m", "depth_m")


def _nodes() -> Column:
    """About how many nodes edges have."""
    return F.greatest(F.approx_count_distinct("node"), F.approx_count_distinct("next"))


def _searched(edges: DataFrame, origins: DataFrame) -> Iterator[tuple[searches.Labelled, DataFrame, type]]:
    """Final labels, names of searches (search, mode, origin), and the type that numbers of nodes fit, for ORIGINS_AT_ONCE origins of a mode at a time.

    origins: a short list.
    """
    spark = edges.sparkSession
    known = _known(edges)
    least, most, low, high, nodes = known.agg(F.min("cost_ms"), F.max("cost_ms"), F.min(F.least("node", "next")), F.max(F.greatest("node", "next")), _nodes()).first()
    if least is not None and least < 0:
        raise ValueError("an edge has a cost below 0")
    asked = set(origins.select("mode", F.col("origin").cast("long").alias("origin")).where("mode IS NOT NULL AND origin IS NOT NULL").collect())
    modes = sorted({r.mode for r in asked})
    numbered = _numbered(known, modes)
    every = sorted({r.origin for r in asked})  # an origin is searched in all its modes at once, as these are compared
    for at in range(0, len(every), ORIGINS_AT_ONCE):
        each = [(m, o) for m, mode in enumerate(modes) for o in every[at : at + ORIGINS_AT_ONCE] if (mode, o) in asked]
        names = F.broadcast(spark.createDataFrame([(k, modes[m], o) for k, (m, o) in enumerate(each)], "search int, mode string, origin long"))
        ends = [x for x in (low, high, *(o for _, o in each)) if x is not None]
        kind = np.int32 if -(1 << 31) <= min(ends) and max(ends) < 1 << 31 else np.int64
        labels = (nodes or 0) * len(each)
        yield searches.labelled(numbered, each, searches.blocks_for(spark, labels), labels, most or 0, shared_root(spark)), names, kind


def least_costs(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """Least cost_ms, and its fewest hops, from every origin to every node it reaches, by mode. Tables as for `shortest_paths`, without the work for the paths."""
    spark, found = edges.sparkSession, []
    for blocks, names, _ in _searched(edges, origins):
        found.append(settled(searches.labels_of(blocks), "labels"))
        blocks.drop()
        found[-1] = found[-1].join(names, "search").select("mode", "origin", "node", F.expr(f"label div {searches.HOPS}").alias("cost_ms"), (F.col("label") % searches.HOPS).cast("int").alias("hops"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "mode string, origin long, node long, cost_ms long, hops int")


def components(edges: DataFrame, nodes: DataFrame, modes: list[str]) -> DataFrame:
    """node, components: for every node of `edges` and `nodes`, and each of `modes`, the smallest node that it hangs together with by edges of the mode.

    edges: mode, n1, n2, in both directions; nodes: node, also such as have no edge (a short list); modes: a short list.
    """
    spark = edges.sparkSession
    dry = edges.select("mode", "n1", "n2", F.lit(0).alias("cost_ms"), F.lit(0.0).alias("length_m"), F.lit(0.0).alias("depth_m"))
    numbered = _numbered(_known(dry), modes)
    labels = numbered.agg(_nodes()).first()[0] * len(modes)
    blocks = searches.labelled(numbered, [(m, 0) for m in range(len(modes))], searches.blocks_for(spark, labels), labels, 0, shared_root(spark), joined=True)
    found = settled(searches.components_of(blocks), "components")
    blocks.drop()
    alone = nodes.select(F.col("node").cast("long").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("components", F.array_repeat("node", len(modes))))


def shortest_paths(edges: DataFrame, origins: DataFrame, *without: str, text: bool = False) -> DataFrame:
    """Best path from every origin to every node it reaches, by mode: cost_ms, hops, path (array of nodes; with `text` as by `path_text`), length_m, max_depth_m; columns named in `without` are not kept.

    edges: directed, with mode and cost_ms; origins: mode, origin. Several edges between two nodes compete; costs below 0 are refused. Costs and hops come first,
    without paths, and with each the edges that a best path can end with; then paths grow along those, each once: a path of h edges from the one of h - 1 edges that it prolongs.
    """
    spark, found = edges.sparkSession, []
    for blocks, names, kind in _searched(edges, origins):
        paths = searches.paths_of(blocks, kind, None if "path" in without else "string" if text else "array<long>")
        found.append(settled(paths.drop(*without), "paths").join(names, "search"))
        blocks.drop()
    columns = [c for c in ("mode", "origin", "node", "cost_ms", "hops", "path", "length_m", "max_depth_m") if c not in without]
    empty = f"mode string, origin long, node long, cost_ms long, path {'string' if text else 'array<long>'}, hops int, length_m double, max_depth_m double"
    return (reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)).select(*columns)


def path_text(path: Column) -> Column:
    """The nodes of a path, joined by >."""
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def steps_of(path: Column) -> Column:
    """The edges of a path as an array of (a, b), ends in order of their numbers."""
    two = lambda k: (F.element_at(path, k), F.element_at(path, k + 1))
    return F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: F.struct(F.least(*two(k)).alias("a"), F.greatest(*two(k)).alias("b")))


def avoided_edges(paths: DataFrame, edges: DataFrame, base: str = "baseline", other: str = "flood_aware") -> DataFrame:
    """Edges of the base route that the other route of the same ends does not use, with their water and its class; both routes exist.

    edges: n1, n2, depth_m, one row an edge or more; the deepest water between two nodes counts.
    """
    ends = ["origin", "node"]
    side = lambda m, name: paths.where((F.col("mode") == m) & (F.col("hops") > 0)).select(*ends, steps_of(F.col("path")).alias(name))
    both = side(base, "base").join(side(other, "other").hint("merge"), ends)
    gone = both.select(*ends, F.explode(F.array_except("base", "other")).alias("e")).select(*ends, "e.a", "e.b")
    water = edges.groupBy(F.least("n1", "n2").cast("long").alias("a"), F.greatest("n1", "n2").cast("long").alias("b")).agg(F.max(F.coalesce("depth_m", F.lit(0.0))).alias("depth_m"))
    return gone.join(water.hint("merge"), ["a", "b"]).select(*ends, "a", "b", "depth_m", impact_class(F.col("depth_m")).alias("class"))


def _partners(names: DataFrame, base: str, other: str) -> list[int]:
    """For each search of the base its other search from the same origin, -1 if there is none; -2 for all others."""
    place = {(r.mode, r.origin): r.search for r in names.collect()}
    return [place.get((other, o), -1) if m == base else -2 for (m, o), _ in sorted(place.items(), key=lambda x: x[1])]


def searched_avoided(edges: DataFrame, origins: DataFrame, base: str = "baseline", other: str = "flood_aware") -> DataFrame:
    """`avoided_edges` of the best paths between origins that both modes have and all nodes, without writing out paths: both are compared in the block where they end.

    edges: as for `shortest_paths`, in both directions; the deepest water of any mode between two nodes counts. origins: mode, origin.
    """
    spark, found = edges.sparkSession, []
    common = origins.where(F.col("mode").isin(base, other)).groupBy("origin").agg(F.count_distinct("mode").alias("n")).where("n = 2")
    common = common.select("origin", F.explode(F.array(F.lit(base), F.lit(other))).alias("mode"))
    two = [F.least("n1", "n2"), F.greatest("n1", "n2")]
    water = edges.groupBy(two[0].alias("a"), two[1].alias("b")).agg(F.max(F.coalesce("depth_m", F.lit(0.0))).alias("depth_m"))
    asked = edges.where(F.col("mode").isin(base, other)).drop("depth_m").withColumns({"a": two[0], "b": two[1]}).join(water.hint("merge"), ["a", "b"])
    for blocks, names, kind in _searched(asked, common):
        found.append(settled(searches.apart_of(blocks, _partners(names, base, other), kind), "avoided").join(names, "search"))
        blocks.drop()
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "origin long, node long, a long, b long, depth_m double")
    return rows.select("origin", "node", "a", "b", "depth_m", impact_class(F.col("depth_m")).alias("class"))


def compared_routes(paths: DataFrame, base: str = "baseline", other: str = "flood_aware") -> DataFrame:
    """For each origin and node: both routes, added length and time, whether the path differs; NO_SAFE_ROUTE if only the base reaches it."""
    side = lambda m, p: paths.where(F.col("mode") == m).select("origin", "node", *(F.col(c).alias(f"{p}_{c}") for c in ("cost_ms", "length_m", "path")))
    both = side(base, "base").join(side(other, "safe").hint("merge"), ["origin", "node"], "left").where("origin <> node")
    status = F.when(F.col("safe_path").isNull(), "NO_SAFE_ROUTE").when(F.col("safe_path") == F.col("base_path"), "UNCHANGED").otherwise("REROUTED")
    return both.select(
        "origin", "node", "base_cost_ms", "safe_cost_ms", (F.col("safe_cost_ms") - F.col("base_cost_ms")).alias("added_ms"), steady(F.col("safe_length_m") - F.col("base_length_m"), 3).alias("added_m"), status.alias("status")
    )


def searched_routes(edges: DataFrame, origins: DataFrame, base: str = "baseline", other: str = "flood_aware") -> DataFrame:
    """`compared_routes` of the best paths, without writing out or joining paths: both are compared in the block where they end. Tables as for `shortest_paths`."""
    spark, found = edges.sparkSession, []
    for blocks, names, kind in _searched(edges, origins.where(F.col("mode").isin(base, other))):
        both = settled(searches.both_of(blocks, _partners(names, base, other), kind), "routes")
        found.append(both.join(names, "search"))
        blocks.drop()
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "origin long, node long, cost_ms long, length_m double, other_cost_ms long, other_length_m double, same boolean")
    status = F.when(F.col("other_cost_ms").isNull(), "NO_SAFE_ROUTE").when(F.col("same"), "UNCHANGED").otherwise("REROUTED")
    return rows.where("origin <> node").select(
        "origin", "node", F.col("cost_ms").alias("base_cost_ms"), F.col("other_cost_ms").alias("safe_cost_ms"), (F.col("other_cost_ms") - F.col("cost_ms")).alias("added_ms"),
        steady(F.col("other_length_m") - F.col("length_m"), 3).alias("added_m"), status.alias("status"),
    )


def cutoffs(paths: DataFrame, leads: DataFrame) -> DataFrame:
    """Per vehicle, origin and node: the first lead above 0 without a route, and whether all leads have one.

    paths: vehicle, lead_minutes, origin, node (reached). Pairs that no lead reaches are left out.
    """
    pairs = paths.select("vehicle", "origin", "node").distinct().crossJoin(F.broadcast(leads))  # leads: a short list
    seen = pairs.join(paths.select("vehicle", "lead_minutes", "origin", "node", F.lit(True).alias("viable")).hint("merge"), ["vehicle", "lead_minutes", "origin", "node"], "left")
    lost = F.col("viable").isNull()
    return seen.groupBy("vehicle", "origin", "node").agg(F.min(F.when(lost & (F.col("lead_minutes") > 0), F.col("lead_minutes"))).alias("cutoff_lead_minutes"), F.bool_and(~lost).alias("always_passable"))


def component_cutoffs(found: DataFrame, origins: DataFrame, modes: dict[tuple[str, int], int]) -> DataFrame:
    """`cutoffs` where roads lead both ways: a lead has a route between nodes that hang together, so no pair is moved.

    found: node, components, as by `components`; origins: origin (a short list); modes: the place of each vehicle and lead in the components.
    """
    vehicles, leads = sorted({v for v, _ in modes}), sorted({lead for _, lead in modes})
    each = F.array(*(F.struct(F.lit(v).alias("vehicle"), F.array(*(F.col("components")[modes[v, lead]] for lead in leads)).alias("at")) for v in vehicles))
    nodes = found.select("node", F.explode(each).alias("x")).select("node", "x.vehicle", "x.at")
    starts = nodes.join(F.broadcast(origins.select(F.col("origin").cast("long").alias("node")).distinct()), "node").select(F.col("node").alias("origin"), "vehicle", F.col("at").alias("from"))
    met = [F.col("at")[k] == F.col("from")[k] for k in range(len(leads))]
    lost = F.least(*(F.when(~m, F.lit(lead)) for m, lead in zip(met, leads, strict=True) if lead > 0), F.lit(None).cast("int"), F.lit(None).cast("int"))
    pairs = nodes.join(F.broadcast(starts), "vehicle").where(reduce(Column.__or__, met))
    return pairs.select("vehicle", "origin", "node", lost.cast("int").alias("cutoff_lead_minutes"), reduce(Column.__and__, met).alias("always_passable"))


def nearest_shelter(paths: DataFrame, shelters: DataFrame) -> DataFrame:
    """Per mode and origin: the shelter reached soonest and all reachable ones in order of time. shelters: node, shelter."""
    reached = paths.join(shelters.hint("merge"), "node").groupBy("mode", "origin").agg(F.array_sort(F.collect_list(F.struct("cost_ms", "shelter"))).alias("s"))
    return reached.select("mode", "origin", F.col("s")[0]["shelter"].alias("shelter"), F.col("s")[0]["cost_ms"].alias("cost_ms"), F.array_join(F.transform("s", lambda x: x["shelter"]), ",").alias("reachable"))
