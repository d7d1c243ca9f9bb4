"""Queries over whole tables against brute force."""

from __future__ import annotations

import heapq
import math

from test_operators import walked


def test_every_order_is_a_road(spark, sf_dir):
    import __spark_entry__
    from rillspark.plans.testbed import view

    known, n = __spark_entry__.queries(), spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    depth = {}
    for r in view(spark, sf_dir, "depth").collect():
        depth.setdefault((r.r, r.c), []).append((r.scenario_id, r.lead_minutes, r.depth_m))
    ends = view(spark, sf_dir, "segment").collect()
    expected, cells = {}, 0
    for x in ends:
        for cell in walked(x.r1, x.c1, x.r2, x.c2):
            cells += 1
            for k, lead, d in depth.get(cell, []):
                expected.setdefault((k, lead, x.road_id), []).append(d)
    found = {(r.scenario_id, r.lead_minutes, r.road_id): r for r in known["a1_road_impact"](spark, sf_dir).collect()}
    frames = {(k, lead) for rows in depth.values() for k, lead, _ in rows}
    assert len(ends) == n and found.keys() == {(*f, x.road_id) for f in frames for x in ends} and known["j1_road_cells"](spark, sf_dir).count() == cells
    assert all(found[key].n_cells == 0 and found[key].max_depth_m is None and found[key].classification is None for key in found.keys() - expected.keys())
    length = {x.road_id: x.length_m for x in ends}
    for key, d in expected.items():
        share = sum(x > 0.05 for x in d) / len(d)
        assert found[key].n_cells == len(d) and found[key].max_depth_m == max(d)
        assert math.isclose(found[key].mean_depth_m, sum(d) / len(d), abs_tol=2e-6) and math.isclose(found[key].impacted_length_m, share * length[key[2]], abs_tol=2e-6)
    assert known["a42_network_totals"](spark, sf_dir).first().segments == known["f3_intensities"](spark, sf_dir).count() == n


def test_all_edges_and_depots(spark, sf_dir):
    import __spark_entry__
    from rillspark.plans.testbed import view

    known, links = __spark_entry__.queries(), {}
    given = view(spark, sf_dir, "graph_edge").collect()
    for e in given:
        ms = math.floor(1000 * e.length_m / ((30 + 10 * ((e.n1 + e.n2) % 3)) / 3.6) + 0.5)
        for a, b in ((e.n1, e.n2), (e.n2, e.n1)):
            links.setdefault(a, []).append((b, ms))
    assert known["g1_directed_edges"](spark, sf_dir).count() == 2 * len(given)
    best = {}
    for depot in (r.node for r in view(spark, sf_dir, "depot").collect()):
        heap = [(0, depot)]
        while heap:
            cost, node = heapq.heappop(heap)
            if (depot, node) in best:
                continue
            best[depot, node] = cost
            for other, ms in links.get(node, ()):
                heapq.heappush(heap, (cost + ms, other))
    found = {(r.origin, r.node): (r.cost_ms, r.path) for r in known["g2_shortest_paths"](spark, sf_dir).where("mode = 'baseline'").collect()}
    assert {k: c for k, (c, _) in found.items()} == best
    assert all(p.split(">")[0] == str(o) and p.split(">")[-1] == str(n) for (o, n), (_, p) in found.items())


def test_soft_routes_against_dijkstra(spark, sf_dir):
    import __spark_entry__
    from rillspark.plans.q_graph import SOFT_LIMITS
    from rillspark.plans.testbed import view

    roads = {}
    for e in view(spark, sf_dir, "graph_edge").collect():
        depth, seconds = ((e.n1 * 7 + e.n2 * 7 + e.n1 * e.n2) % 71) / 100, e.length_m / ((30 + 10 * ((e.n1 + e.n2) % 3)) / 3.6)
        for a, b in ((e.n1, e.n2), (e.n2, e.n1)):
            roads.setdefault(a, []).append((b, depth, seconds))
    best = {}
    for name, limit in SOFT_LIMITS:
        for depot in (r.node for r in view(spark, sf_dir, "depot").collect()):
            heap = [(0, depot)]
            while heap:
                cost, node = heapq.heappop(heap)
                if (name, depot, node) in best:
                    continue
                best[name, depot, node] = cost
                for other, depth, seconds in roads.get(node, ()):
                    more = 100_000 if depth > limit else depth / limit * 250 if depth > 0.05 else 0
                    heapq.heappush(heap, (cost + math.floor((seconds + more) * 1000 + 0.5), other))
    found = {(r.mode, r.origin, r.node): r.cost_ms for r in __spark_entry__.queries()["g8_soft_routes"](spark, sf_dir).collect()}
    assert found == best


def test_all_frames_and_requests(spark, sf_dir):
    import __spark_entry__
    from rillspark.functions.policy import MEMBERS, WAYPOINT_PROFILES
    from rillspark.plans.testbed import view

    known, depth, ends = __spark_entry__.queries(), view(spark, sf_dir, "depth").collect(), view(spark, sf_dir, "segment").collect()
    every = {(r.scenario_id, r.lead_minutes) for r in depth}
    assert known["j23_member_depths"](spark, sf_dir).groupBy("scenario_id", "lead_minutes", "member_id").count().count() == len(every) * len(MEMBERS)
    at = {(r.scenario_id, r.lead_minutes, r.r, r.c): r.depth_m for r in depth}
    cells = {(x.road_id, i): cell for x in ends for i, cell in ((0, (x.r1, x.c1)), (1, (x.r2, x.c2)))}
    limits = {p: (d, dv) for p, d, dv in WAYPOINT_PROFILES}
    rows = known["f36_waypoint_hazard"](spark, sf_dir).collect()
    assert len(rows) == len(every) * len(cells) * len(limits)
    for r in rows:
        d = at.get((r.scenario_id, r.lead_minutes, *cells[r.road_id, r.i]), 0.0)
        deepest, most = limits[r.profile]
        blocked = d > deepest or d * r.velocity_ms > most
        move = ((d - deepest) * 80 + 20) * (1 if r.i == 0 else -1) if blocked else 0.0
        assert (r.depth_m, r.blocked) == (d, blocked) and math.isclose(r.x_out, r.x + move, abs_tol=1e-5) and math.isclose(r.y_out, r.y + move / 2, abs_tol=1e-5)
    seen = {}
    for r in view(spark, sf_dir, "gauge").select("sensor_id", "obs_id", "observation_time").collect():
        seen.setdefault(r.sensor_id, []).append((r.observation_time.timestamp(), r.obs_id))
    nearest = {}
    for sensor, obs in seen.items():
        for t in {t + 420 for t, _ in obs}:
            gap, _, obs_id = min((abs(t - u), u, k) for u, k in obs)
            nearest[sensor, round(t, 3)] = (obs_id, False) if gap <= 900 else (max(obs)[1], True)
    assert {(r.sensor_id, round(r.t.timestamp(), 3)): (r.obs_id, r.fallback) for r in known["j7_nearest_in_time"](spark, sf_dir).collect()} == nearest
