"""How many rows the steps of a query make: tables that grow in one place must not make products of their rows."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators import fields, gauges, graph, nowcast, roads
from rillspark.plans import q_assets, q_graph, q_reports, q_roads, q_scores, q_summaries


def most_rows(df: DataFrame) -> int:
    """Runs `df`; the most rows that any step of its final plan gave."""
    df.collect()
    name, most = df.sparkSession._jvm.scala.collection.JavaConverters, 0
    left = [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            left.append(node.plan())
            continue
        metrics = name.mapAsJavaMap(node.metrics())
        if "numOutputRows" in metrics:
            most = max(most, metrics["numOutputRows"].value())
        left.extend(name.seqAsJavaList(node.children()))
    return most


def test_times_and_observations_of_one_bucket_make_no_pairs(spark):
    """F1."""
    start, n = dt.datetime(2024, 1, 1), 600
    rows = [("radar", i, start + dt.timedelta(seconds=(i * 37) % 1777 + 3000 * (i % 3))) for i in range(n)]
    times = [("radar", start + dt.timedelta(seconds=(i * 53) % 9001, milliseconds=500 * (i % 2))) for i in range(n)]
    obs = spark.createDataFrame(rows, "sensor_id string, obs_id long, observation_time timestamp_ntz")
    found = gauges.nearest_in_time(spark.createDataFrame(times, "sensor_id string, t timestamp_ntz"), obs, 10)
    last = max((t, i) for _, i, t in rows)
    best = {}
    for _, t in times:
        gap, at, i = min((abs(t - o), o, i) for _, i, o in rows)
        best[t] = (i, gap.total_seconds(), False) if gap <= dt.timedelta(minutes=10) else (last[1], abs(t - last[0]).total_seconds(), True)
    assert {r.t: (r.obs_id, r.gap_seconds, r.fallback) for r in found.collect()} == best
    assert most_rows(found) < 10 * n


def alike_roads(spark, n: int) -> DataFrame:
    """n roads between the same ends."""
    return spark.range(n).selectExpr("id AS road_id", "0 AS r1", "0 AS c1", "0 AS r2", "9 AS c2", "'local' AS road_class", "270.0D AS length_m")


def wet_line(spark) -> DataFrame:
    """Ten cells in two leads of a scenario, the last one deep."""
    return spark.range(20).selectExpr("'N' AS scenario_id", "CAST(id % 2 * 15 AS INT) AS lead_minutes", "0 AS r", "CAST(id div 2 AS INT) AS c", "CASE WHEN id >= 18 THEN 0.55D ELSE 0.1D END AS depth_m")


def viewed(monkeypatch, module, **tables: DataFrame) -> None:
    """Lets the queries of a module read these domain tables."""
    monkeypatch.setattr(module, "view", lambda spark, sf, name: tables[name])


def test_effects_and_costs_look_up_a_line_of_many_roads_once(spark, monkeypatch):
    """F2, F3, F4 and F14."""
    n = 400
    sites = spark.range(n).selectExpr("id AS asset_id", "0 AS r", "9 AS c", "0.5D AS critical_depth_m")
    tables = {"segment": alike_roads(spark, n), "depth": wet_line(spark), "asset": sites}
    viewed(monkeypatch, q_assets, **tables)
    viewed(monkeypatch, q_reports, **tables)
    found = q_assets.QUERIES["a33_mitigation_effects"](spark, "")
    rows = found.collect()
    assert {r.impassable_before for r in rows} == {n}
    assert {r.reopened_roads for r in rows} == {n}
    assert most_rows(found) <= n
    items = q_reports.QUERIES["f32_itemised"](spark, "")
    assert {r.assets_inr for r in items.collect()} == {n * 5e6}
    assert most_rows(items) <= n


def test_roads_of_the_same_ends_are_looked_up_once(spark, monkeypatch):
    """Steps before the last one, which unfolds the rows asked for, don't grow with roads times cells."""
    n = 400
    tables = {"segment": alike_roads(spark, n), "depth": wet_line(spark), "asset": spark.range(n).selectExpr("id AS asset_id", "CAST(id AS STRING) AS name", "3 AS criticality_weight", "0.1D AS critical_depth_m", "0.5D AS failure_depth_m", "1000L AS service_population", "0 AS r", "9 AS c")}
    for module in (q_assets, q_roads, q_summaries):
        viewed(monkeypatch, module, **tables)
    samples = q_roads.QUERIES["j2_depth_samples"](spark, "")
    assert samples.count() == n * 20 and samples.distinct().count() == n * 20
    assert "Generate" in samples._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # unfolded after the join
    assert q_roads.QUERIES["x2_reopened_roads"](spark, "").count() == 2 * n  # 0.55 becomes 0.35
    worst = q_assets.QUERIES["a32_vulnerability"](spark, "")
    assert {r.critical_failure for r in worst.collect()} == {n}
    assert most_rows(worst) <= 2 * n  # assets and frames
    wards = q_summaries.QUERIES["a12_ward_summary"](spark, "")
    assert {(r.wet_road_m, r.flooded_assets) for r in wards.collect()} == {(n * 10 * 30.0, n)}
    assert most_rows(wards) <= n
    hazard = q_summaries.QUERIES["f36_waypoint_hazard"](spark, "")
    assert hazard.distinct().count() == hazard.count() == n * 2 * 2 * len(q_summaries.WAYPOINT_PROFILES)
    assert "Generate" in hazard._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_paths_are_written_once_each(spark, monkeypatch):
    """Ties, parallel edges, edges without cost, an origin nobody reaches, and more origins than stand side by side."""
    edges = [(n1, n2, c, float(length), 0.1 * length) for a, b, c, length in ((0, 1, 1, 2), (0, 2, 1, 1), (1, 3, 1, 1), (2, 3, 1, 3), (1, 3, 1, 2), (3, 4, 0, 1), (4, 5, 2, 2), (2, 5, 9, 1)) for n1, n2 in ((a, b), (b, a))]
    origins = [*range(6), *range(100, 100 + graph.ORIGINS_AT_ONCE)]
    best = {o: {o: (0, 0, (o,), 0.0, 0.0)} for o in origins}
    for _ in range(6):
        for o in origins:
            for node, (c, h, p, x, d) in list(best[o].items()):
                for n1, n2, cost, length, depth in edges:
                    if n1 == node:
                        label = (c + cost, h + 1, (*p, n2), x + length, max(d, depth))
                        best[o][n2] = min(best[o].get(n2, label), label)
    want = {(o, n): label for o in origins for n, label in best[o].items()}
    written, settled = [], graph.settled

    def counted(df, name, *by):
        table = settled(df, name, *by)
        written.extend([table.count()] if name == "paths" else [])
        return table

    monkeypatch.setattr(graph, "settled", counted)
    links = spark.createDataFrame(edges, "n1 long, n2 long, cost_ms long, length_m double, depth_m double").withColumn("mode", F.lit("m"))
    starts = spark.createDataFrame([("m", o) for o in origins], "mode string, origin long")
    found = graph.shortest_paths(links, starts).collect()
    assert {(r.origin, r.node): (r.cost_ms, r.hops, tuple(r.path), r.length_m, r.max_depth_m) for r in found} == want
    assert sum(written) == len(want) == len(found)
    assert {(r.origin, r.node): (r.cost_ms, r.hops) for r in graph.least_costs(links, starts).collect()} == {k: v[:2] for k, v in want.items()}


def test_rounds_write_what_got_better(spark, monkeypatch):
    """On a chain a round improves one node, so all rounds together write few rows, not all labels each."""
    n, written, settled, added = 24, [], graph.settled, getattr(graph, "added", None)

    def counted(df, name, *by):
        table = settled(df, name, *by)
        written.extend([table.count()] if name == "labels" else [])
        return table

    def counted_more(df, table, *by, **kept):
        found = added(df, table, *by, **kept)
        written.append(found.count() - sum(sizes.get(table, [])))
        sizes.setdefault(table, []).append(written[-1])
        return found

    sizes: dict[str, list[int]] = {}
    monkeypatch.setattr(graph, "settled", counted)
    monkeypatch.setattr(graph, "added", counted_more, raising=False)
    chain = spark.range(n - 1).selectExpr("'m' AS mode", "id AS n1", "id + 1 AS n2", "5L AS cost_ms", "1.0D AS length_m", "0.0D AS depth_m")
    found = graph.least_costs(chain, spark.createDataFrame([("m", 0)], "mode string, origin long"))
    assert {(r.node, r.cost_ms, r.hops) for r in found.collect()} == {(k, 5 * k, k) for k in range(n)}
    assert sum(written) <= 3 * n


def test_equal_peaks_are_the_earliest_in_the_sql_too():
    """rows 6 and 1 have the same sum; simulated and observed peaks are both asked for the earliest of equals."""
    text = q_scores.ORACLES["a18_hydrograph_fit"]
    assert "arg_max(t, (o, -t))" in text and "arg_max(t, (s, -t))" in text
    con = duckdb.connect()
    con.execute("CREATE TABLE z AS SELECT * FROM (VALUES (6, 5.0), (1, 5.0), (2, 3.0)) AS v(t, s)")
    assert con.execute("SELECT arg_max(t, (s, -t)) FROM z").fetchone() == (1,)


def test_cutoffs_come_from_what_hangs_together(spark):
    """the same rows as from searches, also for an origin without roads; only nodes are labelled, not pairs of origin and node."""
    ways = [(v, lead, a, b) for v, dry in (("car", 4), ("van", 6)) for lead in (0, 60, 120) for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (9, 7)) if a % 5 + lead // 40 < dry]
    both = graph.both_ways(spark.createDataFrame(ways, "vehicle string, lead_minutes int, n1 long, n2 long")).selectExpr("concat(vehicle, '@', lead_minutes) AS mode", "n1", "n2", "5L AS cost_ms", "1.0D AS length_m", "0.0D AS depth_m")
    modes = {(v, lead): 3 * k + i for k, v in enumerate(("car", "van")) for i, lead in enumerate((0, 60, 120))}
    starts = spark.createDataFrame([(0,), (7,), (50,)], "origin long")
    labels = graph.components(both, starts.withColumnRenamed("origin", "node"), [f"{v}@{lead}" for v, lead in modes])
    assert labels.count() == labels.distinct().count() == 10
    searched = graph.least_costs(both, starts.crossJoin(spark.createDataFrame([(f"{v}@{lead}",) for v, lead in modes], "mode string")))
    split = F.split("mode", "@")
    reached = searched.select(split[0].alias("vehicle"), split[1].cast("int").alias("lead_minutes"), "origin", "node")
    want = graph.cutoffs(reached, spark.createDataFrame([(0,), (60,), (120,)], "lead_minutes int"))
    found = graph.component_cutoffs(labels, starts, modes).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert any(r.cutoff_lead_minutes for r in found) and len({(r.vehicle, r.origin, r.node) for r in found}) == len(found)


def test_a_round_is_one_job(spark):
    """A chain of n nodes takes a job a round for labels, one a length for paths, and a fixed number for the rest."""
    n = 20
    chain = spark.range(n - 1).selectExpr("'m' AS mode", "id AS n1", "id + 1 AS n2", "5L AS cost_ms", "1.0D AS length_m", "0.0D AS depth_m")
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        assert graph.shortest_paths(chain, spark.createDataFrame([("m", 0)], "mode string, origin long")).count() == n
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) <= 2 * n + 30


def test_routes_are_compared_where_they_end(spark, sf_dir, monkeypatch):
    """only what a route avoids is written, no paths; the rows are those of the paths, also with ties, parallel edges, origins of one mode only and two rounds of origins."""
    written, settled = [], graph.settled

    def counted(df, name, *by):
        table = settled(df, name, *by)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(graph, "settled", counted)
    found = q_graph.QUERIES["j21_avoided_roads"](spark, sf_dir)
    assert found.count() == sum(n for _, n in written) and {name for name, _ in written} == {"avoided"}
    rng = random.Random(7)
    ways = [(m, a, b, rng.randint(1, 4), 1.0, 0.1 * rng.randint(0, 6)) for m in ("baseline", "flood_aware") for a in range(40) for b in (rng.randrange(40), a // 2, a // 2) if m == "baseline" or rng.random() < 0.8]
    links = graph.both_ways(spark.createDataFrame(ways, "mode string, n1 long, n2 long, cost_ms long, length_m double, depth_m double"))
    starts = spark.createDataFrame([("baseline", o) for o in range(36)] + [("flood_aware", o) for o in range(2, 40)], "mode string, origin long")
    want = graph.avoided_edges(graph.shortest_paths(links, starts), links).collect()
    have = graph.searched_avoided(links, starts).collect()
    assert have and sorted(map(tuple, have)) == sorted(map(tuple, want))


def test_paths_of_rain_meet_their_corners_once(spark):
    """steps have four rows a cell (the corners) or one a cell and lead, not four a cell and lead; holes and ends beyond the frame included."""
    h, w, rates = 12, 9, {}
    for r in range(h):
        for c in range(w):
            if (r, c) != (5, 4):
                rates[r, c] = float((r * 7 + c * 3) % 11)
    at = lambda r, c: (0.02 * (r - 4), 0.013 * (c - 3))
    field = spark.createDataFrame([(r, c, v, *at(r, c)) for (r, c), v in rates.items()], "r int, c int, rate_mmh double, u double, v double")
    leads = spark.createDataFrame([(30 * k,) for k in range(4)], "lead_minutes int")
    found = nowcast.advected(field, leads, decay=None)
    have = {(x.lead_minutes, x.r, x.c): x.rate_mmh for x in found.collect()}
    for lead in (0, 30, 60, 90):
        for r, c in rates:
            u, v = at(r, c)
            x, y = min(max(c - u * lead * 2, 0.0), w - 1.0), min(max(r - v * lead * 2, 0.0), h - 1.0)
            x0, y0 = int(x), int(y)
            want = sum(rates.get((y0 + dy, x0 + dx), 0.0) * (x - x0 if dx else 1 - x + x0) * (y - y0 if dy else 1 - y + y0) for dy in (0, 1) for dx in (0, 1))
            assert abs(have.pop((lead, r, c)) - want) < 1e-9
    assert not have and most_rows(found) <= 4 * h * w
    asked = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "request string, method string")
    cells = found.withColumn("method", F.lit("x")).unionByName(found.withColumn("method", F.lit("y")))
    rows = lambda **k: sorted(map(tuple, fields.dispatched_methods(asked, cells, "y", **k).collect()))
    assert rows(methods=("x", "y")) == rows() and len(rows()) == 3 * 4 * len(rates)


def test_unfolded_roads_keep_their_partitions(spark):
    """F16: roads that unfold to many rows stay in all partitions of a shuffle, small as they are before; the lines are moved once more for nothing else."""
    segments = spark.range(300).selectExpr("id AS road_id", "CAST(id % 20 AS INT) AS r1", "0 AS c1", "CAST(id % 20 AS INT) AS r2", "9 AS c2")
    depth = spark.range(200).selectExpr("'N' AS scenario_id", "0 AS lead_minutes", "CAST(id div 10 AS INT) AS r", "CAST(id % 10 AS INT) AS c", "0.1D AS depth_m")
    found = roads.sampled_roads(segments, depth)
    assert found.count() == found.distinct().count() == 3000
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(spark, name: str, run):
    """What `run` gives, with its jobs and the tasks that ran."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(name)
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    return found, len(jobs), sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def chain_of(spark, n: int) -> tuple[DataFrame, DataFrame]:
    edges = spark.range(n - 1).selectExpr("'m' AS mode", "id AS n1", "id + 1 AS n2", "5L AS cost_ms", "1.0D AS length_m", "0.0D AS depth_m")
    return edges, spark.createDataFrame([("m", 0)], "mode string, origin long")


def test_rounds_share_jobs_and_have_a_task_a_core(spark):
    """a chain of n nodes takes a job for some rounds and one for all paths, a stage a round, and tasks by cores, not by shuffle partitions; nothing stays in the shared folder but the rows."""
    n, cores, kept = 40, spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    from rillspark.functions.shared import shared_root

    left = lambda: {p.name for p in Path(shared_root(spark)).glob("rillspark_searches_*")}
    before = left()
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        rows, jobs, tasks = grouped(spark, "shared rounds", lambda: graph.shortest_paths(*chain_of(spark, n), text=True).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert {(r.node, r.cost_ms, r.hops, r.path) for r in rows} == {(k, 5 * k, k, ">".join(map(str, range(k + 1)))) for k in range(n)}
    assert jobs <= n // 2 and tasks <= cores * (2 * n + 40)
    assert left() == before


def test_routes_of_two_modes_are_compared_without_paths(spark, monkeypatch):
    """the rows are those of joined paths, also with ties, parallel edges, origins of one mode only and two rounds of origins; no path is written."""
    rng = random.Random(11)
    ways = [(m, a, b, rng.randint(1, 4), 0.5 * rng.randint(1, 9), 0.1) for m in ("baseline", "flood_aware") for a in range(40) for b in (rng.randrange(40), a // 2, a // 2) if m == "baseline" or rng.random() < 0.7]
    links = graph.both_ways(spark.createDataFrame([*ways, ("baseline", 90, 91, 1, 1.0, 0.1)], "mode string, n1 long, n2 long, cost_ms long, length_m double, depth_m double"))
    starts = spark.createDataFrame([("baseline", o) for o in (*range(36), 90)] + [("flood_aware", o) for o in range(2, 40)], "mode string, origin long")
    want = graph.compared_routes(graph.shortest_paths(links, starts)).collect()
    written, settled = [], graph.settled

    def counted(df, name, *by):
        table = settled(df, name, *by)
        written.append((name, "path" in table.columns))
        return table

    monkeypatch.setattr(graph, "settled", counted)
    have = graph.searched_routes(links, starts).collect()
    key = lambda r: (r.origin, r.node)
    assert sorted(map(tuple, have)) == sorted(map(tuple, want)) if None not in {x for r in want for x in r} else sorted(have, key=key) == sorted(want, key=key)
    assert {r.status for r in have} == {"NO_SAFE_ROUTE", "UNCHANGED", "REROUTED"} and set(written) == {("routes", False)}


@pytest.mark.parametrize("name", ["g5_vehicle_routes", "g8_soft_routes", "j21_avoided_roads"])
def test_searches_of_a_query_have_a_task_a_core(spark, sf_dir, name):
    """rounds and lengths of paths don't take a task for each shuffle partition."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        _, jobs, tasks = grouped(spark, f"tasks of {name}", lambda: q_graph.QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    print(name, jobs, tasks)
    assert jobs <= 30 and tasks <= 900
