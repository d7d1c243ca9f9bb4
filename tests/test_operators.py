"""Boundary vectors, invariants and small brute-force checks of the flood operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.functions import policy
from rillspark.operators import audit, gauges, graph, nowcast, roads, scores, storms


def walked(r1, c1, r2, c2):
    """Bresenham's line, step by step."""
    dr, dc = abs(r2 - r1), abs(c2 - c1)
    sr, sc = (r2 > r1) - (r2 < r1), (c2 > c1) - (c2 < c1)
    n, m = max(dr, dc), min(dr, dc)
    out, off = [], 0
    for i in range(n + 1):
        if n and i:
            while 2 * i * m - 2 * off * n > n:
                off += 1
        out.append((r1 + sr * i, c1 + sc * off) if dr >= dc else (r1 + sr * off, c1 + sc * i))
    return out


def test_road_cells_against_a_walk(spark):
    rng = random.Random(3)
    ends = [(k, *(rng.randrange(40) for _ in range(4))) for k in range(150)] + [(900, 5, 5, 5, 5), (901, 0, 0, 0, 9), (902, 9, 3, 0, 3)]
    found = {}
    for r in roads.road_cells(spark.createDataFrame(ends, "road_id long, r1 int, c1 int, r2 int, c2 int")).orderBy("road_id", "i").collect():
        found.setdefault(r.road_id, []).append((r.r, r.c))
    for k, r1, c1, r2, c2 in ends:
        assert found[k] == walked(r1, c1, r2, c2), (k, r1, c1, r2, c2)


@pytest.mark.parametrize(("depth", "name"), [(0.0, "DRY"), (0.05, "DRY"), (0.0501, "LOW_IMPACT"), (0.15, "LOW_IMPACT"), (0.30, "CAUTION"), (0.5, "HIGH_IMPACT"), (0.51, "IMPASSABLE"), (None, None)])
def test_classes(spark, depth, name):
    assert spark.range(1).select(policy.impact_class(F.lit(depth).cast("double")).alias("c")).first().c == name


def test_half_flooded_road(spark):
    segment = spark.createDataFrame([(1, 0, 0, 0, 9, 100.0, "local")], "road_id long, r1 int, c1 int, r2 int, c2 int, length_m double, road_class string")
    depth = spark.createDataFrame([("S", 0, 0, c, 0.4 if c < 5 else 0.0) for c in range(10)], "scenario_id string, lead_minutes int, r int, c int, depth_m double")
    row = roads.road_impact(segment, depth).first()
    assert (row.n_cells, row.impacted_fraction, row.impacted_length_m, row.classification, row.passability) == (10, 0.5, 50.0, "HIGH_IMPACT", "PASSABLE")


def frame(spark, values, n=0):
    return [(n, r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]


def test_gradients_and_motion_against_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((7, 9)) * 5, rng.random((7, 9)) * 5
    frames = spark.createDataFrame(frame(spark, a) + frame(spark, b, 1), "frame int, r int, c int, rate_mmh double")
    gy, gx = np.gradient(b)
    got = {(r.r, r.c): (r.gx, r.gy) for r in nowcast.gradients(frames).where("frame = 1").collect()}
    assert all(math.isclose(got[r, c][0], gx[r, c], abs_tol=1e-9) and math.isclose(got[r, c][1], gy[r, c], abs_tol=1e-9) for r in range(7) for c in range(9))


def test_advection_moves_whole_cells(spark):
    field = np.zeros((8, 8))
    field[3, 3] = 10
    cells = spark.createDataFrame([(r, c, v, 0.1, 0.0) for _, r, c, v in frame(spark, field)], "r int, c int, rate_mmh double, u double, v double")
    leads = spark.createDataFrame([(0,), (10,)], "lead_minutes int")  # 0.1 m/s for 600 s are two cells of 30 m
    got = {(r.lead_minutes, r.r, r.c): r.rate_mmh for r in nowcast.advected(cells, leads, decay=None).collect()}
    assert got[0, 3, 3] == 10 and math.isclose(got[10, 3, 5], 10, abs_tol=1e-9) and math.isclose(sum(v for (t, *_), v in got.items() if t == 10), 10, abs_tol=1e-6)


def test_resampling_a_plane_is_exact(spark):
    plane = [[2.0 * r + 3.0 * c for c in range(6)] for r in range(5)]
    got = nowcast.resampled(spark.createDataFrame(frame(spark, plane), "frame int, r int, c int, rate_mmh double"), 9, 11).collect()
    assert len(got) == 99 and all(math.isclose(r.rate_mmh, 2 * r.r * 4 / 8 + 3 * r.c * 5 / 10, abs_tol=1e-9) for r in got)


def test_fraction_skill_against_loops(spark):
    rng = np.random.default_rng(6)
    f, o = rng.random((9, 8)) * 2, rng.random((9, 8)) * 2
    pairs = spark.createDataFrame([(r, c, float(f[r, c]), float(o[r, c])) for r in range(9) for c in range(8)], "r int, c int, f double, o double")

    def share(x):
        p = np.pad((x >= 1).astype(float), 2)
        return np.array([[p[r : r + 5, c : c + 5].mean() for c in range(8)] for r in range(9)])

    a, b = share(f), share(o)
    assert math.isclose(scores.fraction_skill(pairs).first().fss, 1 - ((a - b) ** 2).mean() / ((a**2).mean() + (b**2).mean()), abs_tol=1e-6)


def test_perfect_series_has_no_loss(spark):
    rows = spark.createDataFrame([("x", t, math.sin(t) + 2, math.sin(t) + 2) for t in range(30)], "k string, t int, o double, s double")
    fit = scores.hydrograph_fit(rows, "k").first()
    assert (fit.nse, fit.kge, fit.loss, fit.tpe_minutes) == (1.0, 1.0, 0.0, 0.0)


def test_rain_rate_and_back(spark):
    r = spark.createDataFrame([(5.0,), (10.0,), (40.0,), (70.0,), (float("nan"),), (None,)], "z double").select(gauges.rain_rate(F.col("z")).alias("r")).collect()
    assert r[0].r == 0 and r[1].r > 0 and math.isclose(r[2].r, (10**4 / 300) ** (1 / 1.4)) and math.isclose(r[3].r, (10**5.5 / 300) ** (1 / 1.4)) and r[4].r == r[5].r == 0


def test_hyetographs_keep_their_total(spark):
    given = spark.createDataFrame([(k, 90.0, n, 15) for k, n in enumerate((2, 3, 8, 12, 13))], "storm_id int, total_mm double, n int, minutes int")
    blocks = storms.alternating_blocks(given)
    for r in blocks.groupBy("storm_id").agg(F.sum(F.col("rate_mmh") / 4).alias("mm"), F.countDistinct("slot").alias("slots"), F.count("slot").alias("n"), F.max("slot").alias("last")).collect():
        assert math.isclose(r.mm, 90, abs_tol=1e-3) and r.slots == r.n == r["last"] + 1


def test_first_wins_against_a_scan(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["", *map(str, range(12))]), str(rng.randrange(15))) for k in range(60)]
    ids, shapes, expected = set(), set(), {}
    for k, i, g in rows:
        expected[k] = "DUPLICATE_ID" if i and i in ids else "DUPLICATE_GEOMETRY" if g in shapes else "KEPT"
        if expected[k] == "KEPT":
            shapes.add(g)
            ids |= {i} - {""}
    got = {r.ord: r.decision for r in audit.first_wins(spark.createDataFrame(rows, "ord long, source_id string, geometry_key string")).collect()}
    assert {k: v == "KEPT" for k, v in got.items()} == {k: v == "KEPT" for k, v in expected.items()}


def test_paths_against_dijkstra(spark):
    rng = random.Random(2)
    edges = [(a, b, 1, float(rng.randrange(50, 900)), 36.0, 0.0) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.3]
    directed = graph.both_ways(spark.createDataFrame(edges, "n1 int, n2 int, road_id int, length_m double, speed_kmh double, depth_m double"))
    got = {r.node: r.cost_ms for r in graph.shortest_paths(graph.flood_costs(directed).where("mode = 'baseline'"), spark.createDataFrame([("baseline", 0)], "mode string, origin int")).collect()}
    best = {0: 0}
    for _ in range(12):
        for a, b, _, m, _, _ in edges:
            for x, y in ((a, b), (b, a)):
                if x in best and best[x] + round(m * 100) < best.get(y, 1 << 60):
                    best[y] = best[x] + round(m * 100)
    assert got == best


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
