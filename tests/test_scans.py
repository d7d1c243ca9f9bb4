"""Greedy scans over long chains, and nearest nodes on odd points."""

from __future__ import annotations

import random

import pytest

from rillspark.operators import audit, frames


def scanned(rows):
    ids, keys, out = set(), set(), {}
    for o, i, g in sorted(rows):
        i = i or None
        out[o] = "DUPLICATE_ID" if i is not None and i in ids else "DUPLICATE_GEOMETRY" if g is not None and g in keys else "KEPT"
        if out[o] == "KEPT":
            ids |= {i} - {None}
            keys |= {g} - {None}
    return out


def decided(spark, rows, **more):
    return {r.ord: r.decision for r in audit.first_wins(spark.createDataFrame(rows, "ord long, source_id string, geometry_key string").repartition(3), **more).collect()}


def chain(n):
    """Neighbours share an id and a geometry in turn, so that each waits for the one before."""
    return [(k, f"i{(k + 1) // 2}", f"g{k // 2}") for k in range(n)]


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    rounds, honest = [], audit.settled
    monkeypatch.setattr(audit, "settled", lambda df, name: rounds.append(name) or honest(df, name))
    rows = chain(10_000)
    assert decided(spark, rows) == scanned(rows)
    assert rounds.count("marked") < 20


@pytest.mark.parametrize("most", [0, 5, 100_000])
def test_scan_and_rounds_agree(spark, most):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, "", *(f"i{j}" for j in range(40))]), rng.choice([None, *(f"g{j}" for j in range(40))])) for k in range(120)] + [(1000 + o, f"c{i}", f"c{g}") for o, i, g in chain(9)]
    assert decided(spark, rows, scanned=most) == scanned(rows)
    assert decided(spark, [(7, None, None)], scanned=most) == {7: "KEPT"} and decided(spark, [], scanned=most) == {}


def test_nearest_nodes_on_odd_points(spark):
    rng = random.Random(1)
    nodes = [(k, rng.uniform(-500, 500), rng.uniform(-500, 500)) for k in range(60)] + [(900, 1e6, 1e6), (901, None, 3.0), (902, float("nan"), 3.0)]
    points = [(k, rng.uniform(-800, 800), rng.uniform(-800, 800)) for k in range(80)] + [(500, None, 1.0), (501, 1.0, float("nan")), (502, 9e5, 9e5), (503, -4e5, 7.0)]
    found = {r.point_id: r.node for r in frames.nearest_nodes(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "node long, nx double, ny double"), 4.0).collect()}
    good = [n for n in nodes if n[1] is not None and n[1] == n[1]]
    want = {p: min(good, key=lambda n: ((x - n[1]) ** 2 + (y - n[2]) ** 2, n[0]))[0] for p, x, y in points if p not in (500, 501)}
    assert found == want
    empty = spark.createDataFrame([], "node long, nx double, ny double")
    assert frames.nearest_nodes(spark.createDataFrame(points, "point_id long, x double, y double"), empty, 4.0).count() == 0
