"""Clustering in integers against Python's whole numbers, and the bounds of the filter."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from rillspark.llm import centroids

SCHEMA = "cluster string, vec_id long, embedding array<float>, distance string"


def plain(rows, k, rounds, salt, size):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{salt}{i}".encode()).hexdigest()
    seeds = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]
    places = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(places))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        places = [[sum(col) // len(col) for col in zip(*part, strict=True)] if (part := [v for (_, v), o in zip(kept, own, strict=True) if o == n]) else c for n, c in enumerate(places)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    sums = {n: sum(d for _, c, d in found if c == n) for n in range(len(places))}
    return [(i, n, d, sums[n], total, hashlib.sha256(",".join(map(str, places[n])).encode()).hexdigest()) for i, n, d in found]


def test_against_whole_numbers(spark):
    """Ties, repeated rows, nulls, short, broken and empty vectors, negative numbers on the border of a step."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-6, 7, 8).astype(float) / 256 * rng.choice([1, 2])) for i in range(300)]
    rows = [(i, v.tolist()) for i, v in rows] + [(7, rows[7][1].tolist()), (7, [0.0] * 8), (None, [1 / 512] * 8), (None, [-1 / 512] * 8)]
    rows += [(400, None), (401, []), (402, [0.5] * 7), (403, [float("nan"), *[0.0] * 7]), (404, [float("inf"), *[0.0] * 7]), (405, [None, *[0.0] * 7]), (406, [1.0] * 8), (-9, [1.0] * 8)]
    frame = spark.createDataFrame([("c", i, v, "d") for i, v in rows], SCHEMA).repartition(5)
    order = lambda r: tuple((x is None, str(x)) for x in r)
    for leading in (1, 3, 8, 16):
        found = [tuple(r) for r in centroids.clustered(frame, 6, 3, "2:", size=8, leading=leading).collect()]
        assert sorted(found, key=order) == sorted(plain(rows, 6, 3, "2:", 8), key=order)


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([("c", 1, [0.5, 0.25], "d"), ("c", 2, [0.5, 0.25], "d")], SCHEMA)
    found = centroids.clustered(frame, 40, 2, "2:", size=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in found] == [(0, 0, 0)] * 2
    empty = centroids.clustered(frame.where("vec_id > 5"), 40, 2, "2:", size=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("leading", [1, 4, 12])
def test_filter_never_loses_the_nearest(leading):
    """Whatever the rotation, the nearest is found, and with a fitting one most pairs are never measured."""
    rng = np.random.default_rng(11)
    middle = rng.integers(-4000, 4000, (25, 12))
    v = middle[rng.integers(0, 25, 5000)] + rng.integers(-60, 60, (5000, 12))
    places = np.r_[middle[:20], middle[:3], v[:5]]
    _, axes = np.linalg.eigh(np.cov(v.T))
    for turn, fitting in ((centroids.Rotation(v.mean(axis=0), axes[:, ::-1].copy(), leading), True), (centroids.Rotation(np.zeros(12), np.linalg.qr(rng.normal(size=(12, 12)))[0], leading), False)):
        lead, rest = turn.of(v.astype(float))
        own, least, measured = centroids.nearest(turn, places, v, lead, rest)
        far = ((v[:, None] - places[None]) ** 2).sum(axis=2)
        assert (own == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
        if fitting and leading > 1:
            assert measured < 0.35 * far.size


def test_large_numbers_are_exact():
    v = np.array([[centroids.MOST - 1] * 64, [-centroids.MOST] * 64], np.int64)
    turn = centroids.Rotation(np.zeros(64), np.eye(64), 16)
    lead, rest = turn.of(v.astype(float))
    own, least, _ = centroids.nearest(turn, v[:1], v, lead, rest)
    assert own.tolist() == [0, 0] and least.tolist() == [0, 64 * (2 * centroids.MOST - 1) ** 2]
