"""Clustering around centroids in exact integers, with a filter in PCA-rotated space.

Vectors become integers, floor(scale * x). A rotation along the principal axes (of all vectors: sums and products are added up by
Spark) gathers most of the variance in the leading coordinates. For each vector its LEADING rotated coordinates and the norm of the
rest are stored. For a vector x and a centroid c, |x - c|^2 is at least the squared distance of the leading coordinates plus the squared
difference of the two norms, so that a product of narrow matrices rules out most centroids. What survives is measured in integers, and
the assignment is exact, ties included: the bound is lowered by more than rounding can raise it.

A round is one pass over the written table: each task sends one sum a centroid (not a row a vector), Spark adds these up, and the driver
gets `k` rows. So a cluster of a third of all vectors costs no task more than others.

Results for odd input: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a
component beyond +-MOST / scale, whose squared distances may not fit in 64 bits; a null id sorts last among the hashes; rows with the same id and vector
are vectors each for itself; with fewer vectors than `k` there are as many centroids as vectors; ties go to the smaller number; a centroid without
vectors stays where it is; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import scratch, written

#: Largest integer of a component: 64 squares of differences of twice this size fit in 63 bits.
MOST = 1 << 27
LEADING = 16
#: Pairs of a vector and a surviving centroid that are measured at a time, and vectors whose bounds are held at a time.
PAIRS, ROWS = 1 << 15, 4096


@dataclasses.dataclass
class Rotation:
    """Mean and principal axes; the leading ones first."""

    mean: np.ndarray
    axes: np.ndarray
    leading: int

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the others."""
        turned = (vectors - self.mean) @ self.axes
        return turned[:, : self.leading], np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(kind, copy=False)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """id and v (integers) of the vectors that take part."""
    fits = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(MOST) / scale))  # noqa: E731  false for what is not finite
    real = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & (F.size("x") == size))
    return real.where(F.forall("x", fits)).select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def _seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; of rows with one id, the smaller vector first."""
    place = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last(place), "v").select("v").limit(k).collect()], np.int64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task adds to count, sums and products: one row for each place."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.c_[np.ones(batch.num_rows), _matrix(batch.column("v"), np.float64)]
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"])


def rotation(rows: DataFrame, size: int, leading: int = LEADING) -> Rotation:
    """Principal axes of all rows. The driver gets (size + 1)^2 numbers; any rotation gives right bounds, so rounding here does no harm."""
    found = rows.select("v").mapInArrow(_moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((size + 1) ** 2)
    for r in found:
        total[r["place"]] = r["value"]
    total = total.reshape(size + 1, size + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    _, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return Rotation(mean, axes[:, ::-1].copy(), min(leading, size))


def _stored(turn: Rotation):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lead, rest = turn.of(_matrix(batch.column("v"), np.float64))
            ends = pa.array(np.arange(0, lead.size + 1, lead.shape[1]), pa.int32())
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), pa.array(rest)], names=["id", "v", "lead", "rest"])

    return run


def _measured(v: np.ndarray, centroids: np.ndarray, row: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances in integers, PAIRS at a time."""
    out = np.empty(len(row), np.int64)
    for a in range(0, len(row), PAIRS):
        apart = v[row[a : a + PAIRS]] - centroids[centroid[a : a + PAIRS]]
        out[a : a + PAIRS] = np.einsum("ij,ij->i", apart, apart)
    return out


def nearest(turn: Rotation, centroids: np.ndarray, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid (ties: smaller number) and its squared distance, and how many pairs were measured."""
    c_lead, c_rest = turn.of(centroids.astype(np.float64))
    own, least, measured = np.empty(len(v), np.int64), np.empty(len(v), np.int64), 0
    for a in range(0, len(v), ROWS):
        part, x, r = v[a : a + ROWS], lead[a : a + ROWS], rest[a : a + ROWS]
        size = (x**2).sum(axis=1) + r**2
        bound = (x**2).sum(axis=1)[:, None] + (c_lead**2).sum(axis=1)[None] - 2 * x @ c_lead.T + (r[:, None] - c_rest[None]) ** 2
        bound -= 1e-9 * (size[:, None] + ((c_lead**2).sum(axis=1) + c_rest**2)[None]) + 1e-6  # far more than rounding
        first = bound.argmin(axis=1)
        here = np.arange(len(part))
        upper = _measured(part, centroids, here, first)
        left = bound <= upper[:, None]
        left[here, first] = False
        row, centroid = np.nonzero(left)
        row, centroid = np.r_[here, row], np.r_[first, centroid]
        far = np.r_[upper, _measured(part, centroids, row[len(part) :], centroid[len(part) :])]
        order = np.lexsort((centroid, far, row))
        best = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        own[a : a + ROWS], least[a : a + ROWS] = centroid[best], far[best]
        measured += len(row)
    return own, least, measured


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(batch.column("v"), np.int64), _matrix(batch.column("lead"), np.float64), batch.column("rest").to_numpy()


def _summed(turn: Rotation, centroids: np.ndarray):
    """What a task adds to the centroids: rows of place (centroid times (components + 1), plus component) and sum; after the components comes the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                v, lead, rest = _columns(batch)
                own, _, _ = nearest(turn, centroids, v, lead, rest)
                order = np.argsort(own, kind="stable")
                some, starts = np.unique(own[order], return_index=True)
                sums[some, :-1] += np.add.reduceat(v[order], starts, axis=0)
                sums[some, -1] += np.diff(np.r_[starts, len(own)])
        places = np.flatnonzero(np.repeat(sums[:, -1] > 0, sums.shape[1]))
        yield pa.record_batch([pa.array(places, pa.int32()), pa.array(sums.ravel()[places])], names=["place", "value"])

    return run


def _moved(rows: DataFrame, turn: Rotation, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each component. The driver gets one number a centroid and component."""
    added = rows.mapInArrow(_summed(turn, centroids), "place int, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = {r["place"]: int(r["value"]) for r in added}
    moved, width = centroids.copy(), centroids.shape[1] + 1
    for c in range(len(centroids)):
        if n := found.get((c + 1) * width - 1):
            moved[c] = [found[c * width + i] // n for i in range(width - 1)]
    return moved


def _assigned(turn: Rotation, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, least, _ = nearest(turn, centroids, *_columns(batch))
                yield pa.record_batch([batch.column("id"), pa.array(own, pa.int32()), pa.array(least)], names=["id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, k: int, rounds: int, salt: str, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 256, leading: int = LEADING) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every vector that takes part."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    id_column: Column = F.col("id").alias(id_col)
    with scratch(spark):
        kept = written(whole_numbers(vectors, id_col, vector_col, size, scale), "integers")
        centroids = _seeds(kept, k, salt)
        if not len(centroids):
            return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        turn = rotation(kept, size, leading)
        rows = written(kept.mapInArrow(_stored(turn), f"id {kind}, v array<int>, lead array<double>, rest double"), "rotated")
        for _ in range(rounds):
            centroids = _moved(rows, turn, centroids)
        found = written(rows.mapInArrow(_assigned(turn, centroids), f"id {kind}, cluster int, distance long"), "assigned", keep=True)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()  # one row a centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = sum(r["cluster_inertia"] for r in sums)
    about = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, names[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int, rounds: int, salt: str, size: int = 64, scale: int = 256) -> str:
    """The same in SQL: every distance of every round."""
    near = """n{r} AS (
  SELECT row_id, cluster, distance FROM (
    SELECT row_id, cluster, distance, row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) AS place FROM (
      SELECT row_id, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(t.v, c.v)])::BIGINT AS distance FROM t CROSS JOIN c{r} AS c)) WHERE place = 1
)"""
    move = """c{s} AS (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
    SELECT cluster, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT n{r}.cluster, i, sum(t.v[i]) AS total, count(*)::HUGEINT AS n FROM n{r} JOIN t USING (row_id) CROSS JOIN range(1, {end}) AS r(i) GROUP BY n{r}.cluster, i) GROUP BY cluster) AS m USING (cluster)
)"""
    steps = [
        f"""k AS (
  SELECT vec_id, [e::DOUBLE for e in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {size}
), t AS (
  SELECT row_number() OVER () AS row_id, vec_id, [floor({scale} * e)::BIGINT for e in x] AS v FROM k
  WHERE len([e for e in x if e IS NOT NULL AND abs(e) < {MOST / scale}]) = {size}
)""",
        f"""c0 AS (SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS cluster, v FROM (SELECT sha256('{salt}' || vec_id::VARCHAR) AS h, v FROM t ORDER BY h NULLS LAST, v LIMIT {k}))""",
    ]
    for r in range(rounds):
        steps += [near.format(r=r), move.format(r=r, s=r + 1, end=size + 1)]
    steps.append(near.format(r=rounds))
    return f"""WITH {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT t.vec_id, n.cluster, n.distance, sum(n.distance) OVER (PARTITION BY n.cluster)::BIGINT AS cluster_inertia, sum(n.distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM n{rounds} AS n JOIN t USING (row_id) JOIN c{rounds} AS c USING (cluster)"""
