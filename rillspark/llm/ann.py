"""Approximate nearest neighbours by an adaptive dimension scan inside probed lists.

Index: k-means centroids and a random rotation are fitted on a bounded sample (SAMPLE vectors); every vector is assigned to the list
of its nearest centroid. There are about sqrt(n) / 2 lists at every size: beyond COARSE centroids, which is what the sample can tell apart,
each list is divided by the centroids of what is left of the sample's vectors after their centroid is taken away. Lists are dealt out in blocks
of BLOCK vectors, so that no list, however hot, meets in one task.

Search, in two rounds. First, each query scans its nearest list, which gives a first bound: its k-th smallest distance there.
Then it scans its other lists. A query goes to the blocks of the lists that it probes, never a block to queries: a task holds one block
and lets its queries stream by. A scan keeps rotated vectors in blocks of COLUMNS dimensions: after each block, a hypothesis test on
the partial distance (a partial distance of a rotated vector is, scaled up, an estimate of the whole) abandons candidates that
are beyond the bound. What is left is measured exactly, in double precision, on the original vectors.

How many lists a query probes is set by the sample: as few as reach RECALL there, and as hold k vectors.

Results for odd input: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows with a null id; ids are integers, or texts of integers; ties go to the smaller id; rows with the same id and vector
are candidates each for itself; with fewer candidates than k all that are found are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import hashed_sample, scratch, written

SAMPLE, RECALL = 20_000, 0.99
COARSE, BLOCK = 1024, 4096
COLUMNS = 16
#: The test's width: a candidate within the bound is abandoned in about one case of a thousand at most.
WIDTH = 2.1


@dataclasses.dataclass
class Index:
    """Centroids (in rotated space), the rotation, and for each list how many vectors it holds."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sizes: np.ndarray | None = None

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.rotation).astype(np.float32)

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector, the lists from near to far."""
        r = self.rotated(vectors)
        return np.argsort((self.centroids**2).sum(axis=1)[None] - 2 * r @ self.centroids.T, axis=1, kind="stable")

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        r = self.rotated(vectors)
        return ((self.centroids**2).sum(axis=1)[None] - 2 * r @ self.centroids.T).argmin(axis=1)


def valid(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _means(y: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """k-means, ten rounds from random rows."""
    centroids = y[rng.choice(len(y), lists, replace=False)]
    for _ in range(10):
        own = ((centroids**2).sum(axis=1)[None] - 2 * y @ centroids.T).argmin(axis=1)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros(centroids.shape, np.float64)
        np.add.at(sums, own, y)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, which are of one length and without nulls."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit(rows: DataFrame, k: int, recall: float = RECALL, sample: int = SAMPLE, coarse: int = COARSE) -> Index:
    """An index for rows of (id, vector); at most `sample` vectors go to the driver."""
    n = rows.count()
    seen = hashed_sample(rows, "id", sample).toPandas()
    x = _stacked(seen["vector"]) if len(seen) else np.zeros((0, 1))
    d = x.shape[1]
    rng = np.random.default_rng(7)
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    y = (x @ rotation).astype(np.float32)
    if not len(y):
        return Index(rotation, np.zeros((1, d), np.float32), 1)
    wanted, distinct = max(8, int(np.sqrt(n) / 2)), len(np.unique(y, axis=0))
    centroids = _means(y, min(wanted, coarse, distinct), rng)
    parts = min(-(-wanted // len(centroids)), distinct) if wanted > coarse else 1
    if parts > 1:
        left = y - centroids[((centroids**2).sum(axis=1)[None] - 2 * y @ centroids.T).argmin(axis=1)]
        centroids = (centroids[:, None] + _means(left, parts, rng)[None]).reshape(-1, d)
    lists = len(centroids)
    index = Index(rotation, centroids, lists)
    own = index.nearest(x)
    ask = rng.choice(len(y), min(256, len(y)), replace=False)
    far = (y[ask] ** 2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * y[ask] @ y.T
    far[np.arange(len(ask)), ask] = np.inf
    near = np.argpartition(far, min(k, len(y) - 1), axis=1)[:, :k]
    place = np.empty((len(ask), lists), np.int64)
    np.put_along_axis(place, index.ranked(x[ask]), np.arange(lists)[None].repeat(len(ask), 0), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    index.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1
    return index


def _assigned(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = index.nearest(_matrix(batch.column("vector")))
                yield pa.record_batch([batch.column("id"), batch.column("vector"), pa.array(own, pa.int32())], names=["id", "vector", "list"])

    return run


def _in_blocks(index: Index):
    """Vectors with the block of their list that they fall into, by a hash of their id."""
    blocks = np.maximum(1, -(-index.sizes // BLOCK)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = (batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = mixed % blocks[batch.column("list").to_numpy()]
            yield pa.record_batch([batch.column("id"), batch.column("vector"), pa.nulls(batch.num_rows, pa.float64()), batch.column("list"), pa.array(block.astype(np.int32))], names=["id", "vector", "bound", "list", "block"])

    return run


def _probed(index: Index, k: int, first: bool):
    """(id, vector, bound, list, block): where a query looks; its nearest list, or the others."""
    blocks = np.maximum(1, -(-index.sizes // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                order = index.ranked(_matrix(part.column("vector")))
                rows, lists, dealt = [], [], []
                for q, near in enumerate(order):
                    enough = int(np.searchsorted(np.cumsum(index.sizes[near]), k + 1)) + 1
                    probes = near[:1] if first else near[1 : max(index.probes, enough)]
                    for l in probes.tolist():
                        n = int(blocks[l])
                        rows += [q] * n
                        lists += [l] * n
                        dealt += range(n)
                take = pa.array(rows, pa.int64())
                yield pa.record_batch([part.column(c).take(take) for c in ("id", "vector", "bound")] + [pa.array(lists, pa.int32()), pa.array(dealt, pa.int32())], names=["id", "vector", "bound", "list", "block"])

    return run


def scan(index: Index, query: np.ndarray, bound: float, ids: np.ndarray, vectors: np.ndarray, turned: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """The k nearest of a block, as far as the tests let them through: (id, distance), ties to the smaller id."""
    d = turned.shape[1]
    q = index.rotated(query[None])[0]
    left = np.flatnonzero(ids != own)
    partial = np.zeros(len(left), np.float64)
    square = bound * bound
    for a in range(0, d, COLUMNS):
        b = min(d, a + COLUMNS)
        partial += ((turned[left, a:b] - q[a:b]) ** 2).sum(axis=1)
        if np.isinf(square) and b < d:
            continue
        most = square * (1 + WIDTH / np.sqrt(b)) ** 2 * b / d if b < d else square * (1 + 1e-5) + 1e-12
        stay = partial <= most
        left, partial = left[stay], partial[stay]
        if not len(left):
            return []
    if len(left) > 4 * k:  # rounding of 32-bit sums must not decide: a margin around the k-th stays
        kth = np.partition(partial, k - 1)[k - 1]
        left = left[partial <= kth * (1 + 1e-4) + 1e-9]
    exact = np.sqrt(((vectors[left] - query) ** 2).sum(axis=1))
    best = np.lexsort((ids[left], exact))[:k]
    return [(int(ids[left[i]]), float(exact[i])) for i in best]


def _scanned(index: Index, k: int):
    """Rows come sorted by (list, block), and in each block its vectors before the queries; so one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors = None, [], []
        block: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, blocks, asks, own, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "block", "asks", "id", "bound"))
            rows, out = _matrix(batch.column("vector")), []
            starts = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]) | (blocks[1:] != blocks[:-1])])
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if here != (lists[a], blocks[a]):
                    here, ids, vectors, block = (lists[a], blocks[a]), [], [], None
                first = a + int(np.count_nonzero(~asks[a:b]))
                if first > a:
                    ids.append(own[a:first])
                    vectors.append(rows[a:first])
                if first < b and ids:
                    if block is None:
                        stacked = np.concatenate(vectors)
                        block = np.concatenate(ids), stacked, index.rotated(stacked)
                    for q in range(first, b):
                        out += [(own[q], i, s) for i, s in scan(index, rows[q], bound[q], *block, own[q], k)]
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found for each row where `queries` holds, itself left out."""
    with scratch(vectors.sparkSession):
        return _neighbours(vectors, queries, k, id_col, vector_col, recall)


def _neighbours(vectors: DataFrame, queries: Column, k: int, id_col: str, vector_col: str, recall: float) -> DataFrame:
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    usual = named.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = named.where(F.size("vector") == (usual["d"] if usual else 0))
    index = fit(rows.select("id", "vector"), k, recall)
    owned = written(rows.select("id", "vector").mapInArrow(_assigned(index), "id long, vector array<double>, list int"), "lists")
    index.sizes = np.zeros(len(index.centroids), np.int64)
    for r in owned.groupBy("list").count().collect():  # one row a list
        index.sizes[r["list"]] = r["count"]
    asking = written(rows.where("asks").select("id", "vector", F.lit(float("inf")).alias("bound")), "queries")
    dealt = owned.mapInArrow(_in_blocks(index), "id long, vector array<double>, bound double, list int, block int")
    schema = "id long, vector array<double>, bound double, list int, block int"

    def searched(asks: DataFrame, first: bool, round_name: str) -> DataFrame:
        both = dealt.withColumn("asks", F.lit(False)).unionByName(asks.mapInArrow(_probed(index, k, first), schema).withColumn("asks", F.lit(True)))
        keys = ("list", "block")
        return written(both.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(_scanned(index, k), "query_id long, vec_id long, score double"), round_name)

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = searched(asking, True, "near")
    bounds = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    again = asking.join(written(bounds, "bounds").hint("merge"), "id", "left").select("id", "vector", F.coalesce("least", "bound").alias("bound"))
    found = near.unionByName(searched(written(again, "again"), False, "far"))
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return written(ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score"), "neighbours", keep=True)
