"""Connected components by alternating large-star and small-star.

Before the first round, each task replaces its edges by a spanning forest of stars (union-find over at most EDGES of them at a
time), so that long chains inside a task and repeated edges cost no rounds. The rounds end as soon as the edges are stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import scratch, written

#: Edges that a task holds at a time while it makes forests of them.
EDGES = 1 << 18


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components by fewer edges: each node with the smallest of its component among these edges."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        kind = table.schema.field("u").type
        ends = [table.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")]
        names, codes = np.unique(np.concatenate(ends), return_inverse=True)
        root = list(range(len(names)))
        for x, y in codes.reshape(2, -1).T.tolist():
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x < y:
                root[y] = x
            elif y < x:
                root[x] = y
        for x in range(len(root)):  # a root is smaller than its nodes, so it is final already
            root[x] = root[root[x]]
        least = np.array(root)
        u = np.flatnonzero(least != np.arange(len(least)))
        return pa.record_batch([pa.array(names[u], kind), pa.array(names[least[u]], kind)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES:
            yield stars()
            held.clear()
    if held:
        yield stars()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up at most, and none if another node has it for its centre."""
    up = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre"))
    down = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("centre").alias("centre"))
    return not nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("centre") > 0)))).first()[0]


def _with_least(edges: DataFrame) -> DataFrame:
    """`edges` with the smallest of u and its neighbours; the minima are written, so that a hot u can be split in the join."""
    least = written(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
    return edges.join(least.hint("merge"), "u")


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node that can be reached.

    Links with a null end or from a node to itself say nothing and are left out. Only edge tables move between tasks; the driver
    sees one count a round. The result is a written table.
    """
    kind = links.schema[a].dataType.simpleString()
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    with scratch(links.sparkSession):
        edges = written(pairs.mapInArrow(_forests, f"u {kind}, v {kind}").distinct(), "edges")
        for _ in range(most_rounds):
            if _are_stars(edges):
                break
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = written(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
            near = _with_least(large)
            small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
            edges = written(small.distinct(), "small")
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        roots = edges.select(F.col("v").alias("node")).distinct()
        out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        return written(out, "components", keep=True)
