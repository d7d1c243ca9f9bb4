"""Searches from many origins at once, in blocks of nodes.

Spark deals the edges by their first node into blocks, one a partition, and shuffles what blocks tell each other; inside a block all searches advance together
as arrays. A round is one stage and moves only labels that may be better; some rounds are a job, after which the driver sees a count from each block. The edges of a block and its labels
stay in files of the shared folder, so that only what is told goes between Spark and Python. A label is cost_ms * HOPS + hops, so that the smaller number is the better label. Once labels
are final, they tell all edges that a best path can end with; then paths grow along these only, each once and all lengths in one job, as the longest is known by then.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

#: A cost and its hops are one whole number, cost_ms * HOPS + hops; MOST_MS * HOPS still fits.
HOPS, MOST_MS = 1 << 16, 1 << 46
#: More than any label.
NONE = (1 << 63) - 1
#: Rounds of a job, at most; a lost executor costs no more than these. The labels of all of them are kept until it ends, so that many labels have fewer: about LABELS_A_JOB in all.
ROUNDS_A_JOB, LABELS_A_JOB = 8, 1 << 27
#: Labels that a block is made for.
LABELS_A_BLOCK = 1 << 21
#: Edges of a block, at most.
MOST_EDGES = 1 << 40
#: Rows that are handed back to Spark in one piece.
PIECE = 2000


def blocks_for(spark: SparkSession, labels: int) -> int:
    """How many blocks searches of so many labels have: one a core, so that a round waits for one task, and more if that would make them large."""
    return max(1, spark.sparkContext.defaultParallelism, -(-labels // LABELS_A_BLOCK))


def block_of(nodes: np.ndarray, n: int) -> np.ndarray:
    """The block of each node."""
    return ((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _split(by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The rows of each value of `by`, numbers of blocks."""
    counts = np.bincount(by)
    order = np.argsort(by.astype(np.uint16) if len(counts) <= 1 << 16 else by, kind="stable")  # numbers of 16 bits are sorted in one pass
    ends = np.cumsum(counts)
    for key in np.flatnonzero(counts).tolist():  # nothing if there are no rows
        rows = order[ends[key] - counts[key] : ends[key]]
        yield key, tuple(c[rows] for c in columns)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges, with the number of its range."""
    counts = ends - starts
    whose = np.repeat(np.arange(len(starts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[whose]


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Whether a sorted key is the first of its value."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return first


def _places(ids: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Where each of `nodes` is in `ids` (sorted, all there): by a table if the numbers lie close enough."""
    if not len(nodes) or ids[-1] - ids[0] > max(1 << 16, 64 * len(ids)):
        return np.searchsorted(ids, nodes)
    table = np.empty(ids[-1] - ids[0] + 1, np.int32)
    table[ids - ids[0]] = np.arange(len(ids))
    return table[nodes - ids[0]].astype(np.int64)


def _least(keys: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Rows that have the smallest label of their key; keys are below n."""
    if 8 * len(keys) < n:
        _, keys = np.unique(keys, return_inverse=True)
        n = len(keys)
    least = np.full(n, NONE, np.int64)
    np.minimum.at(least, keys, labels)
    return np.flatnonzero(labels == least[keys])


def _dealt(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (m, node, next, cost_ms, length_m, depth_m) as one binary row for each block of first nodes; second nodes are made known to their block."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            ends = np.unique(columns[2])
            rows = [*_split(block_of(columns[1], n), *columns), *_split(block_of(ends, n), ends)]
            yield pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([pickle.dumps(r, 5) for _, r in rows], pa.binary())], names=["b", "rows"])

    return deal


def put(folder: str, name: str, number: int, what: object) -> None:
    """Leaves something of a block in the shared folder, arrays apart; a file has its name once it is whole, and a task that runs again writes the same."""
    files, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
    files.create_dir(f"{path}/{name}", recursive=True)
    part, arrays = f"{path}/{name}/.{number}-{uuid.uuid4().hex}", []
    head = pickle.dumps(what, 5, buffer_callback=lambda x: arrays.append(x.raw()))
    with files.open_output_stream(part, compression=None) as out:
        out.write(np.array([len(head), len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes())
        for x in (head, *arrays):
            out.write(x)
            out.write(bytes(-len(x) % 8))  # arrays start at whole words, if the file does
    files.move(part, f"{path}/{name}/{number}")


def got(folder: str, name: str, number: int) -> object:
    """What `put` left; its arrays are read-only. Of a local file only what is used is read."""
    files, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
    path = f"{path}/{name}/{number}"
    with pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_stream(path, compression=None) as stream:
        whole = stream.read_buffer()
    n = int(np.frombuffer(whole, np.int64, 2)[1])
    sizes = np.delete(np.frombuffer(whole, np.int64, 2 + n), 1).tolist()
    parts, at = [], 8 * (2 + n)
    for size in sizes:
        parts.append(whole.slice(at, size))
        at += size + -size % 8
    return pickle.loads(parts[0], buffers=parts[1:])


class Block:
    """Nodes and their edges by mode. The label of node i in search s is at i * n_searches + s of the block's labels."""

    def __init__(self, edges: list[tuple[np.ndarray, ...]], nodes: list[np.ndarray], modes: np.ndarray, number: int, n: int, joined: bool):
        mode, node, nxt, cost, length, depth = _joined(edges) if edges else [np.empty(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.float64, np.float64)]
        self.ids = np.unique(np.concatenate([node, *nodes]))
        source = np.searchsorted(self.ids, node)
        order = np.lexsort((source, mode))
        self.targets, target = np.unique(nxt[order], return_inverse=True)
        self.target, self.cost = target.astype(np.int32), cost[order]
        at = mode[order].astype(np.int64) * len(self.ids) + source[order]
        self.first = np.searchsorted(at, np.arange((int(modes.max()) + 1) * len(self.ids) + 1))  # of mode and node
        self.modes, self.number, self.n, self.joined = modes, number, n, joined
        self.details = source[order].astype(np.int32), length[order], depth[order]  # only for paths

    def starts(self, origins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first labels, and where."""
        k = len(self.modes)
        if self.joined:  # every node starts with itself, and what moves is the smallest node that meets it
            return np.repeat(self.ids, k), np.arange(len(self.ids) * k)
        labels = np.full(len(self.ids) * k, NONE, np.int64)
        here = np.flatnonzero(block_of(origins, self.n) == self.number)
        front = np.sort(np.searchsorted(self.ids, origins[here]) * k + here)
        labels[front] = 0
        return labels, front

    def told(self, labels: np.ndarray, front: np.ndarray, by_edge: bool = False) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """What the labels of `front` give at the ends of their edges, by block: node, search and label; with `by_edge` the edge too, as block * MOST_EDGES + place."""
        k = len(self.modes)
        nodes, searches = np.divmod(front, k)
        modes = self.modes[searches]
        for m in np.unique(modes):
            mine = np.flatnonzero(modes == m)
            at = m * len(self.ids) + nodes[mine]
            whose, edge = _expanded(self.first[at], self.first[at + 1])
            label, search = labels[front[mine]][whose], searches[mine][whose]
            label = label if self.joined else label + self.cost[edge] * HOPS + 1
            rows = _least(self.target[edge].astype(np.int64) * k + search, label, len(self.targets) * k)
            columns = self.targets[self.target[edge[rows]]], search[rows].astype(np.int32), label[rows]
            yield from _split(block_of(columns[0], self.n), *columns, *([self.number * MOST_EDGES + edge[rows]] if by_edge else []))

    def heard(self, labels: np.ndarray, told: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """The labels with those that are better, and where these are."""
        if not told:
            return labels, np.empty(0, np.int64)
        node, search, label = _joined(told)
        flat = _places(self.ids, node) * len(self.modes) + search
        better = np.flatnonzero(label < labels[flat])
        flat, labels = flat[better], labels.copy()
        np.minimum.at(labels, flat, label[better])
        if 16 * len(flat) < len(labels):
            return labels, np.unique(flat)
        new = np.zeros(len(labels), bool)
        new[flat] = True
        return labels, np.flatnonzero(new)

    def ends(self, labels: np.ndarray, told: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """Edges that best paths end with, of those told, by block: place and search."""
        if not told:
            return
        node, search, label, refs = _joined(told)
        best = np.flatnonzero(label == labels[_places(self.ids, node) * len(self.modes) + search])
        refs = refs[best]
        yield from _split(refs // MOST_EDGES, refs % MOST_EDGES, search[best])


class Ends:
    """The edges of a block that best paths end with, in order of first node and search."""

    def __init__(self, block: Block, details: tuple[np.ndarray, ...], served: list[tuple[np.ndarray, ...]]):
        edge, search = _joined(served) if served else (np.empty(0, np.int64), np.empty(0, np.int32))
        source, length, depth = details
        flat = source[edge].astype(np.int64) * len(block.modes) + search
        order = np.argsort(flat, kind="stable")
        self.ids, self.k, self.n = block.ids, len(block.modes), block.n
        # a block is read for every length of paths, so edges are places in the block's tables, each edge once
        used, place = np.unique(edge[order], return_inverse=True)
        self.edge = place.astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(self.ids) * self.k))]).astype(np.int32 if len(flat) < 1 << 31 else np.int64)
        self.next, self.cost, self.length, self.depth = block.targets[block.target[used]], block.cost[used], length[used], depth[used]

    def _onwards(self, node, search) -> tuple[np.ndarray, np.ndarray]:
        """The edges that go on from each node in its search: whose, and place."""
        flat = _places(self.ids, node) * self.k + search
        whose, at = _expanded(self.first[flat].astype(np.int64), self.first[flat + 1].astype(np.int64))
        return whose, self.edge[at]

    def longer(self, node, search, cost, path, length, depth) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """These paths, an edge longer, by block of their new end (which is not in the path yet)."""
        whose, at = self._onwards(node, search)
        columns = self.next[at], search[whose], cost[whose] + self.cost[at], path[whose], length[whose] + self.length[at], np.maximum(depth[whose], self.depth[at])
        yield from _split(block_of(columns[0], self.n), *columns)

    def trailed(self, node, search, water, path, length, depth) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """As `longer`, with the depth of each edge of the path; nothing else is kept."""
        whose, at = self._onwards(node, search)
        columns = self.next[at], search[whose], np.hstack([water[whose], self.depth[at][:, None]]), path[whose], length[whose], depth[whose]
        yield from _split(block_of(columns[0], self.n), *columns)


def _best(told: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...] | None:
    """The smallest path to each node and search, with the node; of equal paths the one of least length, then depth."""
    if not told:
        return None
    node, search, cost, path, length, depth = _joined(told)
    order = np.lexsort((search, node))
    first = _firsts(node[order]) | _firsts(search[order])
    if not first.all():
        group = np.cumsum(first) - 1
        alike = np.flatnonzero(np.bincount(group)[group] > 1)
        rows = order[alike]
        order[alike] = rows[np.lexsort((depth[rows], length[rows], *path[rows].T[::-1], group[alike]))]
    kept = order[first]
    node, search, cost, path, length, depth = (c[kept] for c in (node, search, cost, path, length, depth))
    return node, search, cost, np.hstack([path, node[:, None].astype(path.dtype)]), length, depth


def _pieces(columns: tuple[np.ndarray, ...]) -> Iterator[tuple[bytearray]]:
    for at in range(0, len(columns[0]), PIECE):
        yield (bytearray(pickle.dumps(tuple(c[at : at + PIECE] for c in columns), 5)),)


def _built(folder: str, searches: list[tuple[int, int]], n: int, joined: bool) -> Callable[[int, Iterator], Iterator]:
    def built(number: int, rows: Iterator) -> Iterator:
        if number >= n:
            return
        parts = [pickle.loads(x) for _, x in rows]
        origins = np.array([o for _, o in searches], np.int64)
        nodes = [origins[block_of(origins, n) == number], *(p[0] for p in parts if len(p) == 1)]
        block = Block([p for p in parts if len(p) > 1], nodes, np.array([m for m, _ in searches], np.int32), number, n, joined)
        put(folder, "details", number, block.details)
        block.details = None
        put(folder, "edges", number, block)
        labels, front = block.starts(origins)
        put(folder, "labels-0", number, (labels, front))
        yield from block.told(labels, front)

    return built


def _advanced(folder: str, of: int, n: int, last: bool) -> Callable[[int, Iterator], Iterator]:
    """Round `of`: what is told makes labels better, and these tell more. The last round of a job gives how many got better, and the most hops."""

    def advanced(number: int, rows: Iterator) -> Iterator:
        if number >= n:
            return
        block, (labels, _) = got(folder, "edges", number), got(folder, f"labels-{of - 1}", number)
        labels, front = block.heard(labels, [x for _, x in rows])
        put(folder, f"labels-{of}", number, (labels, front))
        if last:
            known = labels[labels != NONE] % HOPS
            yield len(front), int(known.max()) if len(known) else 0
        else:
            yield from block.told(labels, front)

    return advanced


def _resumed(folder: str, of: int) -> Callable[[int, Iterator], Iterator]:
    def resumed(number: int, rows: Iterator) -> Iterator:
        yield from got(folder, "edges", number).told(*got(folder, f"labels-{of}", number))

    return resumed


def _all_told(folder: str, of: int) -> Callable[[int, Iterator], Iterator]:
    def all_told(number: int, rows: Iterator) -> Iterator:
        labels, _ = got(folder, f"labels-{of}", number)
        yield from got(folder, "edges", number).told(labels, np.flatnonzero(labels != NONE), by_edge=True)

    return all_told


def _ended(folder: str, of: int, n: int) -> Callable[[int, Iterator], Iterator]:
    def ended(number: int, rows: Iterator) -> Iterator:
        if number < n:
            yield from got(folder, "edges", number).ends(got(folder, f"labels-{of}", number)[0], [x for _, x in rows])

    return ended


def _served(folder: str, n: int, trails: bool, starts: tuple[np.ndarray, ...]) -> Callable[[int, Iterator], Iterator]:
    """Keeps the edges that best paths end with, and prolongs the paths that start here."""

    def served(number: int, rows: Iterator) -> Iterator:
        if number >= n:
            return
        ends = Ends(got(folder, "edges", number), got(folder, "details", number), [x for _, x in rows])
        put(folder, "ends", number, ends)
        here = np.flatnonzero(block_of(starts[0], n) == number)
        best = _best([tuple(c[here] for c in starts)] if len(here) else [])
        if best is not None:
            yield from (ends.trailed if trails else ends.longer)(*best)

    return served


def _prolonged(folder: str, trails: bool) -> Callable[[int, Iterator], Iterator]:
    """The best of the paths that a block is told, all of one length, an edge longer."""

    def prolonged(number: int, rows: Iterator) -> Iterator:
        best = _best([x for _, x in rows])
        if best is not None:
            ends = got(folder, "ends", number)
            yield from (ends.trailed if trails else ends.longer)(*best)

    return prolonged


def _chosen(rows: Iterator) -> Iterator:
    """The best of the paths that a block is told, a length at a time."""
    for _, told in groupby((x for _, x in rows), lambda x: x[3].shape[1]):
        yield _best(list(told))


def _without_nodes(paths: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The hops of paths in place of their nodes."""
    return tuple(np.full(len(x), x.shape[1] - 1, np.int32) if k == 3 else x for k, x in enumerate(paths))


@dataclass
class Labelled:
    """Final labels: in the folder's labels-`rounds`, a file for each of n blocks; longest: the most hops of a label."""

    spark: SparkSession
    folder: str
    searches: list[tuple[int, int]]
    n: int
    rounds: int
    longest: int

    def blocks(self, run: Callable[[int, Iterator], Iterator]) -> RDD:
        """What `run` makes of each block's number."""
        return self.spark.sparkContext.parallelize(range(self.n), self.n).mapPartitionsWithIndex(run)

    def each(self, found: Callable[[Block, np.ndarray], tuple[np.ndarray, ...]]) -> RDD:
        """Pieces of what `found` makes of each block and its labels."""
        folder, rounds = self.folder, self.rounds
        return self.blocks(lambda number, _: _pieces(found(got(folder, "edges", number), got(folder, f"labels-{rounds}", number)[0])))

    def drop(self, name: str = "") -> None:
        """Removes files that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def labelled(edges: DataFrame, searches: list[tuple[int, int]], n: int, labels: int, most_ms: int, root: str, joined: bool = False) -> Labelled:
    """Blocks with the final labels; with `joined`, the smallest node of what hangs together in each mode (any node stands for an origin).

    edges: m, node, next, cost_ms, length_m, depth_m; searches: m and origin of each; labels: about how many there will be; root: a folder that driver and executors share.
    """
    spark = edges.sparkSession
    found = Labelled(spark, f"{root}/rillspark_searches_{uuid.uuid4().hex}", searches, n, 0, 0)
    last = min(HOPS - 1, (MOST_MS - 1) // max(1, most_ms))  # round whose labels still fit
    dealt = edges.mapInArrow(_dealt(n), "b int, rows binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(n)
    told, more = dealt.mapPartitionsWithIndex(_built(found.folder, searches, n, joined)), 1
    while more:
        rounds = max(1, min(ROUNDS_A_JOB, LABELS_A_JOB // max(1, labels)))
        if not joined:
            rounds = min(rounds, last - found.rounds)
            if rounds < 1:
                raise ValueError(f"paths of {found.rounds + 1} edges with costs up to {most_ms} ms are beyond what a label holds")
        if found.rounds:
            told = found.blocks(_resumed(found.folder, found.rounds))
        for k in range(rounds):
            told = told.partitionBy(n).mapPartitionsWithIndex(_advanced(found.folder, found.rounds + k + 1, n, k == rounds - 1))
        better = told.collect()
        for k in range(rounds):
            found.drop(f"labels-{found.rounds + k}")
        found.rounds += rounds
        more, found.longest = sum(x for x, _ in better), max(h for _, h in better)
    return found


def components_of(blocks: Labelled) -> DataFrame:
    """node, components: the label of each search, in their order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                ids, labels = pickle.loads(x.as_py())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, labels.shape[1], dtype=np.int32)), pa.array(labels.ravel()))
                yield pa.record_batch([pa.array(ids), listed], names=["node", "components"])

    pieces = blocks.each(lambda block, labels: (block.ids, labels.reshape(-1, len(block.modes))))
    return blocks.spark.createDataFrame(pieces, "data binary", verifySchema=False).mapInArrow(rows, "node long, components array<long>")


def labels_of(blocks: Labelled) -> DataFrame:
    """node, search, label of everything that was reached."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.record_batch([pa.array(c) for c in pickle.loads(x.as_py())], names=["node", "search", "label"])

    def found(block: Block, labels: np.ndarray) -> tuple[np.ndarray, ...]:
        flat = np.flatnonzero(labels != NONE)
        return block.ids[flat // len(block.modes)], (flat % len(block.modes)).astype(np.int32), labels[flat]

    return blocks.spark.createDataFrame(blocks.each(found), "data binary", verifySchema=False).mapInArrow(rows, "node long, search int, label long")


def _grown(blocks: Labelled, kind: type, trails: bool) -> RDD:
    """All best paths by block of their end, a length after the other; with `trails` the depth of each edge takes the place of cost, length and greatest depth. kind: of the numbers of nodes."""
    folder, n = blocks.folder, blocks.n
    origins = np.array([o for _, o in blocks.searches], np.int64)
    zero, none = np.zeros(len(origins), np.int8 if trails else np.float64), np.empty((len(origins), 0))
    starts = origins, np.arange(len(origins), dtype=np.int32), none if trails else zero.astype(np.int64), none.astype(kind), zero, zero
    ends = blocks.blocks(_all_told(folder, blocks.rounds)).partitionBy(n).mapPartitionsWithIndex(_ended(folder, blocks.rounds, n)).partitionBy(n)
    every, told = [blocks.spark.sparkContext.parallelize(list(_split(block_of(origins, n), *starts)), 1).partitionBy(n)], ends.mapPartitionsWithIndex(_served(folder, n, trails, starts))
    for _ in range(blocks.longest):
        every.append(told.partitionBy(n))
        told = every[-1].mapPartitionsWithIndex(_prolonged(folder, trails))
    return blocks.spark.sparkContext.union(every).mapPartitions(_chosen)


def paths_of(blocks: Labelled, kind: type, path: str | None = "array<long>") -> DataFrame:
    """node, search, cost_ms, hops, path, length_m, max_depth_m of everything that was reached. kind: of the numbers of nodes while paths grow; path: array<long>, string (joined by >), or None (left out)."""

    def listed(nodes: np.ndarray) -> pa.Array:
        numbers = pa.array(nodes.astype(np.int64).ravel())
        of = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, nodes.shape[1], dtype=np.int32)), values)
        return pc.binary_join(of(numbers.cast(pa.string())), ">") if path == "string" else of(numbers)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                node, search, cost, nodes, length, depth = pickle.loads(x.as_py())
                columns = {"node": node, "search": search, "cost_ms": cost, "hops": np.full(len(node), nodes.shape[1] - 1, np.int32) if path else nodes, "path": nodes, "length_m": length, "max_depth_m": depth}
                if not path:
                    del columns["path"]
                yield pa.record_batch([listed(c) if name == "path" else pa.array(c) for name, c in columns.items()], names=list(columns))

    grown = _grown(blocks, kind, False)
    pieces = (grown if path else grown.map(_without_nodes)).flatMap(_pieces)
    schema = "node long, search int, cost_ms long, hops int" + (f", path {path}" if path else "") + ", length_m double, max_depth_m double"
    return blocks.spark.createDataFrame(pieces, "data binary", verifySchema=False).mapInArrow(rows, schema)


def _side_by_side(paths: RDD, n: int) -> RDD:
    """Paths of all lengths to the nodes of a block in one partition. That is so after a union of what is partitioned alike."""
    if paths.getNumPartitions() == n:
        return paths
    return paths.map(lambda x: (int(block_of(x[0][:1], n)[0]), x)).partitionBy(n).values()


def _apart(base: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which edges of each base path the other path of the same row has in neither direction."""
    ends = lambda p: (np.minimum(p[:, :-1], p[:, 1:]), np.maximum(p[:, :-1], p[:, 1:]))
    (a, b), (c, d) = ends(base), ends(other)
    used = np.zeros(a.shape, bool)
    for k in range(c.shape[1]):
        used |= (a == c[:, k, None]) & (b == d[:, k, None])
    return ~used


def _paired(paths: list[tuple[np.ndarray, ...]], partner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block's paths by length: the length and the row of each, those whose search is asked for (partner of -1 or more), and for each of these the path of its partner to the same node, or -1."""
    node, search = np.concatenate([x[0] for x in paths]), np.concatenate([x[1] for x in paths])
    which = np.repeat(np.arange(len(paths)), [len(x[0]) for x in paths])
    row = np.concatenate([np.arange(len(x[0])) for x in paths])
    at = np.unique(node, return_inverse=True)[1] * len(partner)
    order = np.argsort(at + search)
    keys = (at + search)[order]
    asked = np.flatnonzero(partner[search] >= -1)
    wanted = np.where(partner[search[asked]] >= 0, at[asked] + partner[search[asked]], -1)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return which, row, asked, np.where(keys[place] == wanted, order[place], -1)


def _compared(partner: np.ndarray) -> Callable[[Iterator], Iterator]:
    """From a block's trails: search, node, ends and depth of each edge that only the path of the search has, not that of its partner (below 0: none)."""

    def compared(rows: Iterator) -> Iterator:
        trails = list(rows)
        if not trails:
            return
        which, row, asked, met = _paired(trails, partner)
        asked, met = asked[met >= 0], met[met >= 0]
        pair = which[asked] * len(trails) + which[met]
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(_firsts(pair[order]))
        for some in np.split(order, starts[1:]) if len(order) else ():
            own, others = trails[which[asked[some[0]]]], trails[which[met[some[0]]]]
            for x in range(0, len(some), PIECE):
                mine, theirs = row[asked[some[x : x + PIECE]]], row[met[some[x : x + PIECE]]]
                path = own[3][mine]
                r, c = np.nonzero(_apart(path, others[3][theirs]))
                two = path[r, c].astype(np.int64), path[r, c + 1].astype(np.int64)
                found = own[1][mine[r]], own[0][mine[r]], np.minimum(*two), np.maximum(*two), own[2][mine[r], c]
                yield (bytearray(pickle.dumps(found, 5)),)

    return compared


def _both(partner: np.ndarray) -> Callable[[Iterator], Iterator]:
    """From a block's paths: search, node, cost and length of each path asked for, whether its partner has a path, that one's cost and length, and whether both are the same."""

    def both(rows: Iterator) -> Iterator:
        paths = list(rows)
        if not paths:
            return
        which, row, asked, met = _paired(paths, partner)
        node, search, cost, length = (np.concatenate([x[k] for x in paths]) for k in (0, 1, 2, 4))
        alike = (met >= 0) & (which[asked] == which[met])
        same = np.zeros(len(asked), bool)
        for w, x in enumerate(paths):
            here = np.flatnonzero(alike & (which[asked] == w))
            same[here] = (x[3][row[asked[here]]] == x[3][row[met[here]]]).all(axis=1)
        yield from _pieces((search[asked], node[asked], cost[asked], length[asked], met >= 0, cost[met], length[met], same))

    return both


def both_of(blocks: Labelled, partner: list[int], kind: type) -> DataFrame:
    """search, node, cost_ms, length_m, other_cost_ms, other_length_m, same: the path of each search whose partner is -1 (none) or another one, beside that one's path to the same node (null: none).

    Both paths of a node are in its block, so they are compared where they grew, and no path is moved. partner: of each search; -2: it is not asked for.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                search, node, cost, length, met, other_cost, other_length, same = pickle.loads(x.as_py())
                columns = [search, node, cost, length, pa.array(other_cost, mask=~met), pa.array(other_length, mask=~met), same]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["search", "node", "cost_ms", "length_m", "other_cost_ms", "other_length_m", "same"])

    pieces = _side_by_side(_grown(blocks, kind, False), blocks.n).mapPartitions(_both(np.array(partner)))
    return blocks.spark.createDataFrame(pieces, "data binary", verifySchema=False).mapInArrow(rows, "search int, node long, cost_ms long, length_m double, other_cost_ms long, other_length_m double, same boolean")


def apart_of(blocks: Labelled, partner: list[int], kind: type) -> DataFrame:
    """search, node, a, b, depth_m: the edges that the path of a search has and that of its partner to the same node has not, where both exist.

    Both paths of a node are in its block, so they are compared where they grew, and only what differs becomes rows. partner: for each search another one, or below 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.record_batch([pa.array(c) for c in pickle.loads(x.as_py())], names=["search", "node", "a", "b", "depth_m"])

    pieces = _side_by_side(_grown(blocks, kind, True), blocks.n).mapPartitions(_compared(np.array(partner)))
    return blocks.spark.createDataFrame(pieces, "data binary", verifySchema=False).mapInArrow(rows, "search int, node long, a long, b long, depth_m double")
