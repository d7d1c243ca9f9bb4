"""Near-dedup: universal hash minima with banding, verification by signatures and on full sets, and connected components.

1. Every document gets its set of distinct word shingles (64-bit hashes), a digest of that set, a signature (one byte of each
   minimum) and one key for each band of minima. Documents with equal sets are one class; only its smallest id goes on.
2. Documents that share a band key are a bucket; buckets with the same documents are one. Inside a bucket, signatures are compared:
   a pair passes when as many bytes agree as a linked pair's would, less a margin (see `agreeing`). The components of what passes are families,
   which is where links can be; documents that only share a band with others never meet again.
3. Inside a family, pairs that pass by signature are confirmed on full sets. Components of the confirmed links give the result.

Both comparisons give back spanning forests, never all pairs, and run in blocks of CHUNK documents (`group_links`). A group of more
than one chunk is settled by its leader, the document with the most partners in its chunk: every chunk is compared with the leader, and
only the documents that stay apart from it are compared with all chunks of the group, block by block. So every link between
different components is found, however large a group is, and no task holds more than two chunks.

Results for odd input: null or blank text has an empty set and is linked with nothing; a text with fewer words than a shingle is
one shingle; rows with the same id and text are flagged alike; a null id is a document of its own; ids may be of any type that has an
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import byte_column, scratch, slices, written
from rillspark.llm.components import connected_components
from rillspark.llm.exact_dedup import group_copies

#: Bands of ROWS minima: a pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 7) ** 48 = 1.2e-5.
BANDS, ROWS = 48, 7
MINIMA = BANDS * ROWS
CHUNK = 256
BLOCK_BYTES = 1_000_000
#: Margin of the signatures in standard deviations: a linked pair is lost with probability 2e-6 at most.
MARGIN = 4.6

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = (_RANDOM.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _RANDOM.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_START = _RANDOM.integers(1, 2**63, BANDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes with document starts: a 64-bit hash for each word (A-Z lower-cased), and where each word starts."""
    full = ~_SPACE[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    at = starts[starts < len(data)]
    first[at] = full[at]
    place = np.flatnonzero(full)
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = first[place]
    head = np.flatnonzero(begins)
    offset = np.arange(len(place)) - np.repeat(head, np.diff(np.r_[head, len(place)]))
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(offset.max()), _BASE, np.uint64)])
    return _mixed(np.add.reduceat(_BYTE[data[place]] * power[offset], head)), place[head]


def _long_word(data: np.ndarray) -> np.uint64:
    """The same hash as word_hashes gives, of bytes that are one word of any length."""
    total, power = np.uint64(0), np.uint64(1)
    for k in range(0, len(data), BLOCK_BYTES):
        part = data[k : k + BLOCK_BYTES]
        powers = np.cumprod(np.r_[power, np.full(len(part), _BASE, np.uint64)])
        total += (_BYTE[part] * powers[:-1]).sum(dtype=np.uint64)
        power = powers[-1]
    return _mixed(np.array([total]))[0]


def _all_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word, block by block; blocks end between words, so that long texts need little memory."""
    hashes, starts, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while base < len(data):
        stop = min(len(data), base + BLOCK_BYTES)
        if stop < len(data):
            spaces = np.flatnonzero(_SPACE[data[base:stop]])
            border = int(ends[np.searchsorted(ends, stop, side="right") - 1])
            stop = max(border, base + int(spaces[-1]) + 1 if len(spaces) else 0, base)
        if stop == base:  # one word fills the block: up to the next space or the text's end
            stop = int(ends[np.searchsorted(ends, base, side="right")])
            for k in range(base, stop, BLOCK_BYTES):
                spaces = np.flatnonzero(_SPACE[data[k : min(stop, k + BLOCK_BYTES)]])
                if len(spaces):
                    stop = k + int(spaces[0])
                    break
            hashes.append(np.array([_long_word(data[base:stop])]))
            starts.append(np.array([base]))
        else:
            h, s = word_hashes(data[base:stop], ends[np.searchsorted(ends, base) : np.searchsorted(ends, stop)] - base)
            hashes.append(h)
            starts.append(s + base)
        base = stop
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles of so many words."""
    data, ends = byte_column(column)
    h, s = _all_words(data, ends)
    bounds = np.searchsorted(s, ends)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, n = h[a:b], min(words, b - a)
        if n <= 0:
            out.append(own)
            continue
        total = np.zeros(len(own) - n + 1, np.uint64)
        for k in range(n):
            total += own[k : len(own) - n + 1 + k] * _PLACE[k]
        out.append(np.unique(_mixed(total + np.uint64(n))))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash (multiply and add modulo 2 ** 32) over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MULTIPLY), 2**32 - 1, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def agreeing(percent: int) -> int:
    """How many signature bytes agree, at least, for a pair that is linked: the expected number at that similarity less the margin."""
    share = percent / 100
    return int(np.ceil(MINIMA * max(0.0, share - MARGIN * np.sqrt(share * (1 - share) / MINIMA))))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8_000_000):
            sets = shingle_sets(batch.column("text"), words)
            least = np.array([minima(s) for s in sets], np.uint64).reshape(len(sets), BANDS, ROWS)
            keys = _mixed((least * _BAND).sum(axis=2) + _BAND_START).view(np.int64)
            # the higher bytes of a minimum are small in large sets, so the byte is taken from a mixed value
            signature = (_mixed(least.ravel()) >> np.uint64(56)).astype(np.uint8).reshape(len(sets), MINIMA)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(digest, pa.string()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([s.tobytes() for s in signature], pa.binary()),
                ],
                names=["doc_id", "digest", "n_shingles", "bands", "signature"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            sets = shingle_sets(batch.column("text"), words)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], names=[*kept, "shingles"])

    return run


class Block:
    """Documents that are compared in one task: ids, signatures and, where links are confirmed, full sets."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, self.n = rows, rows.num_rows
        self.signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(self.n, MINIMA)
        self.codes: np.ndarray | None = None
        if "shingles" in rows.schema.names:
            sets = rows.column("shingles")
            _, codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            self.codes = codes
            self.starts = np.r_[0, np.cumsum(sets.value_lengths().fill_null(0).to_numpy())]
            self.mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int32)

    def _own(self, k: int) -> np.ndarray:
        return self.codes[self.starts[k] : self.starts[k + 1]]

    def near(self, k: int, least: int) -> np.ndarray:
        """Which documents pass with the k-th by signature."""
        return np.count_nonzero(self.signatures == self.signatures[k], axis=1) >= least

    def linked(self, k: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of `others` that are linked with the k-th on full sets; all of them, if only signatures are compared."""
        if self.codes is None or not len(others):
            return others
        own = self._own(k)
        self.mark[own] = 1
        lengths = self.starts[others + 1] - self.starts[others]
        both = np.add.reduceat(self.mark[np.concatenate([self._own(j) for j in others])], np.r_[0, np.cumsum(lengths)[:-1]])
        self.mark[own] = 0
        return others[100 * both >= percent * (lengths + len(own) - both)]

    def forest(self, percent: int, first: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Links that connect what is connected here, the component of each document, and its number of partners by signature.

        Documents are taken from the one with the most partners on (`first` before all), and compared with those outside their component.
        """
        near = np.stack([self.near(k, agreeing(percent)) for k in range(self.n)])
        partners = near.sum(axis=1)
        root, links = np.arange(self.n), []
        order = np.argsort(-partners, kind="stable").tolist()
        for q in order if first is None else [first, *order]:
            found = self.linked(q, np.flatnonzero(near[q] & (root != root[q])), percent)
            components, one = np.unique(root[found], return_index=True)
            for r, k in zip(components, one, strict=True):
                links.append((q, found[k]))
                root[root == r] = root[q]
        return links, root, partners


def _runs(keys: tuple[str, ...], done: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """Applies `done` to each run of rows with equal keys; the rows of a task are sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for key in keys:
                values = rows.column(key).to_numpy(zero_copy_only=False)
                new[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(new)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield from done(rows.slice(a, b - a))
            held = rows.slice(starts[-1])
        if held is not None:
            yield from done(held)

    return run


def _links(rows: pa.RecordBatch, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ids = rows.column("doc_id")
    ends = [ids.take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1)]
    return pa.record_batch([rows.column("group").slice(0, 1).take(pa.array([0] * len(pairs), pa.int64())), *ends, pa.array([0] * len(pairs), pa.int64())], names=["group", "a", "b", "partners"])


def _first_pass(percent: int):
    """Of a group of one chunk: its forest. Of a chunk of a larger group: its document with the most partners."""

    def done(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if rows.num_rows == 1 and rows.column("size")[0].as_py() <= CHUNK:
            return
        block = Block(rows)
        if rows.column("size")[0].as_py() <= CHUNK:
            yield _links(rows, block.forest(percent)[0])
            return
        partners = [int(block.near(k, agreeing(percent)).sum()) for k in range(block.n)]
        best = int(np.argmax(partners))
        at = pa.array([best], pa.int64())
        yield pa.record_batch([rows.column("group").take(at), rows.column("doc_id").take(at), rows.column("doc_id").take(at), pa.array([partners[best]], pa.int64())], names=["group", "a", "b", "partners"])

    return done


def _leader_pass(percent: int):
    """A chunk with its group's leader: the rows again, with `label` (the leader if connected with it, else an id of the chunk's component)
    and `link` (a partner in the chunk that stands before it in the forest, if any)."""

    def done(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        order = np.argsort(rows.column("leads").to_numpy(zero_copy_only=False), kind="stable")
        rows = rows.take(pa.array(order))
        lead = rows.num_rows - 1
        links, root, _ = Block(rows).forest(percent, lead)
        ids, label, link = rows.column("doc_id"), np.arange(rows.num_rows), np.full(rows.num_rows, -1)
        for r in np.unique(root):
            label[root == r] = lead if root[lead] == r else np.flatnonzero(root == r)[0]
        # as a tree from the label on, each document but the label has one link
        around: dict[int, list[int]] = {}
        for x, y in links:
            around.setdefault(int(x), []).append(int(y))
            around.setdefault(int(y), []).append(int(x))
        for top in np.unique(label).tolist():
            todo = [top]
            while todo:
                x = todo.pop()
                for y in around.get(x, ()):
                    if y != top and link[y] < 0:
                        link[y] = x
                        todo.append(y)
        out = rows.slice(0, lead)
        links_to = ids.take(pa.array(np.where(link[:lead] < 0, 0, link[:lead]), mask=link[:lead] < 0))
        yield pa.record_batch([*out.columns, ids.take(pa.array(label[:lead])), links_to, pa.array(label[:lead] != lead)], names=[*out.schema.names, "label", "link", "apart"])

    return done


def _block_pass(percent: int):
    """One link from each asking document to each other component that it touches in this block."""

    def done(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, asks = Block(rows), rows.column("asks").to_numpy(zero_copy_only=False)
        _, label = np.unique(rows.column("label").to_numpy(zero_copy_only=False), return_inverse=True)
        pairs = []
        for q in np.flatnonzero(asks):
            found = block.linked(q, np.flatnonzero(block.near(q, agreeing(percent)) & ~asks & (label != label[q])), percent)
            pairs += [(q, found[k]) for k in np.unique(label[found], return_index=True)[1]]
        yield _links(rows, pairs)

    return done


def _dealt(chunks) -> F.Column:
    """A chunk number below `chunks` that depends on the id only."""
    return F.pmod(F.xxhash64("doc_id"), chunks).cast("int")


def _in_blocks(rows: DataFrame, keys: tuple[str, ...], done, schema: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_runs(keys, done), schema)


def group_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is connected in each group.

    rows: group (long), size (of the group), doc_id, signature and, if links are to be confirmed on full sets, shingles; a written table.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    link_schema = f"group long, a {kind}, b {kind}, partners long"
    dealt = rows.withColumn("chunk", _dealt(F.ceil(F.col("size") / CHUNK)))
    found = written(_in_blocks(dealt, ("group", "chunk"), _first_pass(percent), link_schema), "links")
    links = found.where("a <> b").select("a", "b")
    leads = written(found.where("a = b").groupBy("group").agg(F.max_by("a", F.struct("partners", "a")).alias("doc_id")), "leads")
    if leads.isEmpty():
        return links
    large = dealt.where(F.col("size") > CHUNK).withColumn("leads", F.lit(False))
    leaders = large.join(leads.hint("merge"), ["group", "doc_id"]).withColumns({"leads": F.lit(True), "chunk": F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / CHUNK).cast("int") - 1))}).select(*large.columns)
    columns = ", ".join(f"`{c}` {t}" for c, t in large.dtypes)
    labelled = written(_in_blocks(large.unionByName(leaders), ("group", "chunk"), _leader_pass(percent), f"{columns}, label {kind}, link {kind}, apart boolean"), "labelled")
    links = links.unionByName(labelled.where("link IS NOT NULL AND link <> doc_id").select(F.col("doc_id").alias("a"), F.col("link").alias("b")))
    asking = written(labelled.where("apart").groupBy("group").agg(F.count(F.lit(1)).alias("asking")), "asking")
    if asking.isEmpty():
        return links
    open_ = labelled.drop("chunk", "leads", "link").join(asking.hint("merge"), "group")
    n_rows, n_columns = F.ceil(F.col("asking") / CHUNK).cast("int"), F.ceil(F.col("size") / CHUNK).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = open_.where("apart").withColumns({"asks": F.lit(True), "row": _dealt(n_rows), "column": to_all(n_columns)})
    members = open_.withColumns({"asks": F.lit(False), "row": to_all(n_rows), "column": _dealt(n_columns)})
    more = _in_blocks(asks.unionByName(members), ("group", "row", "column"), _block_pass(percent), link_schema)
    return links.unionByName(written(more.select("a", "b"), "more"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that can be reached over links), kept (it is that id).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct shingles of `words` words.
    A null id is kept as a document of its own, linked with nothing. The bands are set for 80 per cent or more; below, pairs get lost.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        signed = written(texts.mapInArrow(_signatures(words), f"doc_id {kind}, digest string, n_shingles long, bands array<long>, signature binary"), "signatures")
        alone = F.col("digest").isNull() | F.col("doc_id").isNull()
        classes = written(group_copies(signed.where(~alone).select("doc_id", "digest", "n_shingles"), "digest").select("doc_id", "n_shingles", "keep_id"), "classes")
        # one row of each class: band keys and signature of its representative
        first = classes.where("doc_id = keep_id").select("doc_id")
        keys = written(signed.join(first.hint("shuffle_merge"), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band")).distinct(), "bands")
        print_ = {"print": F.bit_xor(F.xxhash64("doc_id"))}
        shared = group_copies(keys, "band", more=print_).where("group_size > 1").select(F.xxhash64("keep_id", "group_size", "print").alias("group"), F.col("group_size").alias("size"), "doc_id")
        buckets = written(shared.distinct(), "buckets")
        signatures = signed.select("doc_id", "signature").hint("merge")
        members = written(buckets.join(signatures, "doc_id").select("group", "size", "doc_id", "signature").distinct(), "members")
        near = connected_components(group_links(members, percent), "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
        families = written(group_copies(near, "family").select(F.xxhash64("family").alias("group"), F.col("group_size").alias("size"), "doc_id"), "families")
        sets = texts.join(families.hint("merge"), "doc_id").select("group", "size", "doc_id", "text").mapInArrow(_sets(words), f"group long, size long, doc_id {kind}, shingles array<long>")
        sets = written(sets.join(signatures, "doc_id").select("group", "size", "doc_id", "signature", "shingles").dropDuplicates(["doc_id"]), "sets")
        parts = connected_components(group_links(sets, percent), "a", "b")
        linked = classes.join(parts.hint("merge"), F.col("keep_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "keep_id").alias("component_id"))
        rest = signed.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        found = linked.unionByName(rest).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
        return written(found, "near", keep=True)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """`docs` with one document of each group of near copies; all columns stay, also one of the name kept_id. Repeated rows stay or go together."""
    kept = near_dedup(docs, id_col=id_col, text_col=text_col, **settings).where("kept").select(F.col(id_col).alias("kept_id"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    return rows.join(kept.hint("shuffle_merge"), F.col(names[docs.columns.index(id_col)]).eqNullSafe(F.col("kept_id")), "left_semi").toDF(*docs.columns)


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM t
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, s.doc_id = min(reach.b) AS kept
FROM s JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id, len(sh)
"""
