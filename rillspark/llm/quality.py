"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, one shallow tree (three cuts) is fitted to the gradient of the log-loss on each feature's bins
in turn and added, shrunk, to that feature's lookup table. Then the pairs of features whose two-way tables explain most of what is left are
boosted in the same way on coarse two-way bins. A document's score is the sum of one entry of each table: bin numbers by binary
search, then additions over arrays.

The model is learned from at most SAMPLE labelled rows; features are computed from the whole text of every row.

Results for odd input: null text counts as empty; an empty text has all features 0 and gets the score of that; without labelled
rows of both classes every score is the share of class 1 (0.5 without rows); rows with null labels are not used; rows with the
same id are scored each for itself; a null id counts as held out, and is scored; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import byte_column, slices, written
from rillspark.llm.toxicity import labelled

#: Most labelled rows that the model is learned from.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 250, 120, 0.1

FEATURES = (
    "letters", "upper", "digits", "marks", "spaces", "lines", "beyond_ascii", "pipes", "symbols", "stops", "exclaims",
    "log_words", "word_bytes", "distinct_words", "distinct_pairs", "top_word", "repeated_next", "line_words", "repeated_lines", "marked_words", "upper_words",
)


def _class(*members: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_LETTER = _class(*range(65, 91), *range(97, 123), *range(128, 256))
_MARK = _class(*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))
_KINDS = (
    _LETTER, _class(*range(65, 91)), _class(*range(48, 58)), _MARK, _class(9, 11, 12, 13, 32), _class(10),
    _class(*range(128, 256)), _class(124), _class(*b"#$%&*@<>{}[]\\^~=+"), _class(*b".,;:?"), _class(33),
)
#: bit k of _BITS[byte] says whether the byte is of kind k
_BITS = sum((k.astype(np.int64) << n for n, k in enumerate(_KINDS)), np.zeros(256, np.int64))
_SYMBOL_ENDS = tuple(bytes([c]) for c in b"#$%&*@<>{}[]\\^~=+|!")


def _shares(data: np.ndarray) -> list[float]:
    """The share of each kind of byte."""
    counts = np.bincount(data, minlength=256)
    return [float(counts[k].sum()) / len(data) for k in _KINDS]


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a column."""
    data, ends = byte_column(column)
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    whole = data.tobytes()
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if a == b:
            continue
        text = whole[a:b]
        out[row, : len(_KINDS)] = _shares(data[a:b])
        words = text.split()
        n = len(words)
        if not n:
            continue
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(w, len(numbers)) for w in words])
        lines = [x for x in text.split(b"\n") if x]
        pairs = codes[1:] * len(numbers) + codes[:-1]
        distinct = list(numbers)
        times = np.bincount(codes)
        marked = np.array([w.endswith(_SYMBOL_ENDS) for w in distinct])
        upper = np.array([len(w) > 1 and w.isupper() for w in distinct])
        out[row, len(_KINDS) :] = (
            np.log1p(n), sum(map(len, words)) / n, len(numbers) / n, len(np.unique(pairs)) / max(1, n - 1), times.max() / n,
            (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
            times[marked].sum() / n, times[upper].sum() / n,
        )
    return out


@dataclasses.dataclass
class Model:
    """Cut points per feature, a table per feature, and tables of pairs on coarse cuts."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = dataclasses.field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = dataclasses.field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 cut points between distinct values, at even shares of the rows."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher")) if len(values) else np.zeros(0)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values of a shallow tree over ordered bins: the best cut is made in turn, up to so many leaves."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(grad))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                c = np.arange(a + 1, b)
                won = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (won[k], (a, b), int(c[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of y (0 or 1) on rows of features; deterministic."""
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = Model(base, cuts, tables)
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])), 4, 1.0)
            tables[j] += step
            total += step[b]
    model.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    g, h = slopes()

    def two_way(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return coarse[i] * shape[1] + coarse[j], shape

    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            cell, shape = two_way(i, j)
            size = shape[0] * shape[1]
            gains.append((float((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + 5.0)).sum()), i, j))
    chosen = [(i, j, *two_way(i, j)) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS]]
    added = [np.zeros(shape) for *_, shape in chosen]
    for _ in range(PAIR_ROUNDS):
        for (_, _, cell, shape), table in zip(chosen, added, strict=True):
            g, h = slopes()
            size = shape[0] * shape[1]
            gs, hs = np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)
            # a shallow tree of two levels: the rows are cut once, each part's columns once
            halves = _tree(gs.sum(axis=1), hs.sum(axis=1), 2, 5.0)
            step = np.zeros(shape)
            for v in np.unique(halves):
                part = halves == v
                step[part] = _tree(gs[part].sum(axis=0), hs[part].sum(axis=0), 2, 5.0)
            table += RATE * step
            total += RATE * step.ravel()[cell]
    model.pairs = [(i, j, table) for (i, j, *_), table in zip(chosen, added, strict=True)]
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model:
    """A model from the labelled rows outside the held-out fifth; their features (numbers, at most `most` rows) go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            x = features(batch.column("text"))
            yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32())), batch.column(label), batch.column("doc_id").cast(pa.string())], names=["x", "y", "id"])

    rows = labelled(docs, labels, label, most, id_col, text_col).select("text", label, "doc_id").mapInArrow(run, "x array<float>, y int, id string")
    seen = written(rows, "features").toPandas().sort_values("id", kind="stable")
    x = np.array(seen.x.tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, seen.y.to_numpy(float))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1). A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            yield pa.record_batch([batch.column("id"), pa.array(model.score(features(batch.column("text"))))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def with_quality(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score less than `threshold`; all columns stay, and there is no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4_000_000):
            yield batch.filter(pa.array(model.score(features(batch.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
