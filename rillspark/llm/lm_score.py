"""Language-model scoring with stupid backoff over token bigrams.

Tokens are ids of a vocabulary file, so tables of single tokens have a fixed bound (FOLDS x vocabulary) and are broadcast; tables of
bigrams have none, and are partitioned by hash. Documents fall into FOLDS folds by the hash of their id, and each document is scored
by what all other folds hold, so that no document vouches for itself. For a token w after v,

    S(w | v) = c(v w) / c(v)               if c(v w) > 0
             = ALPHA * c(w) / N            else, if c(w) > 0
             = ALPHA * ALPHA / vocabulary  else,

where the counts are over all documents of the other folds, and a document's score is the sum of ln S over its tokens.

How it runs: each task explodes its documents into distinct bigrams with their numbers of times, and deals them out by the
bigram's hash: one row for each slice of documents and hash bucket, with the entries packed in arrays. In a bucket, the entries are summed into
the bucket's count table and joined with it at once, so that the exploded bigrams are shuffled once. The sums by document come
back packed in the same way. A bigram that every document holds costs one entry a document, as any other.

Order two only: a third order needs the counts of three pairs of neighbours for each token, which no single partitioning brings together, and a
second shuffle of this size would pass four times the input on disk.

Results for odd input: null or empty text has no tokens, sum 0 and mean null; rows with the same id share a fold and are scored
each for itself; a null id is a fold of its own kind (hash of null); ids are integers, or texts of integers; with one document only, all tokens back
off to the last case; a very long text is a slice of its own; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.bpe import Bpe
from rillspark.llm.common import slices
from rillspark.llm.packing import token_ids

ALPHA, FOLDS = 0.4, 8
#: Bits of a document's place in its slice; its fold stands above them.
PLACE_BITS = 24
SLICE_BYTES = 2_000_000
#: Bytes of text for each hash bucket; a bucket holds about as many bigrams as this has tokens.
BUCKET_BYTES, LEAST_BUCKETS = 8_000_000, 64


def _ids(path: str, text: str | None) -> np.ndarray:
    return token_ids(path, text).astype(np.int64)


def _singles(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((FOLDS, size + 1), np.int64)  # the last column: starts of documents
        for batch in slices(batches, "text", SLICE_BYTES):
            for fold, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = _ids(path, text)
                if len(ids):
                    counts[fold] += np.bincount(ids, minlength=size + 1)
                    counts[fold, size] += 1
        fold, token = np.nonzero(counts)
        if len(fold):
            yield pa.record_batch([pa.array(fold, pa.int32()), pa.array(token, pa.int32()), pa.array(counts[fold, token])], names=["fold", "token", "n"])

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (keys.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def key_type(size: int) -> np.dtype:
    """The narrowest integers that tell all bigrams of a vocabulary apart."""
    return np.dtype(np.uint32 if (size + 1) ** 2 <= 1 << 32 else np.uint64)


def _exploded(path: str, size: int, buckets: int):
    """One row for each slice and bucket that has entries: documents (place in the slice, and fold), bigrams and times; bucket 0 also has the slice's head."""
    kind = key_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for batch in slices(batches, "text", SLICE_BYTES):
            docs, keys, times, lengths = [], [], [], []
            for place, (fold, text) in enumerate(zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                ids = _ids(path, text)
                lengths.append(len(ids))
                pairs, n = np.unique(np.r_[size, ids[:-1]] * (size + 1) + ids, return_counts=True) if len(ids) else (ids, ids)
                docs.append(np.full(len(pairs), fold << PLACE_BITS | place, np.uint32))
                keys.append(pairs.astype(kind))
                times.append(n.astype(np.uint32))
            doc, key, time = map(np.concatenate, (docs, keys, times))
            own = _bucket(key, buckets)
            order = np.argsort(own, kind="stable")
            ends = np.searchsorted(own[order], np.arange(buckets + 1))
            ids = np.array([-1 if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            head = b"".join(x.tobytes() for x in (ids, np.array(lengths, np.uint32), np.array([x is None for x in batch.column("doc_id").to_pylist()], np.uint8)))
            rows = [(b, order[x:y]) for b, x, y in zip(range(buckets), ends[:-1], ends[1:], strict=True) if y > x or b == 0]
            yield pa.record_batch(
                [
                    pa.array([number] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([len(ids)] * len(rows), pa.int32()),
                    pa.array([head if b == 0 else None for b, _ in rows], pa.binary()),
                    *(pa.array([x[at].tobytes() for _, at in rows], pa.binary()) for x in (doc, key, time)),
                ],
                names=["slice", "bucket", "n", "head", "docs", "keys", "times"],
            )
            number += 1

    return run


def _joined(size: int, singles: np.ndarray, folds: int):
    """A bucket's count table, joined with its entries: for each slice, the packed sums by document."""
    others = singles.sum(axis=0)[None] - singles
    tokens = others[:, :size].sum(axis=1)
    kind = key_type(size)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, time, doc = (np.frombuffer(b"".join(rows[c]), kind if c == "keys" else np.uint32).astype(np.int64) for c in ("keys", "times", "docs"))
        entries = rows["docs"].map(len).to_numpy() // 4
        fold, doc = doc >> PLACE_BITS, doc & ((1 << PLACE_BITS) - 1)
        sums = []
        if len(key):
            distinct, code = np.unique(key, return_inverse=True)
            counts = np.bincount(code * folds + fold, time, len(distinct) * folds).reshape(-1, folds)
            pair = (counts.sum(axis=1)[code] - counts[code, fold]).astype(np.float64)
            before, after = key // (size + 1), key % (size + 1)
            single = others[fold, after]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log(pair) - np.log(others[fold, before])
                back = np.log(ALPHA) + np.log(single) - np.log(tokens[fold])
            value = time * np.where(pair > 0, seen, np.where(single > 0, back, 2 * np.log(ALPHA) - np.log(size)))
        else:
            value = np.zeros(0)
        ends = np.cumsum(np.r_[0, entries])
        for a, b, n in zip(ends[:-1], ends[1:], rows["n"], strict=True):
            sums.append(np.bincount(doc[a:b], value[a:b], n).astype(np.float64).tobytes())
        return pd.DataFrame({"slice": rows["slice"], "head": rows["head"], "sums": sums})

    return run


def _by_document(rows: pd.DataFrame) -> pd.DataFrame:
    head = next(h for h in rows["head"] if h is not None)
    n = len(rows["sums"].iloc[0]) // 8
    ids, lengths, null = np.frombuffer(head[: 8 * n], np.int64), np.frombuffer(head[8 * n : 12 * n], np.uint32), np.frombuffer(head[12 * n :], np.uint8)
    total = np.sum([np.frombuffer(s, np.float64) for s in rows["sums"]], axis=0)
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": lengths.astype(np.int64), "log_score": total})
    out.loc[null.astype(bool), "doc_id"] = pd.NA
    return out


def scored(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, score (ln S per token), log_score (sum of ln S over its tokens).

    `docs` must give the same rows in the same order whenever a task is run again, as files do; write other frames out first.
    """
    size = Bpe(path).size
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int").alias("fold"))
    singles = np.zeros((FOLDS, size + 1), np.int64)
    found = texts.mapInArrow(_singles(path, size), "fold int, token int, n long").groupBy("fold", "token").agg(F.sum("n").alias("n")).toPandas()
    singles[found.fold, found.token] = found.n  # at most FOLDS x (vocabulary + 1) numbers
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES))
    exploded = texts.mapInArrow(_exploded(path, size, buckets), "slice long, bucket int, n int, head binary, docs binary, keys binary, times binary")
    sums = exploded.groupBy("bucket").applyInPandas(_joined(size, singles, FOLDS), "slice long, head binary, sums binary")
    out = sums.groupBy("slice").applyInPandas(_by_document, "doc_id long, n_tokens long, log_score double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    return out.select(F.col("doc_id").alias(id_col), "n_tokens", mean.alias("score"), "log_score")
