"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n: the work of the layers and of attention. Each task packs what it
reads, a window of about WINDOW sequences at a time, so there is no shuffle, no hot key and a fixed bound on memory. In a window:

1. A document of more than a sequence gives full sequences; what is left over is packed.
2. The window's sequences have room for exactly its tokens: full ones, and for the rest sequences of a power of two (which need
   no padding). So there is no padding at all.
3. Leftovers, in descending cost, go to the sequence of lowest cost that has room for them. One that fits nowhere is cut:
   the sequence with most room takes what it can.

Results for odd input: null or empty text is the closing id alone; rows with the same id and text are packed each for itself;
ids are integers, or texts of integers, and may be null; an empty table gives an empty result; further columns are ignored, whatever their names. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.bpe import PATTERN, Bpe, loaded
from rillspark.llm.common import slices

#: Sequences of a window; a window's ids take WINDOW * length * 4 bytes.
WINDOW = 1024
#: Characters that the compiled library gets at a time.
MOST_CHARS = 100_000
#: Cost per token, and per pair of tokens of a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The vocabulary file, run by a compiled library; it gives the same ids as Bpe."""
    tables = Bpe(path)
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=tables.ids, special_tokens=tables.special)


def _bounded(path: str, text: str) -> Iterator[np.ndarray]:
    """The ids of a long text, part by part. The library's pattern gives up on long runs of white space; pieces that are long by themselves take the trie's way."""
    tables, held, size = loaded(path), [], 0
    for piece in [*tables.cut(text), None]:
        if held and (piece is None or size + len(piece) > MOST_CHARS):
            yield np.array(tokenizer(path).encode("".join(held), allowed_special="all", disallowed_special=()), dtype="<u4")
            held, size = [], 0
        if piece is not None and len(piece) > MOST_CHARS:
            words = [w.encode() for w in tables.split.findall(piece)]
            codes, _ = tables.encode_words(set(words))
            yield np.frombuffer(b"".join(map(codes.__getitem__, words)), "<u4")
        elif piece is not None:
            held.append(piece)
            size += len(piece)


def token_ids(path: str, text: str | None) -> np.ndarray:
    """The ids of a text, special tokens in it included; null counts as empty."""
    if text and len(text) > MOST_CHARS:
        return np.concatenate(list(_bounded(path, text)))
    return np.array(tokenizer(path).encode(text or "", allowed_special="all", disallowed_special=()), dtype="<u4")


def rooms(tokens: int, length: int) -> list[int]:
    """Room for exactly so many tokens: full sequences, then powers of two."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << k for k in range(length.bit_length(), -1, -1) if rest >> k & 1]


def pack(sizes: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, n, sequence, offset) of pieces that hold each document's tokens once."""
    room = np.array(rooms(int(sizes.sum()), length), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out = []
    price = lambda n: LINEAR * n + QUADRATIC * n * n

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, int(used[s])))
        used[s] += n
        cost[s] += price(n)
        if used[s] == room[s]:
            cost[s] = np.inf  # full

    free, rest = 0, []
    for doc, size in enumerate(sizes.tolist()):
        start = 0
        while size - start >= length:
            put(doc, start, length, free)
            start, free = start + length, free + 1
        if start < size:
            rest.append((size - start, doc, start))
    for n, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            left = room - used
            s = int(np.where(left >= n, cost, np.inf).argmin())
            if left[s] < n:
                s = int(left.argmax())
            part = min(n, int(left[s]))
            put(doc, start, part, s)
            start, n = start + part, n - part
    return out


def _packed(path: str, length: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 36
        docs: list[tuple[object, np.ndarray]] = []
        held = 0

        def window() -> pa.RecordBatch:
            nonlocal docs, held, first
            docs.sort(key=lambda d: (-len(d[1]), d[0] is None, d[0]))
            sizes = np.array([len(ids) for _, ids in docs], np.int64)
            pieces = pack(sizes, length)
            filled, cost = {}, {}
            for _, _, n, s, _ in pieces:
                filled[s] = filled.get(s, 0) + n
                cost[s] = cost.get(s, 0.0) + LINEAR * n + QUADRATIC * n * n
            at = lambda k: pa.array([p[k] for p in pieces], pa.int64())
            out = pa.record_batch(
                [
                    pa.array([docs[p[0]][0] for p in pieces], pa.int64()), at(1), at(2),
                    pa.array([zlib.crc32(docs[d][1][a : a + n].tobytes()) for d, a, n, _, _ in pieces], pa.int64()),
                    pa.array([len(docs[p[0]][1]) for p in pieces], pa.int64()),
                    pa.array([first + p[3] for p in pieces], pa.int64()), at(4),
                    pa.array([filled[p[3]] for p in pieces], pa.int64()), pa.array([cost[p[3]] for p in pieces], pa.float64()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "cost"],
            )
            first += max(filled) + 1
            docs, held = [], 0
            return out

        for batch in slices(batches, "text", 2_000_000):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append((doc, np.append(token_ids(path, text), np.uint32(closing)).astype("<u4")))
                held += len(docs[-1][1])
                if held >= WINDOW * length:
                    yield window()
        if docs:
            yield window()

    return run


def packed(docs: DataFrame, path: str, length: int = 2048, closing: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the sequence's tokens and cost.

    A document's ids are those of its text and then `closing`. Ids of documents are integers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packed(path, length, closing), f"doc_id long, {SCHEMA}").withColumnRenamed("doc_id", id_col)
