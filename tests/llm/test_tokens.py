"""BPE against the library, packing and LM scores against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.llm import bpe, lm_score, packing

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [
    "", None, "  a  b", "\n\nx <|endoftext|> y<|endoftext|>", " x\t y\r\n z q", "don't 's it's I'LL", " a", "a ", "é́漢字 12³½ ​ x", "a" * 300 + " bbbbb", "\x1c a \x85 b", " \n a", "a \n b",
    "日本語テキスト　です 😀😀👍🏽", "''''s !!!??", "<|endoftext|>", "x\x00y �", "word " * 20_000, "ErNd​x",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def corpus(spark, sf_dir):
    odd = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd)


def test_bpe_equals_library(spark, sf_dir, library):
    docs = corpus(spark, sf_dir)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    coded = bpe.encoded(docs, bpe.vocabulary_path())
    for r in coded.collect():
        expected = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == expected and r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decoded(coded, bpe.vocabulary_path()).select("doc_id", "text").collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    assert bpe.encoded(docs.limit(0), bpe.vocabulary_path()).count() == 0


def test_bounded_tables_give_the_same(monkeypatch):
    one = bpe.Bpe(bpe.vocabulary_path())
    texts = [f"alpha{k} beta{k % 7} the the, gamma" for k in range(300)]
    whole = [b"".join(x) for x, _ in one.encode_batch(texts)]
    monkeypatch.setattr(bpe, "MOST_PIECES", 10)
    two = bpe.Bpe(bpe.vocabulary_path())
    assert [b"".join(x) for k in range(0, 300, 7) for x, _ in two.encode_batch(texts[k : k + 7])] == whole


def test_packing(spark, sf_dir, library):
    docs = corpus(spark, sf_dir)
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    pieces = packing.packed(docs, bpe.vocabulary_path()).collect()
    held, room = Counter(), {}
    for p in pieces:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        held[p.doc_id] += p.length
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert held == {i: len(x) for i, x in ids.items()}
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.packed(docs.limit(0), bpe.vocabulary_path()).count() == 0


def test_pack_is_balanced():
    sizes = np.random.default_rng(1).integers(1, 3000, 400)
    pieces = packing.pack(sizes, 2048)
    assert sum(p[2] for p in pieces) == sizes.sum()
    cost = Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    whole = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 2048 and sum(1 for p in pieces if p[3] == s) > 1]
    assert max(whole) / np.mean(whole) < 1.6


def test_lm_scores_against_brute_force(spark, library):
    rows = [(k, f"the cat {k % 5} sat on the mat {k % 3} the end") for k in range(40)] + [(100, None), (101, "zebra quux"), (None, "the cat"), (3, "again the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fold = {r.doc_id: r.fold for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(lm_score.FOLDS)).alias("fold")).collect()}
    size = bpe.Bpe(bpe.vocabulary_path()).size
    tokens = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    expected = []
    for (i, _), own in zip(rows, tokens, strict=True):
        one, two = Counter(), Counter()
        for (j, _), other in zip(rows, tokens, strict=True):
            if fold[j] != fold[i]:
                one.update(other)
                two.update(zip([size, *other], other, strict=False))
                one[size] += bool(other)
        n, total = sum(c for w, c in one.items() if w != size), 0.0
        for v, w in zip([size, *own], own, strict=False):
            total += math.log(two[v, w] / one[v]) if two[v, w] else math.log(0.4 * one[w] / n) if one[w] else math.log(0.4 * 0.4 / size)
        expected.append((i, len(own), total))
    found = lm_score.scored(docs, bpe.vocabulary_path()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for r, e in zip(sorted(((r.doc_id, r.n_tokens, r.log_score) for r in found), key=key), sorted(expected, key=key), strict=True):
        assert r[:2] == e[:2] and math.isclose(r[2], e[2], rel_tol=1e-9, abs_tol=1e-9)
    assert lm_score.scored(docs.limit(0), bpe.vocabulary_path()).count() == 0


@pytest.mark.parametrize("gap", [" ", "\t", "\n", " \n\t"])
def test_long_white_space(spark, gap):
    """Packing and scoring take two million white-space characters, alone, inside and at the end, as BPE does."""
    run = gap * (2_000_000 // len(gap))
    texts = [run, f"{run}x", f"a b{run}", f"one two{run}three <|endoftext|> four" + " five" * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = bpe.vocabulary_path()
    ids = {r.doc_id: np.array(r.ids, "<u4") for r in bpe.encoded(docs, path).collect()}
    assert all(np.array_equal(packing.token_ids(path, t), ids[i]) for i, t in enumerate(texts))
    held = packing.packed(docs, path).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in held} == {i: len(x) + 1 for i, x in ids.items()}
    assert {r.doc_id: r.n_tokens for r in lm_score.scored(docs, path).collect()} == {i: len(x) for i, x in ids.items()}
