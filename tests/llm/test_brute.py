"""The learned queries, and the pipeline, against versions of them that are written plainly, row by row."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_near

from rillspark.llm import exact_dedup, near_dedup, quality, queries, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    return docs, labels, {r.doc_id: r.text or "" for r in docs.collect()}


def plain_toxicity(lexicon, text):
    """By trying every term at every place of the folded text."""
    words = [toxicity.folded(w) for w in text.split()]
    line = f" {'  '.join(words)} "
    spared = [(k, k + len(p) - 1) for p in lexicon.exceptions for k in range(len(line)) if line.startswith(p, k)]
    total = []
    for k in range(len(line)):
        found = [t for t in lexicon.weights if line.startswith(t, k)]
        if found:
            best = max(found, key=len)
            if not any(a <= k and k + len(best) - 1 <= b + 1 for a, b in spared):
                total.append(lexicon.weights[best])
    x = lexicon.bias + lexicon.by_sum * math.log1p(math.fsum(total)) + lexicon.by_rate * math.fsum(total) / (len(words) + 20)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), len(total)


def plain_quality(model, row):
    total = model.base + sum(table[sum(c <= v for c in cuts)] for cuts, table, v in zip(model.cuts, model.tables, row, strict=True))
    total += sum(table[sum(c <= row[i] for c in model.coarse[i]), sum(c <= row[j] for c in model.coarse[j])] for i, j, table in model.pairs)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_op9_against_a_plain_search(spark, tables):
    docs, labels, texts = tables
    lexicon = toxicity.learn(docs, labels)
    found = {r.doc_id: r for r in queries.op9_toxicity(spark, SMALL).collect()}
    assert found.keys() == texts.keys()
    for i, text in list(texts.items()):
        score, _ = plain_toxicity(lexicon, text)
        assert math.isclose(found[i].score, score, rel_tol=1e-9) and found[i].predicted == (score >= 0.5)


def test_matching_against_a_plain_search():
    rng = np.random.default_rng(4)
    terms = {f" {''.join(rng.choice(list('ab'), rng.integers(1, 4)))}{' ' * int(rng.integers(0, 2))}": float(rng.integers(1, 5)) for _ in range(12)}
    lexicon = toxicity.Lexicon(terms, frozenset({" ab  a ", " b  bb "}))
    scorer = toxicity.Scorer(lexicon)
    for _ in range(300):
        text = " ".join("".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(rng.integers(0, 9)))
        assert scorer.score(text) == pytest.approx(plain_toxicity(lexicon, text))


def test_op4_against_plain_additions(spark, tables):
    docs, labels, texts = tables
    model = quality.learn(docs, labels)
    found = {r.doc_id: r for r in queries.op4_quality(spark, SMALL).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        score = plain_quality(model, quality.features(pa.array([text]))[0])
        assert math.isclose(found[i].score, score, rel_tol=1e-6, abs_tol=1e-9) and found[i].predicted == (found[i].score >= 0.3)


def test_pipeline_against_plain_stages(spark, tables):
    docs, labels, texts = tables
    lexicon = toxicity.learn(docs, labels)
    rows = {i: t for i, t in texts.items() if plain_toxicity(lexicon, t)[0] < 0.5}
    clean = docs.where(F.col("doc_id").isin(list(rows)))
    model = quality.learn(clean, labels)
    rows = {i: t for i, t in rows.items() if plain_quality(model, quality.features(pa.array([t]))[0]) >= 0.3}
    first = {}
    for i in sorted(rows):
        first.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]).encode()).digest(), i)
    rows = {i: rows[i] for i in first.values()}
    _, component = brute_near(list(rows.items()), 5, 80)
    kept = {i for i in rows if component[i] == i}
    packed = queries.queries()["pipeline"](spark, SMALL)
    held = {r.doc_id: (r.n, r.doc_tokens) for r in packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()}
    assert held.keys() == kept and all(n == tokens for n, tokens in held.values())


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls, repeated rows, and columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, kept_id long, keep_id string, digest string, component string, score double, kept boolean"
    rows = [(1, "a b c d e f g", 7, "x", "y", "z", 0.0, True), (2, "A  b c d e f g", 7, "x", "y", "z", 0.0, True), (2, "A  b c d e f g", 7, "x", "y", "z", 0.0, True), (3, None, None, None, None, None, None, None), (None, "a b c d e f g", 1, "x", "y", "z", 0.0, True)]
    frame, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for stage in (exact_dedup.without_copies, near_dedup.without_near_copies, lambda d: quality.with_quality(d, quality.learn(d, none)), lambda d: toxicity.without_toxic(d, toxicity.learn(d, none))):
        assert stage(empty).count() == 0 and stage(empty).columns == frame.columns
        assert stage(frame).columns == frame.columns
    assert sorted(r.doc_id for r in exact_dedup.without_copies(frame).where("doc_id IS NOT NULL").collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in near_dedup.without_near_copies(frame).where("doc_id IS NOT NULL").collect()) == [1, 3]


def test_near_dedup_with_text_ids(spark):
    frame = spark.createDataFrame([("x9", "a b c d e f g h i j k"), ("x10", "a b c d e f g h i j k"), ("b", "a b c d e f g h i j k l"), ("c", "other words here are not alike at all")], "doc_id string, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame, words=2).collect()}
    assert found == {"x9": "b", "x10": "b", "b": "b", "c": "c"}


def test_long_words_hash_alike_anywhere():
    """A word of several blocks has one hash, whatever stands around it."""
    long = "é" * (near_dedup.BLOCK_BYTES + 7)
    texts = [f"a {long} b", f"{long}", f"x y {long}", "a b", f"{long} {'q ' * 700_000}{long}"]
    one = [set(s.tolist()) for s in near_dedup.shingle_sets(pa.array(texts), 1)]
    word = one[1]
    assert len(word) == 1 and all(word <= s for k, s in enumerate(one) if k != 3) and len(one[0]) == 3 and len(one[4]) == 2
