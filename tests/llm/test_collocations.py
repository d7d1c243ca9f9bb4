"""Phrases against a plain count of all n-grams, whatever the buckets let through."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rillspark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "n long, lang string, text string, phrase string, words string"


def plain(rows, least, most=5, share=100, factor=1000, first=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in good.items():
            score, k = min((factor * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
            if not any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in good.items()):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts():
    rng = np.random.default_rng(5)
    words = ["a", "b", "B", "c", "d", "É", "e f", "long" * 40]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + str(rng.choice([" ", "  ", "\t", ". ", "\n", " ? "], p=[0.7, 0.06, 0.06, 0.06, 0.06, 0.06])) for _ in range(rng.integers(0, 60)))) for _ in range(150)]
    rows = [(None if lang is None else str(lang), t) for lang, t in rows]
    return [*rows, ("en", None), ("en", ""), ("de", " . ,"), ("und", "a b c d e " * 30), ("en", "x y z " * 5000), ("en", "x y z " * 5000), ("es", "no phrase of this one is frequent")]


@pytest.mark.parametrize(("least", "buckets", "share"), [(4, 1 << 25, 100), (4, 1 << 15, 100), (20, 1 << 15, 80), (2, 1 << 20, 100)])
def test_against_plain_counts(spark, least, buckets, share):
    rows = texts()
    frame = spark.createDataFrame([(1, lang, t, "p", "w") for lang, t in rows], SCHEMA).repartition(4)
    found = sorted(tuple(r) for r in collocations.collocations(frame, least, share=share, buckets=buckets, first=40).collect())
    assert found == plain(rows, least, share=share, first=40)


def test_other_lengths_and_empty_tables(spark):
    rows = texts()
    frame = spark.createDataFrame([(1, lang, t, "p", "w") for lang, t in rows], SCHEMA)
    for most in (2, 3):
        assert sorted(tuple(r) for r in collocations.collocations(frame, 5, most=most).collect()) == plain(rows, 5, most=most)
    assert collocations.collocations(frame.limit(0)).count() == 0
    assert collocations.collocations(frame.where("text = ''")).count() == 0


def test_light_buckets_only_save(spark, monkeypatch):
    """With every bucket taken for heavy, the counts are the same."""
    rows = texts()
    frame = spark.createDataFrame([(1, lang, t, "p", "w") for lang, t in rows], SCHEMA)
    as_set = lambda df: {(r.lang, tuple(r.words), r.f) for r in df.collect()}
    some = as_set(collocations.phrase_counts(frame, 6, buckets=1 << 15))
    monkeypatch.setattr(collocations, "frequent_buckets", lambda texts, least, buckets, *more: np.full(buckets // 8, 255, np.uint8))
    assert as_set(collocations.phrase_counts(frame, 6, buckets=1 << 15)) == some


def test_words_of_a_slice():
    texts = pa.array(["Ab  cd,e\tF", None, "", "g", "h. ", "é É"])
    words = collocations.Words(texts)
    assert words.dictionary.take(pa.array(words.code)).to_pylist() == ["ab", "cd", "e", "f", "g", "h", "é", "É"]
    assert words.row.tolist() == [0, 0, 0, 0, 3, 4, 5, 5]
    assert words.joined.tolist() == [True, False, True, False, False, False, True, False]


def test_scores_beyond_64_bits(spark):
    """1000 * a * n of large counts does not fit in 64 bits; the quotient is exact."""
    big = 3_000_000_007
    counts = spark.createDataFrame([("en", ["x"], big), ("en", ["y"], big + 4), ("en", ["x", "y"], big - 10), ("en", [], 7 * big + 3)], "lang string, words array<string>, f long")
    (row,) = collocations._collocations(counts, 5, 100, 1000, 10).collect()
    assert row.score == 1000 * (big - 10) * (7 * big + 3) // (big * (big + 4))
