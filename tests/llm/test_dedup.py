"""Exact dedup, near-dedup, components: brute force on small fixtures, odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rillspark.llm import near_dedup
from rillspark.llm.components import connected_components
from rillspark.llm.exact_dedup import exact_dedup, without_copies
from rillspark.llm.near_dedup import near_dedup as near
from rillspark.llm.near_dedup import shingle_sets, without_near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash") for i, t in rows], SCHEMA)


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_dedup_odd_rows(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, None), (5, ""), (4, "x" * 200_000), (7, "a b"), (None, "a b"), (8, " a b"), (1, "a\tb")]
    found = exact_dedup(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for r in found:
        same = [i for (i, _), n in zip(rows, norm, strict=True) if hashlib.sha256(n.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in same if i is not None]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(same), r.doc_id == min(ids))


def test_exact_dedup_hot_group_and_empty(spark):
    rows = [(k, "hot" if k % 3 else f"text {k}") for k in range(3000)]
    found = {r.doc_id: r for r in exact_dedup(docs(spark, rows)).collect()}
    assert found[2999].keep_id == 1 and found[2999].group_size == 2000 and not found[2999].kept
    assert sum(r.kept for r in found.values()) == 1001
    kept = without_copies(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep_id"] and kept.count() == 1001
    assert exact_dedup(docs(spark, [])).count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == brute_components({x for link in real for x in link}, real)


def test_shingles_match_plain_python():
    texts = ["The cat  sat\non The CAT sat", "one", "", None, "Ärger ÄRGER a b", "\x1fa \x1cb c", "a b a b a b", "x " * 5000]
    for n in (1, 2, 5):
        for t, found in zip(texts, shingle_sets(pa.array(texts), n), strict=True):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
            expected = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
            assert len(found) == len(expected)
    a, b = shingle_sets(pa.array(["p q r s", "P  Q r\ts"]), 2)
    assert np.array_equal(a, b)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def brute_near(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, brute_components(sets, links)


@pytest.mark.parametrize("chunk", [1024, 40])
def test_near_dedup_against_brute_force(spark, monkeypatch, chunk):
    """With small chunks, the hot cluster is compared in many blocks; no link between components may be lost."""
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.choice((0.0, 0.02, 0.04, 0.06, 0.08))))) for k in range(150)]
    for g in range(150, 250, 4):
        own = [f"v{rng.randrange(10**9)}" for _ in range(60)]
        rows += [(g + j, " ".join(edited(rng, own, 0.02 * j))) for j in range(4)]
    rows += [(900, None), (901, "  \n"), (902, "single"), (903, "Single"), (904, "single other"), (905, rows[0][1].upper())]
    found = {r.doc_id: r for r in near(docs(spark, rows), words=2, percent=80).collect()}
    sets, component = brute_near(rows, 2, 80)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (len(s), component[i], component[i] == i) for i, s in sets.items()}


def test_near_dedup_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g h"), (3, ""), (4, "y " * 30_000)]
    found = near(docs(spark, rows), words=2, percent=80).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (None, None), (2, 1), (3, 3), (4, 4)}
    assert near(docs(spark, []), words=2).count() == 0
    kept = without_near_copies(docs(spark, [(1, "a b c d e f g h i j"), (2, "A b c d e f g h i j"), (3, "q r s t u v w")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns[-1] == "keep_id"
