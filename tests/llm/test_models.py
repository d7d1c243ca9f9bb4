"""Classifiers by held-out accuracy, extraction on known pages, neighbours and shards by brute force, the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.llm import ann, html_extract, quality, queries, sharding, toxicity

MEDIUM = "/root/testdata/sf0.01"


def test_folding_and_matching():
    assert toxicity.folded("L0ser!") == "loser" and toxicity.folded("lоsеr") == "loser" and toxicity.folded("2024") == "2024" and toxicity.folded("lo​ser") == "loser"
    lexicon = toxicity.Lexicon({" loser ": 5.0, " lowei": 4.0}, frozenset({" sore  loser "}))
    scorer = toxicity.Scorer(lexicon)
    assert scorer.measure("a L0SER, here")[:2] == (5.0, 1)
    assert scorer.measure("a sore loser here")[:2] == (0.0, 0)
    assert scorer.measure("loweichen and closer")[:2] == (4.0, 1)
    assert scorer.score("")[0] < 0.5 < scorer.score("loser loser")[0]


def test_toxicity_learns(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        text = [*rng.choice(words, 60), *((["badword", "vile" + str(rng.integers(9))]) if toxic else [])]
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "badword " * 3)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (9001, None, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, marks)
    found = {r.doc_id: r.score for r in toxicity.scored(docs, lexicon).collect()}
    assert all((found[k] >= 0.5) == (k % 5 == 0) for k in range(600))
    assert found[9001] == found[9002] < 0.5 < found[9003]
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.where("doc_id < 600").count() == 480
    assert toxicity.learn(docs, marks.limit(0)).weights == {}
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    found = [r for r in queries.op4_quality(spark, MEDIUM).collect() if r.held_out and r.doc_id in truth]
    good, bad = [r.score for r in found if truth[r.doc_id]], [r.score for r in found if not truth[r.doc_id]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.9


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "x" * 100_000), (None, "a b c"), (1, None)], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    scores = quality.scored(docs, model).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    assert quality.with_quality(docs, model).columns == docs.columns
    assert quality.scored(docs.limit(0), model).count() == 0


def test_gam_fits_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


@pytest.mark.parametrize(("n", "hot"), [(3000, False), (9000, True), (8, False)])
def test_neighbours_against_brute_force(spark, n, hot):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, n)]
    if hot:
        x[::3] = x[0]
    x = x.astype(np.float32)
    rows = [(k, x[k].tolist()) for k in range(n)] + [(n, None), (n + 100 - n % 100, [0.0] * 16), (10**6, [float("nan")] * 16), (10**6 + 100, [None] * 16), (None, [1.0] * 16), (10**7, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    found = {}
    for r in ann.neighbours(frame, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = range(0, n, 100)
    assert set(found) == set(asked)
    hits, wanted = 0, 0
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(n), d)) if i != q][:10]
        mine = [found[q][k] for k in sorted(found[q])]
        assert len(mine) == len(order) and all(abs(s - d[i]) < 1e-9 for i, s in mine) and mine == sorted(mine, key=lambda t: (t[1], t[0]))
        hits, wanted = hits + len({i for i, _ in mine} & set(order)), wanted + len(order)
    assert hits >= 0.9 * wanted


def test_neighbours_of_nothing(spark):
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_blocks():
    page = '<html><head><title>t</title><script>var a="</p>"</script></head><body><!-- no --><div>A &amp; <b>b</b>c\n d<br>x<p>One<p>Two <ul><li>l1<li>l2</ul></div>tail<style>p{}</style>'
    assert [b.text for b in html_extract.blocks(page)] == ["A & bc d", "x", "One", "Two", "l1", "l2", "tail"]
    assert html_extract.blocks("") == [] and [b.text for b in html_extract.blocks("a < b")] == ["a < b"]
    assert [b.text for b in html_extract.blocks("<p>" * 3000 + "deep")] == ["deep"] and html_extract.blocks('<a href="') is not None


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 3, html_extract.WIDTH)).astype(np.float32), (rng.random((5, 3)) < 0.5).astype(np.float32)
    mask = np.ones((5, 3), np.float32)
    mask[3:, 0] = 0
    net = html_extract.Labeller()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    grad = net.gradients(x.astype(np.float64), mask, y)

    def loss():
        z = net.logits(x.astype(np.float64), mask)
        return float(((np.logaddexp(0, z) - z * y) * mask).sum() / mask.sum())

    for k, w in net.weights.items():
        at = np.unravel_index(int(np.abs(grad[k]).argmax()), w.shape)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        down = loss()
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - grad[k][at]) < 0.05 * abs(grad[k][at]) + 1e-4


def test_extraction(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    net = html_extract.train(pages)
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<nav><a href=x>only</a></nav>")], "page_id long, url string, html string")
    both = pages.unionByName(odd).withColumn("text", F.lit("clash"))
    found = {r.page_id: r for r in html_extract.extracted(both, net).collect()}
    assert len(found) == pages.count() + 3 and found[-1].text == "" and found[-2].n_chars == 0
    right = 0
    rows = pages.collect()
    for r in rows:
        expected = " ".join(b.text for b in html_extract.blocks(r.html) if "article" in b.path)
        right += found[r.page_id].text == expected
    assert right >= 0.97 * len(rows)
    other = '<div class=wrapper><header><h1>Site</h1></header><div class="content"><h1>Head line</h1><p>One long enough sentence stands here.<p>And another sentence stands there, too.</div><div class="comments"><p>I agree.</p></div><footer>(c) me</footer></div>'
    text = html_extract.extracted(spark.createDataFrame([(1, other)], "page_id long, html string"), net).first().text
    assert "One long enough" in text and "another sentence" in text and "(c) me" not in text and "Site" not in text
    assert html_extract.extracted(pages.limit(0), net).count() == 0


def test_shards(spark):
    table = np.array(sharding.filled(queries.SHARDS))
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = np.array(sharding.filled(queries.SHARDS[:-1]))
    moved = (table != fewer) & (table != len(queries.SHARDS) - 1)
    assert moved.mean() < 0.1
    rows = spark.createDataFrame([(k,) for k in [*range(2000), None, 5]], "doc_id long").withColumn("shard", F.lit("clash"))
    found = sharding.sharded(rows, queries.SHARDS)
    assert found.count() == 2002 and found.columns == ["doc_id", "slot", "shard"] and found.where("doc_id = 5").select("shard").distinct().count() == 1
    assert sharding.sharded(rows.limit(0), queries.SHARDS).count() == 0
    with pytest.raises(ValueError):
        sharding.filled(("a", "a"))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    rows, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows.count()
        rows = stage(spark, rows, MEDIUM).cache()
        assert rows.columns == columns and 0 < rows.count() <= before, name
    kept = {r.doc_id for r in rows.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, MEDIUM)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    quality_of = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert np.mean([quality_of[i][0] for i in kept if i in quality_of]) > 0.95


def test_null_ids_and_an_unbounded_lexicon(spark, sf_dir):
    """Rows with a null id are held out and scored; without bounds the lexicon is no smaller."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(None, "some text"), (None, None)], "doc_id long, text string")
    more = docs.unionByName(odd)
    for scores in (toxicity.scored(more, toxicity.learn(more, labels)), quality.scored(more, quality.learn(more, labels))):
        rows = scores.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score").where("doc_id IS NULL").collect()
        assert [r.held_out for r in rows] == [True, True] and all(0 <= r.score <= 1 for r in rows)
    bounded, free = toxicity.learn(docs, labels, terms=20, phrases=1), toxicity.learn(docs, labels, terms=None, phrases=None)
    assert len(bounded.exceptions) <= 1 and len(bounded.weights) <= 20 and len(free.weights) >= len(bounded.weights) and len(free.exceptions) >= len(bounded.exceptions)
