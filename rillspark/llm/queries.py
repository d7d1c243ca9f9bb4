"""The queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm import ann, bpe, centroids, collocations, exact_dedup, html_extract, lm_score, near_dedup, packing, quality, sharding, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir), words=2, percent=80)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), bpe.vocabulary_path(), length=2048, closing=1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scores = quality.scored(docs, quality.learn(docs, _labels(spark, sf_dir)))
    return scores.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(_documents(spark, sf_dir), bpe.vocabulary_path())


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(vectors, F.col("vec_id") % 100 == 0, k=10).select("query_id", "rank", "vec_id", "score")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract.extracted(pages, html_extract.train(pages))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_documents(spark, sf_dir), bpe.vocabulary_path(), with_ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scores = toxicity.scored(docs, toxicity.learn(docs, _labels(spark, sf_dir)))
    return scores.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The shards of op10: what a training job of 64 readers would open.
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_documents(spark, sf_dir).select("doc_id"), SHARDS)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.round_trip(pages)


#: The contract of op12: 40 centroids, five rounds, seeds by the hash of this salt and the id.
CLUSTERS = {"k": 40, "rounds": 5, "salt": "2:"}


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), **CLUSTERS)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_near_dedup": op2_near_dedup,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_lm_score": op5_lm_score,
        "op6_ann": op6_ann,
        "op7_html_extract": op7_html_extract,
        "op8_bpe": op8_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
        "op11_warc": op11_warc,
        "op12_centroids": op12_centroids,
        "op13_collocations": op13_collocations,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """The others' SQL cannot be written: they learn models, or depend on a tokenizer's tables; see tests/llm."""
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_near_dedup": near_dedup.ORACLE,
        "op10_sharding": sharding.oracle(SHARDS),
        "op11_warc": warc.ORACLE,
        "op12_centroids": centroids.oracle(**CLUSTERS),
        "op13_collocations": collocations.oracle(),
    }
