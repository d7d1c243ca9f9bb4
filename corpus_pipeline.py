"""The corpus pipeline: toxicity, quality, exact dedup, near-dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but
the last return the columns of documents. `run` writes each stage's rows to the shared folder and reads them back, so that a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillspark.llm import bpe, exact_dedup, near_dedup, packing, quality, toxicity
from rillspark.llm.common import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, _labels(spark, sf_dir)), threshold=0.5)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.with_quality(docs, quality.learn(docs, _labels(spark, sf_dir)), threshold=0.3)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs, words=5, percent=80)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, bpe.vocabulary_path(), length=2048, closing=1)


STAGES = [
    ("toxicity", _toxicity),
    ("quality", _quality),
    ("exact_dedup", _exact),
    ("near_dedup", _near),
    ("packing", _packing),
]

#: The learned stages and the tokenizer cannot be written in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
