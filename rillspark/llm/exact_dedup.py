"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's frequent-items sketch belongs to that family) finds the digests that hold a large share of the
rows. Their exact counts and smallest ids are then verified, and these few winners are broadcast, so that hot groups are
settled map-side and never meet in one task. All other digests are shuffled the ordinary way; none of them is hot.

Results for odd input: null text counts as empty; a null id counts as larger than every id; rows with the same id and text are
one document and are flagged alike; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import scratch, written

#: Counters of the summary.
TRACKED = 4096
#: Most winners that are broadcast, the most frequent ones; a winner is a digest, an id and a count (under 200 bytes), so the broadcast has a fixed bound. A key that
#: holds more than about 1 / WINNERS of the rows is among them; all others take the shuffle.
WINNERS = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def group_copies(rows: DataFrame, key: str, id_col: str = "doc_id", more: dict[str, Column] | None = None) -> DataFrame:
    """`rows` with keep_id (smallest id of the rows with the same key), group_size, and `more` aggregates over these rows.

    `rows` is read three times, so it should be a written table. A null key is a key of its own.
    """
    found = {"keep_id": F.min(id_col), "group_size": F.count(F.lit(1)), **(more or {})}
    counted = rows.agg(F.expr(f"approx_top_k(`{key}`, {WINNERS}, {TRACKED})").alias("top"))
    candidates = counted.select(F.explode("top").alias("top")).select(F.col("top.item").alias(key)).where(F.col(key).isNotNull())
    verified = written(
        rows.select(key, id_col)
        .join(F.broadcast(candidates), key, "left_semi")
        .groupBy(key)
        .agg(*(x.alias(name) for name, x in found.items()))
        .where("group_size > 1"),
        "winners",
    )
    winners = F.broadcast(verified)
    one_key = Window.partitionBy(key)
    rest = rows.join(winners, key, "left_anti").select("*", *(x.over(one_key).alias(name) for name, x in found.items()))
    return rows.join(winners, key).select(*rest.columns).unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. The row with the smallest id of equal normalised texts is kept."""
    digests = written(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")), "digests")
    groups = group_copies(digests, "text_sha256")
    return groups.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, that of the smallest id; all columns stay, whatever their names.

    Rows are told apart by id and digest: of rows with the same id and the same text one stays, and a null id stays only if no row of its text has an id.
    """
    with scratch(docs.sparkSession):
        digest = F.sha2(normalised(F.col(text_col)), 256)
        digests = written(docs.select(F.col(id_col).alias("doc_id"), digest.alias("text_sha256")), "digests")
        kept = group_copies(digests, "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
        kept = written(kept, "kept", keep=True)
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumns({"row_id": F.col(names[docs.columns.index(id_col)]), "row_digest": F.sha2(normalised(F.col(names[docs.columns.index(text_col)])), 256)})
    found = rows.join(kept.hint("shuffle_merge"), F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_digest") == F.col("text_sha256")), "left_semi")
    return found.dropDuplicates(["row_id", "row_digest"]).select(*names).toDF(*docs.columns)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
