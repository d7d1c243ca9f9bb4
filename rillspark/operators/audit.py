"""Audits and mapping of source features and drainage networks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.shared import dropped, settled
from rillspark.operators.roads import steady

#: Most features that one task scans in order (two short texts each are held).
SCANNED = 100_000
# Slope floor; an outlet that is not below its inlet is set OUTLET_DROP lower, but not below OUTLET_FLOOR (metres);
# by waterway the diameter in metres and the roughness, and those of all other waterways.
LEAST_SLOPE, OUTLET_DROP, OUTLET_FLOOR = 0.0005, 0.2, 0.5
WATERWAYS = {"canal": (4.0, 0.025), "river": (4.0, 0.025), "stream": (2.0, 0.020), "ditch": (2.0, 0.020)}
OTHER_WATERWAY = (1.2, 0.015)


def schema_audit(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row a column: type, null share and status; required columns that are absent are MISSING. One aggregate over the rows."""
    kinds = dict(df.dtypes)
    nulls = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    long = nulls.unpivot("n", list(df.columns), "column", "nulls")
    listed = df.sparkSession.createDataFrame([(c, kinds.get(c), c in required) for c in dict.fromkeys([*df.columns, *required])], "column string, dtype string, required boolean")
    share = F.col("nulls") / F.greatest(F.col("n"), F.lit(1))
    status = F.when(F.col("dtype").isNull(), "MISSING").when(F.col("nulls") == F.col("n"), "REJECTED").when(F.col("required") & (F.col("nulls") > 0), "UNRESOLVED").otherwise("ACCEPTED")
    return listed.join(F.broadcast(long), "column", "left").select("column", "dtype", "required", steady(share).alias("null_share"), status.alias("status"))


def dataset_audit(features: DataFrame, least: int = 1) -> DataFrame:
    """One row: records, missing geometry, duplicates by id and by geometry (all but the first), the number of types, status."""
    found = features.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("geometry_text").isNull()).alias("missing_geometry"),
        (F.count("source_id") - F.countDistinct("source_id")).alias("duplicate_ids"), (F.count("geometry_text") - F.countDistinct("geometry_text")).alias("duplicate_geometries"),
        F.countDistinct("source_type").alias("types"),
    )
    bad = F.col("missing_geometry") + F.col("duplicate_ids") + F.col("duplicate_geometries")
    return found.withColumn("status", F.when(F.col("records") < least, "BLOCKED").when(bad > 0, "AUDIT_PARTIAL").otherwise("VALIDATED"))


def stable_id(dataset: str, source_id: Column, geometry_key: Column) -> Column:
    """An id that depends on the data set's name and the source id, or on the geometry where there is none."""
    identity = F.when(F.coalesce(source_id, F.lit("")) != "", source_id).otherwise(F.concat(F.lit("geom:"), F.substring(geometry_key, 1, 32)))
    return F.concat(F.lit("drain-"), F.substring(F.sha2(F.concat(F.lit(f"{dataset}:"), identity), 256), 1, 16))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scan itself, over rows in order: what is kept registers its id and its geometry."""
    ids: set[str] = set()
    geometries: set[str] = set()
    for batch in batches:
        kept = []
        for source_id, key in zip(batch.column("source_id").to_pylist(), batch.column("geometry_key").to_pylist(), strict=True):
            kept.append(source_id not in ids and key not in geometries)
            if kept[-1] and source_id is not None:
                ids.add(source_id)
            if kept[-1] and key is not None:
                geometries.add(key)
        yield pa.record_batch([batch.column("ord"), batch.column("source_id"), pa.array(kept, pa.bool_())], names=["ord", "source_id", "kept"])


def first_wins(features: DataFrame, scanned: int = SCANNED) -> DataFrame:
    """Which features are kept when they are taken in order and one that repeats a kept id or a kept geometry is rejected.

    A rejected feature registers neither its id nor its geometry, so this is a greedy scan. Each round settles, among the open
    features, those that are first both by id and by geometry (kept), and those that share either with a kept one of smaller
    order (rejected); no open feature shares anything with a kept one then. Long chains, each link of which waits for the one before, settle two a round only: as soon as
    no more than `scanned` features are open (they are counted), one task scans them in order. A blank id repeats nothing. First places are found by
    aggregates and joined back, so that a hot id or geometry is combined before the shuffle and split in the join. Rows: ord (unique),
    source_id, geometry_key; a null ord is left out.
    """
    blank = F.coalesce("source_id", F.lit("")) == ""
    open_rows = settled(features.where("ord IS NOT NULL").select("ord", F.when(~blank, F.col("source_id")).alias("source_id"), "geometry_key"), "open")
    decided: list[DataFrame] = []
    kind = dict(features.dtypes)["ord"]
    while True:
        first = lambda key, name, rows: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias(name)).hint("merge")
        ranked = open_rows.join(first("source_id", "id_first", open_rows), "source_id", "left").join(first("geometry_key", "geom_first", open_rows), "geometry_key", "left")
        keeps = (F.col("ord") == F.coalesce("id_first", "ord")) & (F.col("ord") == F.coalesce("geom_first", "ord"))
        marked = settled(ranked.select("ord", "source_id", "geometry_key", keeps.alias("keeps")), "marked")
        kept = marked.where("keeps")
        known = marked.join(first("source_id", "kept_id", kept), "source_id", "left").join(first("geometry_key", "kept_geom", kept), "geometry_key", "left")
        repeats = (F.col("kept_id") < F.col("ord")) | (F.col("kept_geom") < F.col("ord"))
        done = settled(known.select("ord", "source_id", "geometry_key", F.when(F.col("keeps"), True).when(repeats, False).alias("kept")), "decided")
        decided.append(done.where("kept IS NOT NULL").select("ord", "source_id", "kept"))
        dropped(open_rows, marked)
        open_rows = done.where("kept IS NULL").select("ord", "source_id", "geometry_key")
        left = open_rows.count()
        if left <= scanned:
            break
        open_rows = settled(open_rows, "open")
    if left:
        decided.append(settled(open_rows.repartition(1).sortWithinPartitions("ord").mapInArrow(_scanned, f"ord {kind}, source_id string, kept boolean"), "scanned"))
    every = reduce(DataFrame.unionByName, decided)
    # a repeated id is the reason before a repeated geometry, whichever was found first
    ids = every.where("kept AND source_id IS NOT NULL").groupBy("source_id").agg(F.min("ord").alias("kept_id"))
    reason = F.when(F.col("kept"), "KEPT").when(F.col("kept_id") < F.col("ord"), "DUPLICATE_ID").otherwise("DUPLICATE_GEOMETRY")
    return every.join(ids.hint("merge"), "source_id", "left").select("ord", reason.alias("decision"))


def mapped(features: DataFrame, decisions: DataFrame, rules: DataFrame, dataset: str = "drains") -> DataFrame:
    """Every source feature with its mapping status: rejected with a reason, or mapped by an explicit type rule, or unresolved.

    rules: raw_type, feature_type, diameter_m. A type is matched trimmed and lower-cased; it is never guessed.
    """
    raw = F.lower(F.trim(F.coalesce("source_type", F.lit(""))))
    joined = features.join(decisions, "ord", "left").withColumn("raw_type", raw).join(F.broadcast(rules), "raw_type", "left")
    status = (
        F.when(F.col("geometry_text").isNull(), "REJECTED_MISSING_GEOMETRY").when(F.trim("geometry_text") == "", "REJECTED_INVALID_GEOMETRY")
        .when(F.col("decision") != "KEPT", "REJECTED_DUPLICATE").when(F.col("feature_type").isNull(), "UNRESOLVED_TYPE").otherwise("MAPPED")
    )
    named = joined.withColumn("status", status)
    kept = F.col("status").isin("MAPPED", "UNRESOLVED_TYPE")
    availability = F.when(~kept, None).when(F.col("diameter_m").isNull(), "MISSING").otherwise("DERIVED")
    return named.select("ord", "source_id", "status", F.when(kept, F.coalesce("feature_type", F.lit("UNKNOWN"))).alias("feature_type"), F.when(kept, F.col("diameter_m")).alias("diameter_m"), availability.alias("availability"), F.when(kept, stable_id(dataset, F.col("source_id"), F.col("geometry_key"))).alias("feature_id"))


def mapping_statistics(entities: DataFrame) -> DataFrame:
    return entities.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_id").alias("ids"))


def conduits(raw: DataFrame) -> DataFrame:
    """Conduits with length (10 m at least), bed slope and full-bore capacity by their waterway's diameter and roughness.

    An outlet that is not below its inlet is set max(inlet - 0.2, 0.5), so a slope can still be the floor.
    """
    pick = lambda k: F.coalesce(*(F.when(F.col("waterway") == w, F.lit(v[k])) for w, v in WATERWAYS.items()), F.lit(OTHER_WATERWAY[k]))
    sized = raw.withColumns({"length_m": F.greatest(F.lit(10.0), F.col("length_raw_m")), "diameter_m": pick(0), "roughness": pick(1)})
    out = F.when(F.col("z_out") >= F.col("z_in"), F.greatest(F.col("z_in") - OUTLET_DROP, F.lit(OUTLET_FLOOR))).otherwise(F.col("z_out"))
    sloped = sized.withColumn("z_low", out).withColumn("slope", F.greatest(F.lit(LEAST_SLOPE), (F.col("z_in") - F.col("z_low")) / F.col("length_m")))
    area, radius = F.lit(3.141592653589793) * F.col("diameter_m") * F.col("diameter_m") / 4.0, F.col("diameter_m") / 4.0
    capacity = area * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt("slope") / F.col("roughness")
    return sloped.select("conduit_id", "waterway", "from_node", "to_node", "length_m", "diameter_m", steady(F.col("slope"), 5).alias("slope"), steady(capacity, 3).alias("capacity_m3s"), "z_in", "z_low")


def network_summary(found: DataFrame) -> DataFrame:
    """Junctions, conduits, total length and capacity."""
    nodes = found.select(F.explode(F.array("from_node", "to_node")).alias("node")).agg(F.countDistinct("node").alias("junctions"))
    sums = found.agg(F.count(F.lit(1)).alias("conduits"), steady(F.sum("length_m"), 3).alias("total_length_m"), F.round(F.sum("capacity_m3s") + 1e-7, 3).alias("total_capacity_m3s"))
    return nodes.crossJoin(sums)


def outfalls(found: DataFrame, most: int = 10) -> DataFrame:
    """The lowest junctions (both ends of every conduit) become outfalls, ties to the smaller number."""
    ends = found.select(F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("z_in").alias("z")), F.struct(F.col("to_node").alias("node"), F.col("z_low").alias("z")))).alias("e"))
    low = ends.groupBy(F.col("e.node").alias("node")).agg(F.min("e.z").alias("z"))
    return low.orderBy("z", "node").limit(most).select("node", steady(F.col("z")).alias("z"))


def with_known_ends(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Conduits both of whose ends are known nodes."""
    known = nodes.select("node").distinct()
    return found.join(known.withColumnRenamed("node", "from_node"), "from_node", "left_semi").join(known.withColumnRenamed("node", "to_node"), "to_node", "left_semi")


def completeness(entities: DataFrame, features: DataFrame) -> DataFrame:
    """One row: source features, mapped entities and rejections, and whether these two are the whole source."""
    sides = features.select(F.lit(1).alias("source"), F.lit(None).cast("string").alias("status")).unionByName(entities.select(F.lit(0).alias("source"), "status"))
    n = sides.agg(F.count_if(F.col("source") == 1).alias("sources"), F.count_if((F.col("source") == 0) & ~F.col("status").startswith("REJECTED")).alias("entities"), F.count_if((F.col("source") == 0) & F.col("status").startswith("REJECTED")).alias("rejections"))
    return n.withColumn("complete", F.col("sources") == F.col("entities") + F.col("rejections"))


def table_fingerprints(rows: DataFrame, columns: tuple[str, ...], *by: str) -> DataFrame:
    """Rows and a fingerprint of the content of each group: the sum of 60 bits of every row's digest, whatever their order. Null counts as a text of its own."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("fingerprint"))
