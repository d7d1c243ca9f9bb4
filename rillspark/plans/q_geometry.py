"""Queries on geometries: scans, the ladder of rejections, audits, hydraulic attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions.shared import settled
from rillspark.operators import geometry
from rillspark.operators.roads import steady
from rillspark.plans.q_audit import RULES
from rillspark.sources import geo
from rillspark.sources.tables import table

#: By the remainder of a document's number by twelve: what its geometry is. The coordinates repeat every 252 documents, the source ids every 200.
KINDS = 12
# Attributes as sources give them: numbers as text, some missing, some no numbers.
ATTRIBUTES = """
SELECT p_partkey AS ord, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' ELSE CAST(100 + p_size * 25 AS VARCHAR(20)) END AS diameter_mm,
       CASE p_partkey % 5 WHEN 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS invert_cm, CAST(p_size AS INT) AS slope_permille
FROM {part}"""
# The rules of the test data (column, target, scale, derivation).
HYDRAULIC = (("diameter_mm", "diameter_m", 0.001, ""), ("INVERT_CM", "invert_m", 0.01, "centimetres of the survey"), ("slope_permille", "slope", 0.001, "per mille of the survey"), ("material", "roughness", 1.0, ""))


def _features(spark, sf):
    """A feature for each document, with WKB: broken, empty, invalid, unsupported and sound ones."""
    k = F.col("ord") % KINDS
    x, y = (F.col("ord") % 252 * 7 % 1000).cast("double"), (F.col("ord") % 252 * 13 % 1000).cast("double")
    part = lambda *moves: F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in moves))
    d = k.cast("double")
    kind = F.when(k == 0, None).when(k.isin(4, 5), "Polygon").when(k == 6, "Point").when(k == 7, "MultiLineString").otherwise("LineString")
    parts = (
        F.when(k == 2, F.array().cast(geometry.PARTS)).when(k == 3, F.array(part((0, 0), (0, 0)))).when(k == 4, F.array(part((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))))
        .when(k == 5, F.array(part((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)))).when(k == 6, F.array(part((0, 0)))).when(k == 7, F.array(part((0, 0), (1, 0)), part((5, 0), (5, 2))))
        .otherwise(F.array(part((0, 0), (d, 1), (2 * d, 0))))
    )
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("ord")).select("ord", (F.col("ord") % 200).cast("string").alias("source_id"), F.concat(F.lit(" SRC"), F.col("ord") % 4).alias("source_type"), kind.alias("geom_type"), parts.alias("parts"))
    return geometry.encoded(rows).withColumn("geometry", F.when(k == 1, F.substring("geometry", 1, 11)).otherwise(F.col("geometry")))


def _scanned(spark, sf):
    """Written as a file and scanned."""
    written = settled(_features(spark, sf), "geo")
    files = written.inputFiles()
    return geo.scan(spark, files[0].rsplit("/", 1)[0]) if files else geometry.decoded(written, "geometry")


def _mapped(spark, sf):
    return geometry.mapped(_scanned(spark, sf), spark.sql(RULES).select("raw_type", "feature_type"))


def _hydraulic(spark, sf):
    rows = spark.sql(ATTRIBUTES, part=table(spark, sf, "part"))
    return geometry.hydraulic(rows, HYDRAULIC, "ord").withColumn("value", steady(F.col("value")))


QUERIES = {
    "s3_geo_coordinates": lambda s, d: geometry.coordinates(_scanned(s, d).where("geom_state = 'READ'"), "ord", "geom_type"),
    "f24_geometry_ladder": _mapped,
    "a39_geometry_audit": lambda s, d: geometry.geometry_audit(_scanned(s, d)),
    "f23_hydraulic": _hydraulic,
    "w1_segment_lengths": lambda s, d: geometry.segments(_scanned(s, d).where("geom_state = 'READ'"), "ord").groupBy("ord").agg(F.count(F.lit(1)).alias("segments"), steady(F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2))))).alias("length")),
}

_MOVES = {3: [[(0, 0), (0, 0)]], 4: [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]], 5: [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], 6: [[(0, 0)]], 7: [[(0, 0), (1, 0)], [(5, 0), (5, 2)]]} | {k: [[(0, 0), (k, 1), (2 * k, 0)]] for k in (8, 9, 10, 11)}
_BASE = f"""
WITH f AS (SELECT doc_id AS ord, CAST(doc_id % 200 AS VARCHAR) AS source_id, 'src' || (doc_id % 4) AS raw_type, doc_id % {KINDS} AS k, doc_id % 252 AS m FROM documents),
moves(k, part, place, dx, dy) AS (VALUES {", ".join(f"({k}, {p}, {i}, {dx}, {dy})" for k, parts in _MOVES.items() for p, part in enumerate(parts) for i, (dx, dy) in enumerate(part))}),
points AS (SELECT ord, CASE WHEN k IN (4, 5) THEN 'Polygon' WHEN k = 6 THEN 'Point' WHEN k = 7 THEN 'MultiLineString' ELSE 'LineString' END AS geom_type, part, place, CAST(m * 7 % 1000 + dx AS DOUBLE) AS x, CAST(m * 13 % 1000 + dy AS DOUBLE) AS y FROM f JOIN moves USING (k))"""
ROUNDS = 8


def _ladder_sql() -> str:
    out = ["o0 AS (SELECT ord, source_id, m || ':' || k AS g FROM f WHERE k >= 7)"]
    for r in range(ROUNDS):
        out.append(f"""m{r} AS (SELECT *, ord = min(ord) OVER (PARTITION BY source_id) AND ord = min(ord) OVER (PARTITION BY g) AS keeps FROM o{r}),
d{r} AS (SELECT *, CASE WHEN keeps THEN 'KEPT' WHEN min(CASE WHEN keeps THEN ord END) OVER (PARTITION BY source_id) < ord THEN 'DUPLICATE_ID' WHEN min(CASE WHEN keeps THEN ord END) OVER (PARTITION BY g) < ord THEN 'DUPLICATE_GEOMETRY' END AS decision FROM m{r}),
o{r + 1} AS (SELECT ord, source_id, g FROM d{r} WHERE decision IS NULL)""")
    out.append("raw AS (" + " UNION ALL ".join(f"SELECT ord, decision FROM d{r} WHERE decision IS NOT NULL" for r in range(ROUNDS)) + ")")
    out.append("ids AS (SELECT source_id, min(ord) AS first FROM raw JOIN o0 USING (ord) WHERE decision = 'KEPT' AND source_id IS NOT NULL GROUP BY source_id)")
    out.append("decisions AS (SELECT ord, CASE WHEN decision = 'KEPT' THEN 'KEPT' WHEN first < ord THEN 'DUPLICATE_ID' ELSE 'DUPLICATE_GEOMETRY' END AS decision FROM raw JOIN o0 USING (ord) LEFT JOIN ids USING (source_id))")
    return _BASE + ",\n" + ",\n".join(out) + f""", rules AS ({RULES})
SELECT ord, source_id, CASE WHEN k IN (0, 1) THEN NULL WHEN k IN (4, 5) THEN 'Polygon' WHEN k = 6 THEN 'Point' WHEN k = 7 THEN 'MultiLineString' ELSE 'LineString' END AS geom_type, status,
       CASE WHEN kept THEN coalesce(feature_type, 'UNKNOWN') END AS feature_type, CASE WHEN kept THEN 'drain-' || substr(sha256('drains:' || source_id), 1, 16) END AS feature_id
FROM (SELECT f.*, feature_type, k >= 7 AND decision = 'KEPT' AS kept,
        CASE k WHEN 0 THEN 'REJECTED_MISSING_GEOMETRY' WHEN 1 THEN 'REJECTED_UNPARSEABLE_GEOMETRY' WHEN 2 THEN 'REJECTED_EMPTY_GEOMETRY' WHEN 3 THEN 'REJECTED_INVALID_GEOMETRY' WHEN 4 THEN 'REJECTED_INVALID_GEOMETRY'
               WHEN 5 THEN 'REJECTED_UNSUPPORTED_GEOMETRY' WHEN 6 THEN 'REJECTED_UNSUPPORTED_GEOMETRY' ELSE CASE WHEN decision <> 'KEPT' THEN 'REJECTED_' || decision WHEN feature_type IS NULL THEN 'UNRESOLVED_TYPE' ELSE 'MAPPED' END END AS status
      FROM f LEFT JOIN decisions USING (ord) LEFT JOIN rules USING (raw_type))"""


def _hydraulic_sql() -> str:
    one = lambda column, target, scale, how: f"""SELECT ord, '{target}' AS target, CASE WHEN isfinite(v) THEN round(v * CAST('{scale}' AS DOUBLE) + 1e-9, 6) END AS value,
  CASE WHEN isfinite(v) THEN '{"DERIVED" if how else "PRESENT"}' ELSE 'MISSING' END AS availability, CASE WHEN raw IS NULL OR isnan(v) THEN 'null in source row' WHEN v IS NULL THEN 'non-numeric source value' ELSE {f"'{how}'" if how else "NULL"} END AS note
FROM (SELECT ord, CAST({column} AS VARCHAR) AS raw, TRY_CAST({column} AS DOUBLE) AS v FROM a)"""  # noqa: E731
    return f"WITH a AS ({ATTRIBUTES.replace('{part}', 'part')}) " + " UNION ALL ".join(one(*rule) for rule in HYDRAULIC[:3])


ORACLES = {
    "s3_geo_coordinates": _BASE + " SELECT ord, geom_type, CAST(part AS INT) AS part, CAST(place AS INT) AS place, x, y FROM points",
    "f24_geometry_ladder": _ladder_sql(),
    "a39_geometry_audit": _BASE + """, t AS (SELECT geom_type, count(DISTINCT ord) AS n FROM points GROUP BY geom_type)
SELECT (SELECT count(*) FROM f) AS records, (SELECT geom_type FROM t ORDER BY n DESC, geom_type LIMIT 1) AS geometry_type, (SELECT count(*) FROM f WHERE k = 0) AS missing, (SELECT count(*) FROM f WHERE k = 1) AS unparseable,
       (SELECT count(*) FROM f WHERE k = 2) AS empty, (SELECT count(*) FROM f WHERE k IN (4, 5, 6)) AS unsupported, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north,
       (SELECT count(source_id) - count(DISTINCT source_id) FROM f) AS duplicate_ids, 'AUDIT_PARTIAL' AS status FROM points""",
    "f23_hydraulic": _hydraulic_sql(),
    "w1_segment_lengths": _BASE + """, s AS (SELECT ord, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY ord, part ORDER BY place))
SELECT ord, count(*) AS segments, round(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) + 1e-9, 6) AS length FROM s WHERE x2 IS NOT NULL AND (x <> x2 OR y <> y2) GROUP BY ord""",
}
