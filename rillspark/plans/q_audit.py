"""Queries on source features and drainage networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import audit
from rillspark.plans.testbed import view, with_views

REQUIRED = ("source_id", "geometry_text", "diameter_mm")
# The rules of the test data.
RULES = "SELECT * FROM (VALUES ('src0', 'DRAIN', CAST(1.2 AS DOUBLE)), ('src1', 'CULVERT', CAST(0.9 AS DOUBLE)), ('src2', 'CANAL', CAST(NULL AS DOUBLE))) AS t(raw_type, feature_type, diameter_m)"


def _features(spark, sf):
    return view(spark, sf, "feature").withColumn("geometry_key", F.sha2("geometry_text", 256))


def _decisions(spark, sf):
    return audit.first_wins(_features(spark, sf).where("geometry_text IS NOT NULL AND trim(geometry_text) <> ''"))


def _mapped(spark, sf):
    return audit.mapped(_features(spark, sf), _decisions(spark, sf), spark.sql(RULES))


def _conduits(spark, sf):
    return audit.conduits(view(spark, sf, "conduit"))


QUERIES = {
    "a38_schema_audit": lambda s, d: audit.schema_audit(view(s, d, "feature"), REQUIRED).select("column", "required", "null_share", "status"),
    "a39_dataset_audit": lambda s, d: audit.dataset_audit(view(s, d, "feature")),
    "w12_first_wins": _decisions,
    "f22_mapped_features": _mapped,
    "a40_mapping_statistics": lambda s, d: audit.mapping_statistics(_mapped(s, d)),
    "x4_completeness": lambda s, d: audit.completeness(_mapped(s, d), view(s, d, "feature")),
    "f26_table_fingerprints": lambda s, d: audit.table_fingerprints(view(s, d, "feature"), ("ord", "source_id", "source_type", "lang", "geometry_text"), "lang"),
    "f18_conduits": lambda s, d: _conduits(s, d).drop("z_in", "z_low"),
    "a41_network_summary": lambda s, d: audit.network_summary(_conduits(s, d)),
    "t1_outfalls": lambda s, d: audit.outfalls(_conduits(s, d)),
    "j20_known_ends": lambda s, d: audit.with_known_ends(_conduits(s, d), _conduits(s, d).where("conduit_id % 3 = 0").selectExpr("explode(array(from_node, to_node)) AS node")).select("conduit_id"),
}

CONDUIT_SQL = """
k0 AS (SELECT *, greatest(CAST(10 AS DOUBLE), length_raw_m) AS length_m, CASE WHEN waterway IN ('canal', 'river') THEN CAST(4 AS DOUBLE) WHEN waterway IN ('stream', 'ditch') THEN CAST(2 AS DOUBLE) ELSE CAST(1.2 AS DOUBLE) END AS diameter_m,
              CASE WHEN waterway IN ('canal', 'river') THEN CAST(0.025 AS DOUBLE) WHEN waterway IN ('stream', 'ditch') THEN CAST(0.020 AS DOUBLE) ELSE CAST(0.015 AS DOUBLE) END AS roughness FROM conduit),
k1 AS (SELECT *, CASE WHEN z_out >= z_in THEN greatest(z_in - CAST(0.2 AS DOUBLE), CAST(0.5 AS DOUBLE)) ELSE z_out END AS z_low FROM k0),
k2 AS (SELECT *, greatest(CAST(0.0005 AS DOUBLE), (z_in - z_low) / length_m) AS sl FROM k1),
conduits AS (SELECT conduit_id, waterway, from_node, to_node, length_m, diameter_m, round(sl + 1e-9, 5) AS slope,
  round(pi() * diameter_m * diameter_m / 4 * pow(diameter_m / 4, CAST(2 AS DOUBLE) / 3) * sqrt(sl) / roughness + 1e-9, 3) AS capacity_m3s, z_in, z_low FROM k2)"""
_F, _K = with_views("feature"), with_views("conduit") + f",{CONDUIT_SQL}"
#: The greedy scan in SQL: one recursion step a feature would be slow, so rounds are unrolled as in the operator.
ROUNDS = 8


def _scan() -> str:
    out = ["o0 AS (SELECT ord, source_id, sha256(geometry_text) AS g FROM feature WHERE geometry_text IS NOT NULL AND trim(geometry_text) <> '')"]
    for k in range(ROUNDS):
        out.append(f"""m{k} AS (SELECT *, ord = min(ord) OVER (PARTITION BY source_id) AND ord = min(ord) OVER (PARTITION BY g) AS keeps FROM o{k}),
d{k} AS (SELECT *, CASE WHEN keeps THEN 'KEPT' WHEN min(CASE WHEN keeps THEN ord END) OVER (PARTITION BY source_id) < ord THEN 'DUPLICATE_ID' WHEN min(CASE WHEN keeps THEN ord END) OVER (PARTITION BY g) < ord THEN 'DUPLICATE_GEOMETRY' END AS decision FROM m{k}),
o{k + 1} AS (SELECT ord, source_id, g FROM d{k} WHERE decision IS NULL)""")
    out.append("raw AS (" + " UNION ALL ".join(f"SELECT ord, decision FROM d{k} WHERE decision IS NOT NULL" for k in range(ROUNDS)) + ")")
    out.append("ids AS (SELECT source_id, min(ord) AS first FROM raw JOIN o0 USING (ord) WHERE decision = 'KEPT' AND source_id IS NOT NULL GROUP BY source_id)")
    out.append("decisions AS (SELECT ord, CASE WHEN decision = 'KEPT' THEN 'KEPT' WHEN first < ord THEN 'DUPLICATE_ID' ELSE 'DUPLICATE_GEOMETRY' END AS decision FROM raw JOIN o0 USING (ord) LEFT JOIN ids USING (source_id))")
    return ",\n".join(out)


MAPPED_SQL = f"""
rules AS ({RULES}),
j AS (SELECT f.*, decision, feature_type AS ft, diameter_m AS dm, CASE WHEN geometry_text IS NULL THEN 'REJECTED_MISSING_GEOMETRY' WHEN trim(geometry_text) = '' THEN 'REJECTED_INVALID_GEOMETRY' WHEN decision <> 'KEPT' THEN 'REJECTED_DUPLICATE'
             WHEN feature_type IS NULL THEN 'UNRESOLVED_TYPE' ELSE 'MAPPED' END AS status
      FROM feature f LEFT JOIN decisions USING (ord) LEFT JOIN rules ON raw_type = lower(trim(coalesce(source_type, '')))),
mapped AS (SELECT ord, source_id, status, CASE WHEN status IN ('MAPPED', 'UNRESOLVED_TYPE') THEN coalesce(ft, 'UNKNOWN') END AS feature_type, CASE WHEN status IN ('MAPPED', 'UNRESOLVED_TYPE') THEN dm END AS diameter_m,
  CASE WHEN status NOT IN ('MAPPED', 'UNRESOLVED_TYPE') THEN NULL WHEN dm IS NULL THEN 'MISSING' ELSE 'DERIVED' END AS availability,
  CASE WHEN status IN ('MAPPED', 'UNRESOLVED_TYPE') THEN 'drain-' || substr(sha256('drains:' || CASE WHEN coalesce(source_id, '') <> '' THEN source_id ELSE 'geom:' || substr(sha256(geometry_text), 1, 32) END), 1, 16) END AS feature_id FROM j)"""
ORACLES = {
    "a38_schema_audit": _F + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(c in REQUIRED).lower()} AS required, round(count(*) FILTER ({c} IS NULL) / CAST(greatest(count(*), 1) AS DOUBLE) + 1e-9, 6) AS null_share, CASE WHEN count({c}) = 0 THEN 'REJECTED' WHEN {str(c in REQUIRED).lower()} AND count({c}) < count(*) THEN 'UNRESOLVED' ELSE 'ACCEPTED' END AS status FROM feature"
        for c in ("ord", "source_id", "source_type", "lang", "geometry_text", "n_chars")
    ) + " UNION ALL SELECT 'diameter_mm', true, NULL, 'MISSING'",
    "a39_dataset_audit": _F + """,
a AS (SELECT count(*) AS records, count(*) FILTER (geometry_text IS NULL) AS missing_geometry, count(source_id) - count(DISTINCT source_id) AS duplicate_ids,
             count(geometry_text) - count(DISTINCT geometry_text) AS duplicate_geometries, count(DISTINCT source_type) AS types FROM feature)
SELECT *, CASE WHEN records < 1 THEN 'BLOCKED' WHEN missing_geometry + duplicate_ids + duplicate_geometries > 0 THEN 'AUDIT_PARTIAL' ELSE 'VALIDATED' END AS status FROM a""",
    "w12_first_wins": _F + f",{_scan()} SELECT * FROM decisions",
    "f22_mapped_features": _F + f",{_scan()},{MAPPED_SQL} SELECT * FROM mapped",
    "a40_mapping_statistics": _F + f",{_scan()},{MAPPED_SQL} SELECT status, count(*) AS n, count(DISTINCT feature_id) AS ids FROM mapped GROUP BY status",
    "x4_completeness": _F + f",{_scan()},{MAPPED_SQL} SELECT (SELECT count(*) FROM feature) AS sources, count(*) FILTER (status NOT LIKE 'REJECTED%') AS entities, count(*) FILTER (status LIKE 'REJECTED%') AS rejections, (SELECT count(*) FROM feature) = count(*) AS complete FROM mapped",
    "f26_table_fingerprints": _F + """ SELECT lang, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(sha256(concat_ws('|', coalesce(CAST(ord AS VARCHAR), '<null>'), coalesce(source_id, '<null>'), coalesce(source_type, '<null>'), coalesce(lang, '<null>'), coalesce(geometry_text, '<null>'))), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM feature GROUP BY lang""",
    "f18_conduits": _K + " SELECT * EXCLUDE (z_in, z_low) FROM conduits",
    "a41_network_summary": _K + " SELECT (SELECT count(DISTINCT n) FROM (SELECT from_node AS n FROM conduits UNION ALL SELECT to_node FROM conduits)) AS junctions, count(*) AS conduits, round(sum(length_m) + 1e-9, 3) AS total_length_m, round(sum(capacity_m3s) + 1e-7, 3) AS total_capacity_m3s FROM conduits",
    "t1_outfalls": _K + ", e AS (SELECT from_node AS node, z_in AS z FROM conduits UNION ALL SELECT to_node, z_low FROM conduits) SELECT node, round(min(z) + 1e-9, 6) AS z FROM e GROUP BY node ORDER BY min(z), node LIMIT 10",
    "j20_known_ends": _K + """,
n AS (SELECT from_node AS node FROM conduits WHERE conduit_id % 3 = 0 UNION SELECT to_node FROM conduits WHERE conduit_id % 3 = 0)
SELECT conduit_id FROM conduits WHERE from_node IN (SELECT node FROM n) AND to_node IN (SELECT node FROM n)""",
}
