"""Domain tables derived from the driver's tables; the same SQL runs in Spark and in DuckDB.

Only this module knows the driver's tables. In the SQL, a name in braces is one of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rillspark.sources.tables import table

#: Cells along each side of the grid.
SIDE = 67

#: A road segment between two cells for each order.
NETWORK = f"""
SELECT o_orderkey AS road_id, CAST(o_orderkey % {SIDE} AS INT) AS r1, CAST(o_custkey % {SIDE} AS INT) AS c1,
       CAST((o_orderkey * 7 + 3) % {SIDE} AS INT) AS r2, CAST((o_custkey * 5 + 1) % {SIDE} AS INT) AS c2,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'primary' WHEN o_orderpriority LIKE '2%' THEN 'secondary' ELSE 'local' END AS road_class,
       CAST(30 AS DOUBLE) * SQRT(CAST((((o_orderkey * 7 + 3) % {SIDE}) - (o_orderkey % {SIDE})) * (((o_orderkey * 7 + 3) % {SIDE}) - (o_orderkey % {SIDE}))
         + (((o_custkey * 5 + 1) % {SIDE}) - (o_custkey % {SIDE})) * (((o_custkey * 5 + 1) % {SIDE}) - (o_custkey % {SIDE})) AS DOUBLE)) AS length_m
FROM {{orders}}"""

VIEWS = {
    # depth of water by scenario, lead and cell
    "depth": f"""
SELECT l_returnflag AS scenario_id, CAST((l_linenumber - 1) * 15 AS INT) AS lead_minutes,
       CAST(l_orderkey % {SIDE} AS INT) AS r, CAST(l_partkey % {SIDE} AS INT) AS c,
       CAST(MAX(l_quantity) AS DOUBLE) / CAST(80 AS DOUBLE) AS depth_m
FROM {{lineitem}} GROUP BY l_returnflag, l_linenumber, l_orderkey % {SIDE}, l_partkey % {SIDE}""",
    # road segments between two cells
    "segment": NETWORK,
    # gauge and radar observations
    "gauge": """
SELECT event_id AS obs_id, user_id AS sensor_id, ts AS observation_time,
       CASE event_type WHEN 'click' THEN 'RAIN_RATE_MMH' WHEN 'view' THEN 'REFLECTIVITY_DBZ' WHEN 'purchase' THEN 'ACCUMULATION_MM'
            WHEN 'signup' THEN 'SATELLITE_QPE' ELSE 'UNKNOWN' END AS product_type,
       value AS raw_value, props AS metadata_json
FROM {events}""",
    # critical assets
    "asset": f"""
SELECT s_suppkey AS asset_id, s_name AS name, CAST(1 + s_suppkey % 5 AS INT) AS criticality_weight,
       CAST(10 + s_suppkey % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS critical_depth_m,
       CAST(30 + s_suppkey % 30 AS DOUBLE) / CAST(100 AS DOUBLE) AS failure_depth_m,
       CAST(1000 * (1 + s_nationkey) AS BIGINT) AS service_population,
       CAST(s_suppkey * 3 % {SIDE} AS INT) AS r, CAST(s_suppkey * 11 % {SIDE} AS INT) AS c
FROM {{supplier}}""",
    # conduits between junctions
    "conduit": """
SELECT p_partkey AS conduit_id, CASE p_size % 5 WHEN 0 THEN 'canal' WHEN 1 THEN 'stream' WHEN 2 THEN 'river' WHEN 3 THEN 'ditch' ELSE 'drain' END AS waterway,
       CAST(p_partkey % 97 AS INT) AS from_node, CAST((p_partkey * 5 + 1) % 97 AS INT) AS to_node,
       CAST(10 + p_size AS DOUBLE) AS length_raw_m, CAST(p_retailprice AS DOUBLE) / CAST(100 AS DOUBLE) AS z_in,
       CAST(p_size AS DOUBLE) / CAST(10 AS DOUBLE) AS z_out
FROM {part}""",
    # roads between junctions for routing: two for each customer, to junctions of smaller numbers
    "graph_edge": """
SELECT c_custkey AS n1, CAST(floor(c_custkey / 3) AS BIGINT) AS n2, CAST(100 + c_custkey % 900 AS DOUBLE) AS length_m FROM {customer}
UNION ALL SELECT c_custkey AS n1, CAST(floor(c_custkey / 2) + 1 AS BIGINT) AS n2, CAST(150 + c_custkey * 7 % 900 AS DOUBLE) AS length_m FROM {customer} WHERE c_custkey > 2""",
    # where searches start: the first customer of each nation
    "depot": "SELECT MIN(c_custkey) AS node FROM {customer} GROUP BY c_nationkey",
    # water balance of runs: a run for each supplier and scenario, volumes in m3
    "ledger": """
SELECT l_suppkey AS run_id, l_returnflag AS scenario_id, SUM(CAST(l_quantity AS DOUBLE)) * CAST(10 AS DOUBLE) AS rain_m3, CAST(SUM(l_linenumber) AS DOUBLE) AS ext_in_m3,
       SUM(CAST(l_quantity AS DOUBLE)) * CAST(2 AS DOUBLE) AS losses_m3, CAST(COUNT(*) AS DOUBLE) AS surf_out_m3, SUM(CAST(l_quantity AS DOUBLE)) * CAST(3 AS DOUBLE) AS s2d_m3,
       CAST(SUM(CASE WHEN l_partkey % 7 = 0 THEN l_linenumber ELSE 0 END) AS DOUBLE) AS d2s_m3, CAST(SUM(CASE WHEN l_partkey % 7 = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS flood_export_m3,
       SUM(CAST(l_quantity AS DOUBLE)) * CAST(2.5 AS DOUBLE) AS outfall_m3, CAST(MIN(l_linenumber) AS DOUBLE) AS s_s0, CAST(MIN(l_linenumber) AS DOUBLE) + SUM(CAST(l_quantity AS DOUBLE)) * CAST(5 AS DOUBLE) AS s_s1,
       CAST(MAX(l_linenumber) AS DOUBLE) AS s_d0, CAST(MAX(l_linenumber) AS DOUBLE) + SUM(CAST(l_quantity AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS s_d1,
       MAX(CAST(l_quantity AS DOUBLE)) / CAST(40 AS DOUBLE) AS peak_depth_m, CAST(COUNT(*) * 900 AS DOUBLE) AS max_flooded_area_m2, CAST(MAX(l_linenumber) AS DOUBLE) / CAST(10 AS DOUBLE) AS max_surcharge_m
FROM {lineitem} GROUP BY l_suppkey, l_returnflag""",
    # ground elevation of cells, with land and water
    "dem": f"""
SELECT CAST(o_orderkey % {SIDE} AS INT) AS r, CAST(o_custkey % {SIDE} AS INT) AS c, MAX(CAST(o_totalprice AS DOUBLE)) / CAST(10000 AS DOUBLE) AS z,
       CAST(CASE WHEN (o_orderkey % {SIDE} * 7 + o_custkey % {SIDE}) % 11 = 0 THEN 0 ELSE 1 END AS INT) AS land
FROM {{orders}} GROUP BY o_orderkey % {SIDE}, o_custkey % {SIDE}""",
    # frames of forecasts: one for each supplier, with faults in some
    "forecast_frame": """
SELECT DISTINCT l_suppkey AS forecast_id, CAST((l_linenumber - 1) * 15 AS INT) AS lead_minutes, CASE WHEN l_suppkey % 7 = 0 AND l_linenumber = 2 THEN 'mm' ELSE 'mm/h' END AS units,
       CAST(CASE WHEN l_suppkey % 5 = 0 THEN 60 + l_linenumber ELSE 67 END AS INT) AS width, 67 AS height, CASE WHEN l_suppkey % 11 = 0 AND l_linenumber = 1 THEN 'EPSG:4326' ELSE 'EPSG:32645' END AS reference,
       CAST(CASE WHEN l_suppkey % 13 = 0 THEN 30 + l_linenumber ELSE 30 END AS DOUBLE) AS resolution_m
FROM {lineitem} WHERE l_linenumber <= 5 OR l_suppkey % 3 = 0""",
    # source features for audit, mapping and de-duplication
    "feature": """
SELECT doc_id AS ord, CAST(doc_id % 900 AS STRING) AS source_id, source AS source_type, lang,
       CASE WHEN n_chars % 17 = 0 THEN NULL ELSE text END AS geometry_text, n_chars
FROM {documents}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table of a data folder."""
    tables = {t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
    return spark.sql(VIEWS[name], **tables)


def rain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rain frames (frame 0 and 1): r, c, rate_mmh."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (c, x)").selectExpr(
        "CAST(vec_id % 2 AS INT) AS frame", "CAST(vec_id div 2 AS INT) AS r", "CAST(c AS INT) AS c", "CAST(greatest(0.0D, CAST(x AS DOUBLE)) * 60.0D AS DOUBLE) AS rate_mmh"
    )


RAIN_SQL = """
SELECT CAST(vec_id % 2 AS INT) AS frame, CAST(vec_id // 2 AS INT) AS r, CAST(i - 1 AS INT) AS c, greatest(0.0, CAST(embedding[i] AS DOUBLE)) * 60.0 AS rate_mmh
FROM embeddings, unnest(range(1, 65)) AS t(i)"""


def with_views(*names: str) -> str:
    """The WITH clause of these domain tables for DuckDB."""
    plain = {**{k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in VIEWS.items()}, "rain": RAIN_SQL}
    return "WITH " + ",\n".join(f"{n} AS ({plain[n]})" for n in names)
