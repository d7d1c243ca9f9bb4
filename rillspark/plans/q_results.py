"""Queries on stored results, manifests, evidence and projection bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.functions.policy import PASSABILITY
from rillspark.functions.shared import shared_root
from rillspark.operators import bundles
from rillspark.plans.q_roads import CELLS_SQL, IMPACT_SQL, METRICS_SQL
from rillspark.plans.testbed import view, with_views
from rillspark.sources import manifest
from rillspark.sources.providers import Provider, Providers
from rillspark.sources.results import ResultStore
from rillspark.sources.tables import table

SCENARIOS = ("A", "N", "R")
CONFIG = {"policy": PASSABILITY, "interval_minutes": 15}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/rillspark-{name}-{uuid.uuid4().hex}"


def _stored(spark, sf) -> ResultStore:
    """Depths of all scenarios, one of them written twice: the second time is what counts."""
    store, depth = ResultStore(spark, _folder(spark, "store")), view(spark, sf, "depth")
    store.write(depth.withColumn("depth_m", F.when(F.col("scenario_id") == "N", F.col("depth_m") * 2).otherwise(F.col("depth_m"))), "scenario_id")
    store.write(depth.where("scenario_id = 'N'"), "scenario_id")
    return store


def _summaries(spark, sf):
    from rillspark.sources.results import summaries

    return summaries(_stored(spark, sf)).select("key", "rows")


def _files(spark, sf) -> str:
    """A text file for each nation's customers, in order."""
    folder = _folder(spark, "files")
    lines = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat_ws(",", F.array_sort(F.collect_list("c_custkey"))).alias("line"))
    lines.write.partitionBy("c_nationkey").text(folder)
    return folder


def _manifest(spark, sf) -> DataFrame:
    """One file a folder of a nation; the file's own name is left out, as Spark makes it up."""
    return manifest.manifest(spark, _files(spark, sf), "part-*", whole_bytes=2000).withColumn("path", F.element_at(F.split("path", "/"), 1))


def _evidence(spark, sf):
    """Against what was expected: nation 3 with other customers, nation 5 of another size, one that is not there, and 7 not listed."""
    found = _manifest(spark, sf)
    expected = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat_ws(",", F.array_sort(F.collect_list("c_custkey"))).alias("line")).where("c_nationkey <> 7")
    text = F.concat("line", F.lit("\n"))
    size = F.octet_length(text).cast("long") + F.when(F.col("c_nationkey") == 5, 1).otherwise(0)
    digest = F.sha2(F.when(F.col("c_nationkey") == 3, F.concat(text, F.lit("!"))).otherwise(text), 256)
    rows = expected.select(F.concat(F.lit("c_nationkey="), "c_nationkey").alias("path"), size.alias("bytes"), digest.alias("sha256"))
    more = spark.sql("SELECT 'c_nationkey=99' AS path, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS STRING) AS sha256")
    return manifest.evidence(found, rows.unionByName(more))


def _bundles(spark, sf):
    """All bundles, then one frame changes: one bundle is made again."""
    depth, network = view(spark, sf, "depth"), view(spark, sf, "segment")
    store = ResultStore(spark, _folder(spark, "bundles"))
    bundles.refreshed(store, depth, network, CONFIG)
    changed = depth.withColumn("depth_m", F.when((F.col("scenario_id") == "N") & (F.col("lead_minutes") == 30), F.col("depth_m") + 0.05).otherwise(F.col("depth_m")))
    found, again = bundles.refreshed(store, changed, network, CONFIG)
    return found.withColumn("redone", F.col("bundle").isin(again))


def _providers(spark, sf) -> Providers:
    """Gauges and radar of the table of observations as providers, and one that has nothing."""
    def of(*kinds: str):
        return lambda s: view(s, sf, "gauge").where(F.col("product_type").isin(*kinds)).select("obs_id", F.col("observation_time").cast("timestamp").alias("observation_time"), "product_type", F.col("raw_value").cast("double").alias("raw_value"))

    return Providers(
        Provider("gauges", "REAL", "Rain gauges", of("RAIN_RATE_MMH", "ACCUMULATION_MM"), 5), Provider("radar", "REAL", "Radar", of("REFLECTIVITY_DBZ"), 60), Provider("none", "FIXTURE", "Nothing", of("NO_SUCH_PRODUCT"))
    )


def _latest(spark, sf):
    return _providers(spark, sf).latest(spark).select("provider_id", "source_type", "obs_id", F.col("observation_time").cast("timestamp_ntz").alias("observation_time"))


def _at_time(spark, sf):
    """What each provider has at a minute after each satellite observation."""
    times = view(spark, sf, "gauge").where("product_type = 'SATELLITE_QPE'").select((F.col("observation_time").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("t")).distinct()
    found = _providers(spark, sf).at_time(spark, times, "gauges", "radar")
    return found.select("provider_id", F.col("t").cast("timestamp_ntz").alias("t"), "obs_id", "gap_seconds", "fallback")


def _provider_health(spark, sf):
    now = view(spark, sf, "gauge").agg(F.max(F.col("observation_time").cast("timestamp"))).first()[0]
    return _providers(spark, sf).health(spark, F.lit(now) + F.expr("INTERVAL 30 MINUTES")).select("provider_id", "source_name", "observations", "last_observation", "status")


QUERIES = {
    "u2_latest": _latest,
    "u2_at_time": _at_time,
    "u2_health": _provider_health,
    "s16_stored_results": lambda s, d: _stored(s, d).load(SCENARIOS),
    "s17_run_summaries": _summaries,
    "s15_manifest": _manifest,
    "s19_evidence": _evidence,
    "n6_projection_bundles": _bundles,
}

_LINES = "WITH lines AS (SELECT c_nationkey AS k, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) || chr(10) AS text FROM customer GROUP BY c_nationkey), found AS (SELECT 'c_nationkey=' || k AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, k, text FROM lines)"
_DEPTH = with_views("depth")
_OBS = with_views("gauge") + """,
o AS (SELECT CASE WHEN product_type = 'REFLECTIVITY_DBZ' THEN 'radar' ELSE 'gauges' END AS provider_id, obs_id, observation_time FROM gauge WHERE product_type IN ('REFLECTIVITY_DBZ', 'RAIN_RATE_MMH', 'ACCUMULATION_MM') AND observation_time IS NOT NULL)"""
ORACLES = {
    "u2_latest": _OBS + " SELECT provider_id, 'REAL' AS source_type, obs_id, observation_time FROM o QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY observation_time DESC, obs_id DESC) = 1",
    "u2_at_time": _OBS + """,
t AS (SELECT DISTINCT observation_time + INTERVAL 1 MINUTE AS t FROM gauge WHERE product_type = 'SATELLITE_QPE'),
last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY observation_time DESC, obs_id DESC) = 1),
near AS (
  SELECT p.provider_id, t.t, o.obs_id, abs(epoch_us(t.t) - epoch_us(o.observation_time)) / 1e6 AS gap, o.observation_time AS at
  FROM t CROSS JOIN (VALUES ('gauges', 300), ('radar', 3600)) AS p(provider_id, s) JOIN o ON o.provider_id = p.provider_id AND o.observation_time BETWEEN t.t - to_seconds(p.s) AND t.t + to_seconds(p.s)
  QUALIFY row_number() OVER (PARTITION BY p.provider_id, t.t ORDER BY abs(epoch_us(t.t) - epoch_us(o.observation_time)), o.observation_time, o.obs_id) = 1
)
SELECT l.provider_id, t.t, coalesce(n.obs_id, l.obs_id) AS obs_id, coalesce(n.gap, abs(epoch_us(t.t) - epoch_us(l.observation_time)) / 1e6) AS gap_seconds, n.obs_id IS NULL AS fallback
FROM t CROSS JOIN last l LEFT JOIN near n ON n.provider_id = l.provider_id AND n.t = t.t""",
    "u2_health": _OBS + """
SELECT provider_id, CASE provider_id WHEN 'radar' THEN 'Radar' ELSE 'Rain gauges' END AS source_name, count(*) AS observations, max(observation_time) AS last_observation,
       CASE WHEN (SELECT max(observation_time) FROM gauge) + INTERVAL 30 MINUTE - max(observation_time) <= INTERVAL 45 MINUTE THEN 'HEALTHY' WHEN (SELECT max(observation_time) FROM gauge) + INTERVAL 30 MINUTE - max(observation_time) <= INTERVAL 90 MINUTE THEN 'DEGRADED' ELSE 'UNAVAILABLE' END AS status
FROM o GROUP BY provider_id UNION ALL SELECT 'none', 'Nothing', 0, NULL, 'UNCONFIGURED'""",
    "s16_stored_results": _DEPTH + " SELECT * FROM depth",
    "s17_run_summaries": _DEPTH + " SELECT scenario_id AS key, count(*) AS rows FROM depth GROUP BY scenario_id",
    "s15_manifest": _LINES + " SELECT path, bytes, sha256 FROM found",
    "s19_evidence": _LINES + """
SELECT path, CASE k WHEN 3 THEN 'CHANGED' WHEN 5 THEN 'CHANGED' WHEN 7 THEN 'EXTRA' ELSE 'PRESENT' END AS outcome, bytes, sha256, CASE k WHEN 3 THEN 'other digest' WHEN 5 THEN 'other size' WHEN 7 THEN 'not expected' END AS reason FROM found
UNION ALL SELECT 'c_nationkey=99', 'MISSING', NULL, NULL, 'not found'""",
    "n6_projection_bundles": with_views("depth", "segment").replace("depth AS (", "depth0 AS (", 1) + f""",
depth AS (SELECT * REPLACE (CASE WHEN scenario_id = 'N' AND lead_minutes = 30 THEN depth_m + CAST('0.05' AS DOUBLE) ELSE depth_m END AS depth_m) FROM depth0),{CELLS_SQL},{IMPACT_SQL},{METRICS_SQL},
flood AS (SELECT scenario_id, lead_minutes, count(*) AS cells, max(depth_m) AS max_depth_m, count(*) FILTER (depth_m > 0.05) AS flooded_cells, CAST(count(*) FILTER (depth_m > 0.05) * 900 AS DOUBLE) AS flooded_area_m2,
          round(avg(depth_m) + 1e-9, 6) AS mean_depth_m, round(sum(depth_m) * 900 + 1e-6, 3) AS storage_m3 FROM depth GROUP BY scenario_id, lead_minutes)
SELECT f.*, m.* EXCLUDE (scenario_id, lead_minutes), f.scenario_id || '/' || f.lead_minutes AS bundle, f.scenario_id = 'N' AND f.lead_minutes = 30 AS redone FROM flood f LEFT JOIN metrics m USING (scenario_id, lead_minutes)""",
}
