"""Projection bundles: rain frames, flood and roads of each lead under one key, made again only where what they are made from has changed.

The key of a lead combines fingerprints: of the configuration, of the tables' columns, of the road network's content and of the content of the lead's
own frame. A refresh compares keys with the committed ones and builds the leads that differ, in one job; it reads the frames of the others for their fingerprints only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.functions.shared import settled
from rillspark.operators import frames as frame_ops
from rillspark.operators import roads
from rillspark.operators.audit import table_fingerprints
from rillspark.sources.results import ResultStore


def config_fingerprint(config: dict) -> str:
    """The same for equal settings, whatever their order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def schema_fingerprint(rows: DataFrame) -> str:
    """Of names, types and nullability of the columns, whatever their order."""
    return config_fingerprint({"columns": sorted([f.name, f.dataType.simpleString(), f.nullable] for f in rows.schema)})


def step_fingerprint(before: str, step: str, settings: dict) -> str:
    """Of a step of a chain: what stood before it, its name and its settings."""
    return config_fingerprint({"before": before, "step": step, "settings": settings})


def bundle_keys(frames: DataFrame, network: DataFrame, config: dict, by: tuple[str, ...] = ("scenario_id", "lead_minutes")) -> DataFrame:
    """bundle (the group's columns joined by /), n, frame_fingerprint and projection_key of each group of frames."""
    roads_now = table_fingerprints(network.withColumn("whole", F.lit(1)), tuple(sorted(network.columns)), "whole").select(F.col("fingerprint").alias("network_fingerprint"))
    content = table_fingerprints(frames, tuple(sorted(frames.columns)), *by).crossJoin(F.broadcast(roads_now))  # the right side is one row
    fixed = step_fingerprint(config_fingerprint(config), "columns", {"frames": schema_fingerprint(frames), "network": schema_fingerprint(network)})
    key = F.sha2(F.concat_ws("|", F.lit(fixed), "network_fingerprint", F.col("n").cast("string"), "fingerprint"), 256)
    return content.select(F.concat_ws("/", *(F.col(c).cast("string") for c in by)).alias("bundle"), *by, "n", F.col("fingerprint").alias("frame_fingerprint"), key.alias("projection_key"))


def flood_and_roads(frames: DataFrame, network: DataFrame) -> DataFrame:
    """Per frame: the flood's statistics and the roads' metrics, side by side; a frame that meets no road has none."""
    keys = list(frame_ops.FRAME)
    flood = frame_ops.snapshots(frames)
    impact = roads.road_metrics(roads.road_impact(network, frames), network)
    return flood.join(impact.hint("merge"), keys, "left").withColumn("bundle", F.concat_ws("/", *(F.col(c).cast("string") for c in keys)))


def refreshed(store: ResultStore, frames: DataFrame, network: DataFrame, config: dict, build: Callable[[DataFrame, DataFrame], DataFrame] = flood_and_roads) -> tuple[DataFrame, list[str]]:
    """The bundles of all frames, and which of them were built now. Bundles are few (scenarios x leads); their keys are compared in the driver.

    A bundle whose frame is gone is kept in the store and left out of the result; without any frames there is nothing to load, which is an error.
    """
    by = frame_ops.FRAME
    now = {r["bundle"]: r["projection_key"] for r in bundle_keys(frames, network, config, by).select("bundle", "projection_key").collect()}
    held = store.entries()
    stale = sorted(k for k, key in now.items() if k not in held or held[k].fingerprint != key)
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in by))
    if stale:
        store.write(build(settled(frames.where(name.isin(stale)), "stale"), network), "bundle", {k: now[k] for k in stale})
    return store.load(tuple(now), only=True), stale
