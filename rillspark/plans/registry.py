"""The registry of queries: each module of `MODULES` offers QUERIES and ORACLES."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = (
    "rillspark.plans.q_roads",
    "rillspark.plans.q_nowcast",
    "rillspark.plans.q_scores",
    "rillspark.plans.q_assets",
    "rillspark.plans.q_graph",
    "rillspark.plans.q_audit",
    "rillspark.plans.q_rain",
    "rillspark.plans.q_frames",
    "rillspark.plans.q_calibration",
    "rillspark.plans.q_summaries",
    "rillspark.plans.q_feeds",
    "rillspark.plans.q_contracts",
    "rillspark.plans.q_fields",
    "rillspark.plans.q_grids",
    "rillspark.plans.q_geometry",
    "rillspark.plans.q_results",
    "rillspark.plans.q_reports",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> function of (spark, sf_dir)."""
    return {name: run for module in MODULES for name, run in importlib.import_module(module).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL for DuckDB with the same rows, where SQL can express the query."""
    return {name: sql for module in MODULES for name, sql in importlib.import_module(module).ORACLES.items()}
