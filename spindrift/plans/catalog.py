"""Every query on the reference tables, by name, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

TOPICS = ("chunk", "vector", "routing", "request", "metric", "plane")


def _modules():
    return [import_module(f"spindrift.plans.{t}_queries") for t in TOPICS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
