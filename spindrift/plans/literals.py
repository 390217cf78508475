"""Small control tables as DataFrames and as DuckDB VALUES, from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_sql, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """``(VALUES ...) AS t(columns)`` for DuckDB."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") AS t({columns})"
