"""Request streams from files: Parquet tables or JSON bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BODY = "request_id string, ts timestamp, path string, body string"


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the Parquet files of a table folder, with the table's own schema."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines with an id, a time, an endpoint path and a body."""
    return spark.readStream.schema(BODY).json(path)
