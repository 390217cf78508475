"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import control as C
from spindrift.streaming import control as S
from spindrift.streaming.sources import table_stream


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def ordered_events(spark, data_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    e = spark.read.parquet(f"{data_dir}/events.parquet")
    C.with_seconds(e).select("event_id", (F.col("user_id") % 10).alias("user"), F.col("ts").cast("timestamp").alias("ts"), "t", (F.col("event_type") == "error").alias("failed")).repartition(1).write.parquet(path)
    return path


def test_token_bucket_stream_equals_batch(spark, ordered_events, tmp_path):
    batch = C.token_bucket(spark.read.parquet(ordered_events), "user", rate=1e-4, burst=2, order=["t", "event_id"]).select("event_id", "allowed")
    stream = drain(S.token_bucket_stream(table_stream(spark, ordered_events), "user", rate=1e-4, burst=2, order=["t", "event_id"]), "bucket", tmp_path).select("event_id", "allowed")
    assert sorted(batch.collect()) == sorted(stream.collect()) and stream.where("not allowed").count() > 0


def test_breaker_stream_equals_batch(spark, ordered_events, tmp_path):
    batch = C.circuit_breaker(spark.read.parquet(ordered_events), "user", threshold=2, timeout=1e5, order=["t", "event_id"]).select("event_id", "state")
    stream = drain(S.circuit_breaker_stream(table_stream(spark, ordered_events), "user", threshold=2, timeout=1e5, order=["t", "event_id"]), "breaker", tmp_path).select("event_id", "state")
    assert sorted(batch.collect()) == sorted(stream.collect())


def test_windows_sessions_and_first_requests(spark, ordered_events, tmp_path):
    counts = drain(S.windowed_counts(table_stream(spark, ordered_events), ["user"], "ts", "1 day"), "counts", tmp_path)
    assert 0 < counts.agg(F.sum("n")).first()[0] <= 1000
    assert drain(S.model_sessions(table_stream(spark, ordered_events), "user", "ts", "1 hour"), "sessions", tmp_path).count() > 0
    assert 0 < drain(S.first_requests(table_stream(spark, ordered_events), ["user"], "ts", "1 hour"), "first", tmp_path).count() <= 1000
