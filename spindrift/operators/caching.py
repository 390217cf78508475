"""Result caching and model residency as window functions and session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliding_ttl_hits(requests: DataFrame, keys: list[str], ts: str, order: list[str], ttl: float) -> DataFrame:
    """``hit``: the key was asked for less than ``ttl`` seconds before (an access renews the entry)."""
    before = F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(*keys).orderBy(ts, *order))
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - before) / 1e6
    return requests.withColumn("hit", F.coalesce(gap < ttl, F.lit(False)))


def hit_rates(judged: DataFrame, keys: list[str]) -> DataFrame:
    """hits, misses and the rate in percent; 0 without requests."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return judged.groupBy(*keys).agg(hits.alias("hits"), misses.alias("misses"), F.when(F.count(F.lit(1)) > 0, hits / F.count(F.lit(1)) * 100).otherwise(0.0).alias("hit_rate"))


def coalesced(requests: DataFrame, key: Column) -> DataFrame:
    """Requests that share a key share one computation: per key, the requests and the calls saved."""
    return requests.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("requests")).withColumn("saved", F.col("requests") - 1)


def residency(requests: DataFrame, model: str, ts: str, keep_alive: str = "5 minutes") -> DataFrame:
    """Intervals in which a model stays loaded: sessions of accesses less than ``keep_alive`` apart, to the last access plus it."""
    w = F.session_window(F.col(ts).cast("timestamp"), keep_alive)
    return requests.groupBy(model, w).agg(F.count(F.lit(1)).alias("accesses")).select(model, F.col("session_window.start").alias("loaded"), F.col("session_window.end").alias("unloaded"), "accesses")


def residency_stats(requests: DataFrame, model: str, ts: str, models: DataFrame, pinned: list[str], keep_alive: str = "5 minutes") -> DataFrame:
    """One row: discovered, pinned, hits, misses. A pinned model always hits; another's first access of a session misses."""
    loaded = residency(requests, model, ts, keep_alive)
    free = ~F.col(model).isin(pinned) if pinned else F.lit(True)
    asked = loaded.agg(F.sum(F.when(free, F.col("accesses") - 1).otherwise(F.col("accesses"))).alias("hits"), F.count_if(free).alias("misses"))
    known = models.agg(F.count_distinct("name").alias("discovered"), F.count_if(F.col("name").isin(pinned)).alias("pinned"))
    return known.crossJoin(asked)  # one row each
