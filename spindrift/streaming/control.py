"""Stateful streams with the step functions of the batch operators.

Rows of one key are handled in event order inside a micro-batch; a row that
arrives in a later batch than its successors is handled where it arrives (there
is no reordering across batches). State is one small JSON text per key and is
dropped ``idle`` milliseconds after a key's last batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators.control import Step, breaker_step, bucket_step


def ordered_stream(df: DataFrame, key: str, order: list[str], make: Callable[[dict], Step], fresh: dict, added: str, idle_ms: int = 3_600_000) -> DataFrame:
    """``df`` with the step's columns; ``make`` binds a step to a state dictionary, which it changes in place."""
    names = [f.split()[0] for f in added.split(", ")]
    columns = df.columns
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns) + ", " + added

    def handle(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(fresh))
        step = make(held)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")[columns]
        results = [step(r) for r in rows.to_dict("records")]
        state.update((json.dumps(held),))
        state.setTimeoutDuration(idle_ms)
        yield rows.assign(**{n: [x[k] for x in results] for k, n in enumerate(names)})

    return df.groupBy(key).applyInPandasWithState(handle, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def token_bucket_stream(requests: DataFrame, key: str, *, rate: float, burst: int, order: list[str]) -> DataFrame:
    return ordered_stream(requests, key, order, lambda held: bucket_step(rate, burst, held), {}, "allowed boolean, tokens double")


def circuit_breaker_stream(outcomes: DataFrame, key: str, *, threshold: int = 5, timeout: float = 30.0, order: list[str]) -> DataFrame:
    return ordered_stream(outcomes, key, order, lambda held: breaker_step(threshold, timeout, held), {"state": "closed", "failures": 0, "last": 0.0}, "allowed boolean, state string")


def windowed_counts(log: DataFrame, keys: list[str], ts: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than ``late`` behind the watermark are dropped (event time is an extension here)."""
    stamped = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_requests(requests: DataFrame, keys: list[str], ts: str, ttl: str = "2 minutes") -> DataFrame:
    """One request per key and ``ttl`` of event time: the ones that a result cache has to compute (the entry is not renewed by hits)."""
    stamped = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl)
    return stamped.dropDuplicatesWithinWatermark(keys)


def model_sessions(requests: DataFrame, model: str, ts: str, keep_alive: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Residency intervals of models as session windows."""
    stamped = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.session_window(ts, keep_alive)
    return stamped.groupBy(model, w.alias("w")).agg(F.count(F.lit(1)).alias("accesses")).select(model, F.col("w.start").alias("loaded"), F.col("w.end").alias("unloaded"), "accesses")
