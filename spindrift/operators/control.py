"""Order-dependent control: token bucket, circuit breaker, bounded queue, TTL and LRU caches.

Decisions depend on all earlier rows of a key, so a key is scanned in order. The
scan holds one small state per key and streams over sorted partitions; it never
gathers a key's rows. The same step functions serve the batch scan here and the
stateful streams in ``spindrift.streaming``. Time is event time in seconds.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict], tuple]


def ordered_scan(df: DataFrame, key: str, order: list[str], make: Callable[[], Step], schema: str) -> DataFrame:
    """Rows of ``df`` with the columns of ``schema`` that ``make()``'s step returns for each row, key by key in order."""
    rows = df.columns
    added = [f.split()[0] for f in schema.split(", ")]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if not begun or row[key] != last:
                    last, step, begun = row[key], make(), True
                out.append(step(row))
            table = pa.Table.from_batches([batch])
            for k, name in enumerate(added):
                table = table.append_column(name, pa.array([x[k] for x in out], _ARROW[schema.split(", ")[k].split()[1]]))
            yield from table.combine_chunks().to_batches()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(scan, f"{kinds}, {schema}")


_ARROW = {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}


def bucket_step(rate: float, burst: int, state: dict | None = None, model_col: str | None = None) -> Step:
    """allowed, tokens left. A bucket starts full at its first request; with ``model_col`` every model has its own."""
    held = {} if state is None else state

    def step(row: dict) -> tuple[bool, float]:
        name = str(row[model_col]) if model_col else ""
        tokens, last = held.get(name, (float(burst), row["t"]))
        tokens = min(float(burst), tokens + (row["t"] - last) * rate)
        allowed = tokens >= 1
        tokens -= 1.0 if allowed else 0.0
        held[name] = (tokens, row["t"])
        return allowed, tokens
    return step


def token_bucket(requests: DataFrame, key: str, *, rate: float, burst: int, order: list[str], model_col: str | None = None) -> DataFrame:
    return ordered_scan(requests, key, order, lambda: bucket_step(rate, burst, None, model_col), "allowed boolean, tokens double")


def breaker_step(threshold: int = 5, timeout: float = 30.0, state: dict | None = None) -> Step:
    """allowed, state after the request. ``row['failed']`` is its outcome if it is let through.

    Closed opens at ``threshold`` failures since the last success; open turns half-open when more than ``timeout`` has passed since the
    last failure; half-open lets everything through, closes on success and opens again on failure.
    """
    s = {"state": "closed", "failures": 0, "last": 0.0} if state is None else state

    def step(row: dict) -> tuple[bool, str]:
        if s["state"] == "open":
            if row["t"] - s["last"] <= timeout:
                return False, "open"
            s["state"] = "half-open"
        if row["failed"]:
            s["failures"] += 1
            s["last"] = row["t"]
            if s["state"] == "half-open" or s["failures"] >= threshold:
                s["state"] = "open"
        else:
            s["state"], s["failures"] = "closed", 0
        return True, s["state"]
    return step


def circuit_breaker(outcomes: DataFrame, key: str, *, threshold: int = 5, timeout: float = 30.0, order: list[str]) -> DataFrame:
    return ordered_scan(outcomes, key, order, lambda: breaker_step(threshold, timeout), "allowed boolean, state string")


def queue_step(max_concurrent: int, max_queue: int = 0, timeout: float = 0.0) -> Step:
    """status, wait: 200 with its wait, 503 when the queue is full, 504 when the wait passes the timeout.

    Waiting requests start in order of arrival. No slots (0) means unlimited; a queue of 0 is unbounded; a timeout of 0 never ends.
    """
    free = [0.0] * max_concurrent  # when each slot is next free, with all waiting requests placed
    waiting: list[float] = []  # when those that wait leave the queue

    def step(row: dict) -> tuple[int, float]:
        t = row["t"]
        if not max_concurrent:
            return 200, 0.0
        while waiting and waiting[0] <= t:
            heapq.heappop(waiting)
        start = max(t, free[0])
        if start > t:
            if max_queue and len(waiting) >= max_queue:
                return 503, 0.0
            if timeout and start - t > timeout:
                heapq.heappush(waiting, t + timeout)
                return 504, timeout
            heapq.heappush(waiting, start)
        heapq.heapreplace(free, start + row["service"])
        return 200, start - t
    return step


def bounded_queue(requests: DataFrame, key: str, *, max_concurrent: int, max_queue: int = 0, timeout: float = 0.0, order: list[str]) -> DataFrame:
    return ordered_scan(requests, key, order, lambda: queue_step(max_concurrent, max_queue, timeout), "status int, wait double")


def fixed_ttl_step(ttl: float) -> Step:
    """hit: whether the key's entry is younger than ``ttl``; a miss inserts it."""
    inserted: list[float] = []

    def step(row: dict) -> tuple[bool]:
        hit = bool(inserted) and row["t"] - inserted[0] < ttl
        if not hit:
            inserted[:] = [row["t"]]
        return (hit,)
    return step


def fixed_ttl_hits(requests: DataFrame, key: str, *, ttl: float, order: list[str]) -> DataFrame:
    return ordered_scan(requests, key, order, lambda: fixed_ttl_step(ttl), "hit boolean")


def lru_step(capacity: int, keep_alive: float, pinned: frozenset[str] = frozenset()) -> Step:
    """hit, evicted (the model that had to go, or null). Idle models leave after ``keep_alive``; pinned ones never do; capacity 0 is unlimited."""
    loaded: OrderedDict[str, float] = OrderedDict()

    def step(row: dict) -> tuple[bool, str | None]:
        name, t = row["model"], row["t"]
        if name in pinned:
            return True, None
        for old in [m for m, seen in loaded.items() if t - seen >= keep_alive]:
            del loaded[old]
        hit = name in loaded
        loaded[name] = t
        loaded.move_to_end(name)
        evicted = loaded.popitem(last=False)[0] if capacity and len(loaded) > capacity else None
        return hit, evicted
    return step


def lru_residency(requests: DataFrame, node: str, *, capacity: int, keep_alive: float, pinned: frozenset[str] = frozenset(), order: list[str]) -> DataFrame:
    return ordered_scan(requests, node, order, lambda: lru_step(capacity, keep_alive, pinned), "hit boolean, evicted string")


def with_seconds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``t``: the time stamp as seconds."""
    return df.withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
