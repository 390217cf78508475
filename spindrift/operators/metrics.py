"""Metric roll-ups of a request log: counters, histograms, quantiles, rates, scaling signals.

Rates are counts over the window's length; unlike a scraped counter's rate there
is no extrapolation and there are no resets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Histogram bounds in seconds; fixed values.
REQUEST_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def counters(log: DataFrame, labels: list[str]) -> DataFrame:
    return log.groupBy(*labels).agg(F.count(F.lit(1)).alias("requests_total"))


def rollup_counters(log: DataFrame, labels: list[str]) -> DataFrame:
    """Counters for every combination of labels; ``*`` stands for all values."""
    grouped = log.cube(*labels).agg(F.count(F.lit(1)).alias("requests_total"), *[F.grouping(c).alias(f"_{c}") for c in labels])
    return grouped.select(*[F.when(F.col(f"_{c}") == 1, "*").otherwise(F.col(c)).alias(c) for c in labels], "requests_total")


def histogram(log: DataFrame, keys: list[Column], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts: keys, le (infinity last), n. One pass: a conditional count per bound, then one row per bound."""
    counts = log.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_{k}") for k, b in enumerate(bounds)], F.count(value).alias(f"_{len(bounds)}"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_{k}").alias("n")) for k, b in enumerate([*bounds, math.inf])])
    names = [c for c in counts.columns if not c.startswith("_")]
    return counts.select(*names, F.inline(rows))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The quantile by linear interpolation inside its bucket; the last finite bound if it falls beyond; null for an empty histogram."""
    w = Window.partitionBy(*keys).orderBy("le")
    ranked = buckets.withColumn("_total", F.max("n").over(Window.partitionBy(*keys))).withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rank = q * F.col("_total")
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (rank - F.col("_below")) / F.nullif(F.col("n") - F.col("_below"), F.lit(0))
    value = F.when(F.col("_total") == 0, None).when(F.col("le") == math.inf, F.col("_low")).otherwise(inside)
    first = ranked.where((F.col("n") >= rank) | (F.col("le") == math.inf))
    return first.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def rates(log: DataFrame, keys: list[str], ts: str, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Requests per second in each window."""
    stamp = F.col(ts).cast("timestamp")
    w = F.window(stamp, length, slide) if slide else F.window(stamp, length)
    counted = log.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))).cast("double")
    return counted.select(*keys, F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))


def error_rates(log: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    errors = F.count_if(F.col(status) >= 400)
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), errors.alias("errors"), (errors / F.count(F.lit(1))).alias("error_rate"))


def in_flight(requests: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The gauge after every change: +1 at the start, -1 at the end of a request; ends come first at equal times."""
    changes = requests.select(key, F.inline(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("change")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("change")))))
    steps = changes.groupBy(key, "t").agg(F.sum("change").alias("change"))
    return steps.select(key, "t", F.sum("change").over(Window.partitionBy(key).orderBy("t")).alias("in_flight"))


def gauge_sums(gauges: DataFrame, labels: list[str], value: str, alias: str = "value") -> DataFrame:
    """A gauge summed over all series that share the labels; without labels one row, 0 over no series."""
    return gauges.groupBy(*labels).agg(F.coalesce(F.sum(value), F.lit(0)).alias(alias))


def color(value: Column, warn: float, critical: float) -> Column:
    return F.when(value >= critical, "red").when(value >= warn, "yellow").otherwise("green")


def triggers(gauges: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Per time: rule, sum of the gauge over the pools that its pattern matches, and whether it exceeds the threshold (``gauges``: start, pool, value)."""
    table = gauges.select("start", "value", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(p).alias("pattern"), F.lit(t).alias("threshold")) for n, p, t in rules])), "pool")
    return table.where(F.regexp_like("pool", F.col("pattern"))).groupBy("start", "rule").agg(F.sum("value").alias("value"), F.max("threshold").alias("threshold")).withColumn("fires", F.col("value") > F.col("threshold"))


def desired_replicas(load: DataFrame, key: str, target: float, *, least: int = 1, most: int = 10, up_step: int = 2, down_step: int = 1, down_window: int = 5) -> DataFrame:
    """Utilisation rule per step (``load``: key, step, current, utilization): ceil(current * utilization / target) in bounds,
    not below the window's highest wish when scaling down, and at most so many pods a step."""
    wish = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("current") * F.col("utilization") / target))).cast("int")
    w = Window.partitionBy(key).orderBy("step")
    held = load.withColumn("wish", wish).withColumn("stable", F.max("wish").over(w.rowsBetween(-down_window, 0)))
    goal = F.when(F.col("wish") > F.col("current"), F.least(F.col("wish"), F.col("current") + up_step)).otherwise(F.greatest(F.least(F.col("stable"), F.col("current")), F.col("current") - down_step))
    return held.withColumn("replicas", goal.cast("int")).drop("stable")


def queue_stats(outcomes: DataFrame, key: str) -> DataFrame:
    """processed, rejected and timed out per key (``outcomes``: status)."""
    return outcomes.groupBy(key).agg(F.count_if(F.col("status") == 200).alias("processed"), F.count_if(F.col("status") == 503).alias("rejected"), F.count_if(F.col("status") == 504).alias("timed_out"))


def parse_duration(text: Column) -> Column:
    """Seconds of a duration such as ``1h30m``, ``250ms``; null if it is none."""
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]+)(h|ms|us|ns|m|s)"), F.lit(0))
    scale = F.create_map(*[F.lit(x) for kv in unit.items() for x in kv])
    number = lambda p: F.regexp_extract(p, r"^([0-9.]+)", 1).cast("double") * F.element_at(scale, F.regexp_extract(p, r"([a-z]+)$", 1))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + number(p))
    return F.when(text.rlike(r"^-?(([0-9]*\.?[0-9]+)(h|ms|us|ns|m|s))+$"), F.when(text.startswith("-"), -total).otherwise(total))
