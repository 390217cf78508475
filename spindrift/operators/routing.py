"""Routing: first matching route, destination, pool and endpoint.

A route table is control data with a checked size (``most_routes``). It becomes
one row holding the routes in order of priority, so matching a request is one
projection over an array: no theta join, no shuffle and no window over requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.hashing import fnv32a

ROUTE_SCHEMA = ("name string, priority int, operations array<string>, models array<string>, headers map<string,struct<exact:string,prefix:string,regex:string>>, "
                "source_tables array<string>, window struct<start:string,end:string,days:array<int>>")


def glob_regex(pattern: Column) -> Column:
    """A model pattern as an anchored regular expression; only ``*`` is special."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit(r"\z"))


def minutes_of(clock: Column) -> Column:
    return F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")


def in_window(ts: Column, start: Column, end: Column, days: Column) -> Column:
    """UTC time of day in [start, end), over midnight when start > end, never when equal; empty days mean any."""
    now, lo, hi = F.hour(ts) * 60 + F.minute(ts), minutes_of(start), minutes_of(end)
    day = days.isNull() | (F.size(days) <= 0) | F.array_contains(days, F.dayofweek(ts) - 1)
    return day & F.when(lo <= hi, (now >= lo) & (now < hi)).otherwise((now >= lo) | (now < hi))


def _unset(values: Column) -> Column:
    return values.isNull() | (F.size(values) <= 0)


def header_matches(headers: Column, matchers: Column) -> Column:
    """``matchers``: entries of a map. Every matcher's header exists and equals, starts with or contains a match of what is set. Header names match in any case."""
    folded = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))

    def one(entry: Column) -> Column:
        value, m = F.element_at(folded, F.lower(entry["key"])), entry["value"]
        hit = (value == m["exact"]) | value.startswith(m["prefix"]) | F.regexp_like(value, m["regex"])
        either = F.coalesce(value == m["exact"], F.lit(False)) | F.coalesce(value.startswith(m["prefix"]), F.lit(False)) | F.coalesce(F.regexp_like(value, m["regex"]), F.lit(False))
        return F.when(hit.isNull(), either).otherwise(hit)

    return matchers.isNull() | F.forall(matchers, lambda e: F.coalesce(one(e), F.lit(False)))


def ordered_routes(routes: DataFrame, most_routes: int = 10_000) -> DataFrame:
    """One row: all routes by priority (high first), then name. Of equal names the last registered (``version``) stays."""
    if "version" in routes.columns:
        latest = routes.groupBy("name").agg(F.max_by(F.struct(*[c for c in routes.columns if c != "version"]), "version").alias("r")).select("r.*")
    else:
        latest = routes
    compiled = latest.withColumn("models", F.transform("models", glob_regex)).withColumn("headers", F.map_entries("headers"))
    packed = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("order"), "name", *[c for c in compiled.columns if c != "name"])))
    checked = F.when(F.count(F.lit(1)) <= most_routes, packed).otherwise(F.raise_error(F.lit(f"more than {most_routes} routes")))
    return compiled.groupBy().agg(checked.alias("_routes"))


def match_routes(requests: DataFrame, routes: DataFrame, *, operation: str = "operation", model: str = "model", headers: str = "headers", source_table: str = "source_table", ts: str = "ts") -> DataFrame:
    """``requests`` with ``route``: the name of the first route whose every given predicate holds, or null."""
    def matches(r: Column) -> Column:
        window = r["window"]
        return ((_unset(r["operations"]) | F.array_contains(r["operations"], F.col(operation)))
                & (_unset(r["models"]) | F.exists(r["models"], lambda p: F.regexp_like(F.coalesce(F.col(model), F.lit("")), p)))
                & header_matches(F.col(headers), r["headers"])
                & (_unset(r["source_tables"]) | F.coalesce(F.array_contains(r["source_tables"], F.col(source_table)), F.lit(False)))
                & (window.isNull() | in_window(F.col(ts), window["start"], window["end"], window["days"])))

    held = requests.crossJoin(F.broadcast(ordered_routes(routes)))  # one row, whose size ordered_routes checks
    return held.withColumn("route", F.get(F.filter("_routes", matches), F.lit(0))["name"]).drop("_routes")


def parse_threshold(text: Column) -> Column:
    """``>50``, ``>=100ms``, ``<2s``: operator (default ``==``) and value in seconds for time units.

    The value is lenient: digits and the points between them count, a leading minus negates, anything else is skipped.
    """
    text = F.trim(text)
    operator = F.regexp_extract(text, r"^(>=|<=|>|<|==)", 1)
    rest = F.trim(F.substring(text, F.char_length(operator) + 1, F.lit(1 << 20)))
    milli, second = rest.endswith("ms"), rest.endswith("s")
    body = F.when(milli, F.regexp_replace(rest, "ms$", "")).when(second, F.regexp_replace(rest, "s$", "")).otherwise(rest)
    kept = F.regexp_replace(body, r"[^0-9.]", "")
    whole, parts = F.regexp_extract(kept, r"^([0-9]*)", 1), F.regexp_replace(F.regexp_replace(kept, r"^[0-9]*", ""), r"\.", "")
    number = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(parts == "", "0").otherwise(parts)).cast("double")
    signed = F.when(body.startswith("-"), -number).otherwise(number)
    return F.struct(F.when(operator == "", "==").otherwise(operator).alias("op"), F.when(milli, signed / 1000).otherwise(signed).alias("value"))


def parse_threshold_strict(text: Column) -> Column:
    """As ``parse_threshold``, but a value that is no number is null."""
    value = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(>=|<=|>|<|==)\s*", ""), r"(ms|s)$", "")
    return F.when(F.try_to_number(value, F.lit("S999999999999.999999")).isNotNull() | value.try_cast("double").isNotNull(), parse_threshold(text))


def holds(op: Column, bound: Column, value: Column) -> Column:
    """Whether ``value op bound``; unset conditions hold, unknown operators do not."""
    by_op = F.when(op == ">", value > bound).when(op == "<", value < bound).when(op == ">=", value >= bound).when(op == "<=", value <= bound).when(op == "==", value == bound).otherwise(False)
    return F.when(op.isNull(), True).otherwise(by_op)


def pool_stats(endpoints: DataFrame) -> DataFrame:
    """Per pool over healthy endpoints: replicas, avg_queue_depth, models loaded anywhere."""
    return endpoints.where("healthy").groupBy("pool").agg(
        F.count(F.lit(1)).alias("replicas"), F.avg("queue_depth").alias("avg_queue_depth"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("loaded"))


def choose_destination(matched: DataFrame, destinations: DataFrame, endpoints: DataFrame, *, request_id: str, model: str = "model", ts: str = "ts") -> DataFrame:
    """``matched`` with ``destination``: of the route's eligible destinations the one with the most weight, first on ties; null if none.

    ``destinations`` (route, position, pool, weight, queue_op, queue_value, replica_op, replica_value, require_loaded, window) is joined to
    its pools' statistics first, then packed to one row per route, so a request meets at most one row.
    """
    live = destinations.join(pool_stats(endpoints), "pool")
    fits = live.where(holds(F.col("queue_op"), F.col("queue_value"), F.col("avg_queue_depth")) & holds(F.col("replica_op"), F.col("replica_value"), F.col("replicas").cast("double")))
    packed = fits.groupBy("route").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "position", "pool", "require_loaded", "loaded", "window"))).alias("_d"))

    def open_now(d: Column) -> Column:
        w = d["window"]
        return (~F.coalesce(d["require_loaded"], F.lit(False)) | F.array_contains(d["loaded"], F.col(model))) & (w.isNull() | in_window(F.col(ts), w["start"], w["end"], w["days"]))

    return matched.join(packed, "route", "left").withColumn("destination", F.get(F.filter("_d", open_now), F.lit(0))["pool"]).drop("_d")


def resolve(chosen: DataFrame, fallbacks: DataFrame, *, operation: str = "operation", default_pool: str = "default") -> DataFrame:
    """Adds status, message, retry_after, pool and workload.

    A route without an eligible destination follows its fallback: reject (503 unless set), redirect, or nothing. Then the pool is the
    destination, the redirect, the pool that the request itself names (``pool_header``) or the default.
    """
    f = chosen.join(fallbacks, "route", "left")
    stuck = F.col("route").isNotNull() & F.col("destination").isNull()
    rejected = stuck & (F.col("action") == "reject")
    named = F.coalesce(F.col("destination"), F.when(stuck & (F.col("action") == "redirect"), F.nullif(F.col("redirect_pool"), F.lit(""))), F.nullif(F.col("pool_header"), F.lit("")), F.lit(default_pool))
    by_operation = F.when(F.col(operation).isin("embed", "rerank"), "read-heavy").when(F.col(operation) == "chunk", "write-heavy").otherwise("general")
    return f.select(
        *chosen.columns, F.when(F.coalesce(rejected, F.lit(False)), F.coalesce("status_code", F.lit(503))).otherwise(200).alias("status"),
        F.when(rejected, F.col("message")).alias("message"), F.when(rejected, F.col("retry_after")).alias("retry_after"),
        F.when(~F.coalesce(rejected, F.lit(False)), named).alias("pool"), F.coalesce(F.nullif(F.col("workload_header"), F.lit("")), by_operation).alias("workload"))


def candidates(keys: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(model, pool) keys with their candidate endpoints: those with the model, narrowed to the pool if that leaves any, else the pool's.

    Only healthy endpoints count, and with a column ``allowed`` only those whose circuit breaker lets requests through.
    """
    up = endpoints.where("healthy and allowed" if "allowed" in endpoints.columns else "healthy")
    with_model = keys.join(up.select(F.explode("models").alias("model"), F.col("pool").alias("home"), "address", "connections", "queue_depth"), "model")
    in_pool = F.max((F.col("home") == F.col("pool")).cast("int")).over(Window.partitionBy("model", "pool"))
    narrowed = with_model.withColumn("_any", in_pool).where((F.col("_any") == 0) | (F.col("home") == F.col("pool"))).drop("_any", "home")
    rest = keys.join(with_model.select("model", "pool").distinct(), ["model", "pool"], "left_anti")
    return narrowed.unionByName(rest.join(up.select("pool", "address", "connections", "queue_depth"), "pool"))


def pick_endpoint(found: DataFrame, workload: str = "read-heavy", max_queue: int = 50, top: int = 3) -> DataFrame:
    """One endpoint per (model, pool). Ties in connections go to the lower address.

    read-heavy: fewest connections among the ``top`` nearest by hash; burst: the first address whose queue is short, else the
    fewest connections; all others: the fewest connections.
    """
    least = F.min_by("address", F.struct("connections", "address"))
    if workload == "read-heavy":
        near = Window.partitionBy("model", "pool").orderBy(fnv32a(F.col("model")).bitwiseXOR(fnv32a(F.col("address"))), "address")
        found = found.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= top)
    elif workload == "burst":
        return found.groupBy("model", "pool").agg(F.coalesce(F.min(F.when(F.col("queue_depth") < max_queue, F.col("address"))), least).alias("address"))
    return found.groupBy("model", "pool").agg(least.alias("address"))


def latest_endpoints(updates: DataFrame) -> DataFrame:
    """The registry after a stream of updates (address, pool, ready, ts): last state per address, with the first registration's pool."""
    last = updates.groupBy("address").agg(F.max_by("ready", "ts").alias("ready"), F.min_by("pool", "ts").alias("pool"), F.max("ts").alias("last_seen"))
    return last.where("ready").drop("ready")


def health(probes: DataFrame) -> DataFrame:
    """Healthy iff the last probe returned 200 (``probes``: address, ts, status; null status is an error)."""
    return probes.groupBy("address").agg(F.coalesce(F.max_by("status", "ts") == 200, F.lit(False)).alias("healthy"))


def expand_status(pattern: Column) -> Column:
    """``5xx`` to 500..599; patterns of any other form give nothing."""
    base = F.regexp_extract(pattern, r"^([0-9]{1,6})xx$", 1)
    return F.when(base != "", F.sequence(base.try_cast("int") * 100, base.try_cast("int") * 100 + 99)).otherwise(F.array().cast("array<int>"))


def clamp_int32(value: Column) -> Column:
    """Saturating conversion, fractions cut off; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value.cast("double"), F.lit(float(2**31 - 1))), F.lit(float(-(2**31))))).cast("int")
