"""Metrics, caching and control over ``events`` with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.hashing import request_key
from spindrift.operators import caching as K
from spindrift.operators import control as C
from spindrift.operators import metrics as M
from spindrift.plans.literals import frame, values
from spindrift.sources.tables import table

LOG = """SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, concat('pool', user_id % 4) AS pool, concat('m', user_id % 7) AS model, event_type AS operation,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 20 AS latency FROM {events}"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG.format(events="{events}"), events=table(spark, sf_dir, "events"))


def request_counters(spark, sf_dir):
    return M.counters(log(spark, sf_dir), ["pool", "model", "operation", "status"])


def request_cube(spark, sf_dir):
    return M.rollup_counters(log(spark, sf_dir), ["pool", "operation"])


def latency_buckets(spark, sf_dir):
    h = M.histogram(log(spark, sf_dir), [F.col("pool")], "latency", M.REQUEST_BUCKETS)
    return h.select("pool", F.when(F.col("le") > 1e9, "+Inf").otherwise(F.format_string("%.3f", "le")).alias("le"), "n")


def histogram_p99(spark, sf_dir):
    day = F.date_trunc("day", "ts").alias("day")
    h = M.histogram(log(spark, sf_dir), [F.col("pool"), day], "latency", M.REQUEST_BUCKETS)
    return M.histogram_quantile(h, ["pool", "day"], 0.99).select("pool", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("quantile", 6).alias("p99"))


def rate_5m(spark, sf_dir):
    r = M.rates(log(spark, sf_dir), ["pool"], "ts")
    return r.select("pool", F.unix_seconds("start").alias("start"), "n", F.round("rate", 9).alias("rate"))


def rate_sliding(spark, sf_dir):
    r = M.rates(log(spark, sf_dir), ["pool"], "ts", "2 hours", "1 hour")
    return r.select("pool", F.unix_seconds("start").alias("start"), "n")


def error_rate(spark, sf_dir):
    return M.error_rates(log(spark, sf_dir), ["pool", "operation"]).withColumn("error_rate", F.round("error_rate", 9))


RULES = [("read-heavy", "pool0", 10.0), ("write-heavy", "pool1", 50.0), ("overflow", "pool[23]", 100.0)]


def _gauges(spark, sf_dir):
    d = log(spark, sf_dir)
    return d.groupBy(F.unix_seconds(F.date_trunc("hour", "ts")).alias("start"), "pool").agg(F.sum("latency").alias("value"))


def scaling_triggers(spark, sf_dir):
    return M.triggers(_gauges(spark, sf_dir), RULES).withColumn("value", F.round("value", 6))


def gauge_colors(spark, sf_dir):
    return _gauges(spark, sf_dir).select("start", "pool", M.color(F.round("value", 6), 15.0, 40.0).alias("color"))


def hpa_replicas(spark, sf_dir):
    d = _gauges(spark, sf_dir).select("pool", F.col("start").alias("step"), (F.col("start") / 3600 % 6 + 1).cast("int").alias("current"), F.floor(F.round("value", 6) * 2).alias("utilization"))
    return M.desired_replicas(d, "pool", 70.0).select("pool", "step", "wish", "replicas")


def inflight_gauge(spark, sf_dir):
    d = log(spark, sf_dir).select("pool", F.unix_seconds("ts").alias("s"), (F.unix_seconds("ts") + F.ceil(F.col("latency") * 100)).alias("e"))
    return M.in_flight(d, "pool", "s", "e").withColumn("in_flight", F.col("in_flight").cast("long"))


def _endpoints(spark, sf_dir):
    """A user as an endpoint: healthy by the last event, one connection an event, the models of its events."""
    last = F.max_by("status", F.struct("ts", "event_id"))
    per_user = log(spark, sf_dir).groupBy("user_id", "pool", "model").agg((last < 400).cast("int").alias("healthy"), F.count(F.lit(1)).alias("connections"))
    return per_user.withColumn("loaded", F.lit(1))


def health_by_pool(spark, sf_dir):
    return M.gauge_sums(_endpoints(spark, sf_dir), ["pool"], "healthy")


def model_distribution(spark, sf_dir):
    return M.gauge_sums(_endpoints(spark, sf_dir), ["pool", "model"], "loaded")


def total_connections(spark, sf_dir):
    return M.gauge_sums(_endpoints(spark, sf_dir), [], "connections")


def duration_parse(spark, sf_dir):
    d = frame(spark, [("1h30m",), ("250ms",), ("5m",), ("1.5s",), ("-2s",), ("x",), ("10",)], "text string")
    return d.select("text", F.coalesce(F.round(M.parse_duration(F.col("text")), 6), F.lit(-1.0)).alias("seconds"))


def cache_ttl_hits(spark, sf_dir):
    return K.sliding_ttl_hits(log(spark, sf_dir), ["user_id", "operation"], "ts", ["event_id"], 36_000).select("event_id", "hit")


def cache_fixed_ttl(spark, sf_dir):
    keyed = C.with_seconds(log(spark, sf_dir)).select("event_id", F.concat_ws(":", "user_id", "operation").alias("key"), "t")
    return C.fixed_ttl_hits(keyed, "key", ttl=36_000, order=["t", "event_id"]).select("event_id", "hit")


def cache_hit_rate(spark, sf_dir):
    hits = K.sliding_ttl_hits(log(spark, sf_dir), ["user_id", "operation"], "ts", ["event_id"], 36_000)
    return K.hit_rates(hits, ["operation"]).withColumn("hit_rate", F.round("hit_rate", 9))


def dedup_embed_keys(spark, sf_dir):
    """Documents as embed requests: how often each text is asked for, and the calls that sharing saves."""
    d = table(spark, sf_dir, "documents").select("lang", "text")
    per_key = d.groupBy("lang", request_key(F.col("lang"), F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("requests"))
    return per_key.groupBy("lang").agg(F.count(F.lit(1)).alias("keys"), F.sum("requests").alias("requests"), F.sum(F.col("requests") - 1).alias("saved"))


def model_residency(spark, sf_dir):
    r = K.residency(log(spark, sf_dir), "model", "ts", "10 minutes")
    return r.select("model", F.unix_seconds("loaded").alias("loaded"), F.unix_seconds("unloaded").alias("unloaded"), "accesses")


def residency_stats(spark, sf_dir):
    models = frame(spark, [(f"m{k}",) for k in range(9)], "name string")
    return K.residency_stats(log(spark, sf_dir), "model", "ts", models, ["m1", "m2"], "10 minutes")


def lru_evictions(spark, sf_dir):
    d = C.with_seconds(log(spark, sf_dir)).select("event_id", "pool", "model", "t")
    return C.lru_residency(d, "pool", capacity=1, keep_alive=1200, order=["t", "event_id"]).select("event_id", "hit", F.coalesce("evicted", F.lit("")).alias("evicted"))


def token_bucket(spark, sf_dir):
    d = C.with_seconds(log(spark, sf_dir)).select("event_id", "user_id", "t")
    return C.token_bucket(d, "user_id", rate=1 / 16384, burst=2, order=["t", "event_id"]).select("event_id", "allowed")


def circuit_breaker(spark, sf_dir):
    d = C.with_seconds(log(spark, sf_dir)).select("event_id", "user_id", "t", (F.col("status") >= 400).alias("failed"))
    return C.circuit_breaker(d, "user_id", threshold=2, timeout=40_000, order=["t", "event_id"]).select("event_id", "allowed", "state")


def bounded_queue(spark, sf_dir):
    d = C.with_seconds(log(spark, sf_dir)).select("event_id", "pool", "t", F.ceil(F.col("latency") * 300).cast("double").alias("service"))
    return C.bounded_queue(d, "pool", max_concurrent=1, max_queue=3, timeout=1500.0, order=["t", "event_id"]).select("event_id", "status", "wait")


def queue_stats(spark, sf_dir):
    d = C.with_seconds(log(spark, sf_dir)).select("event_id", "pool", "t", F.ceil(F.col("latency") * 300).cast("double").alias("service"))
    return M.queue_stats(C.bounded_queue(d, "pool", max_concurrent=1, max_queue=3, timeout=1500.0, order=["t", "event_id"]), "pool")


QUERIES = {n.__name__: n for n in (
    request_counters, request_cube, latency_buckets, histogram_p99, rate_5m, rate_sliding, error_rate, scaling_triggers, gauge_colors, hpa_replicas, inflight_gauge, health_by_pool, model_distribution, total_connections, duration_parse, cache_ttl_hits, cache_fixed_ttl,
    cache_hit_rate, dedup_embed_keys, model_residency, residency_stats, lru_evictions, token_bucket, circuit_breaker, bounded_queue, queue_stats)}

_LOG = "WITH l AS (" + LOG.format(events="events") + ")"
_BOUNDS = "b AS (SELECT * FROM " + values([(b,) for b in M.REQUEST_BUCKETS] + [(1e308,)], "le") + ")"
_GAUGES = _LOG + ", g AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, pool, sum(latency) AS value FROM l GROUP BY 1, 2)"
_HITS = _LOG + ", h AS (SELECT event_id, operation, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, operation ORDER BY ts, event_id))) / 1e6 < 36000, false) AS hit FROM l)"
_SESSIONS = _LOG + """, a AS (SELECT model, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY model ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM l),
    s AS (SELECT model, ts, sum(fresh) OVER (PARTITION BY model ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM a), r AS (SELECT model, n, min(ts) AS first, max(ts) + INTERVAL 10 MINUTE AS last, count(*) AS accesses FROM s GROUP BY 1, 2)"""


def _fold(key: str, fields: str, start: str, step: str, out: str) -> str:
    """Per key, a fold over its rows in order that appends one result per row."""
    return f"""{_LOG}, q AS (SELECT {key} AS k, list({{'id': event_id, 't': epoch_us(ts) / 1e6, {fields}}} ORDER BY ts, event_id) AS xs FROM l GROUP BY 1),
        z AS (SELECT list_reduce(list_transform(xs, lambda x: {{'x': x, 's': {start}, 'out': []::{out}[]}}), lambda a, y: {step}, {{'x': xs[1], 's': {start}, 'out': []::{out}[]}}) AS a FROM q),
        u AS (SELECT unnest(a.out) AS o FROM z)"""


_TOKENS = "least(2.0, a.s.tokens + (y.x.t - coalesce(a.s.last, y.x.t)) * (1.0 / 16384)::DOUBLE)"
_OPEN = "(a.s.state = 'open' AND y.x.t - a.s.last <= 40000)"
_NEXT = f"(CASE WHEN {_OPEN} THEN 'open' WHEN NOT y.x.failed THEN 'closed' WHEN a.s.state = 'open' OR a.s.failures + 1 >= 2 THEN 'open' ELSE a.s.state END)"
_STALE = "(a.s.at IS NULL OR y.x.t - a.s.at >= 36000)"
_ENDPOINTS = _LOG + ", e AS (SELECT user_id, pool, model, arg_max(status, (ts, event_id)) < 400 AS healthy, count(*) AS connections FROM l GROUP BY ALL)"
ORACLE_SQL = {
    "health_by_pool": _ENDPOINTS + " SELECT pool, count(*) FILTER (healthy) AS value FROM e GROUP BY 1",
    "model_distribution": _ENDPOINTS + " SELECT pool, model, count(*) AS value FROM e GROUP BY 1, 2",
    "total_connections": "SELECT count(*) AS value FROM events",
    "request_counters": _LOG + " SELECT pool, model, operation, status::INT AS status, count(*) AS requests_total FROM l GROUP BY 1, 2, 3, 4",
    "request_cube": _LOG + " SELECT CASE WHEN grouping(pool) = 1 THEN '*' ELSE pool END AS pool, CASE WHEN grouping(operation) = 1 THEN '*' ELSE operation END AS operation, count(*) AS requests_total FROM l GROUP BY CUBE (pool, operation)",
    "latency_buckets": f"{_LOG}, {_BOUNDS} SELECT pool, CASE WHEN le > 1e9 THEN '+Inf' ELSE printf('%.3f', le) END AS le, count(*) FILTER (latency <= le) AS n FROM l, b GROUP BY pool, b.le",
    "histogram_p99": f"""{_LOG}, {_BOUNDS}, h AS (SELECT pool, strftime(ts, '%Y-%m-%d') AS day, le, count(*) FILTER (latency <= le) AS n, count(latency) AS total FROM l, b GROUP BY 1, 2, 3),
        w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY pool, day ORDER BY le), 0) AS low, coalesce(lag(n) OVER (PARTITION BY pool, day ORDER BY le), 0) AS below FROM h),
        c AS (SELECT *, row_number() OVER (PARTITION BY pool, day ORDER BY le) AS r FROM w WHERE n >= 0.99 * total OR le > 1e9)
        SELECT pool, day, round(CASE WHEN le > 1e9 THEN low ELSE low + (le - low) * (0.99::DOUBLE * total - below) / (n - below) END, 6)::DOUBLE AS p99 FROM c WHERE r = 1""",
    "rate_5m": _LOG + " SELECT pool, (epoch(ts)::BIGINT // 300 * 300)::BIGINT AS start, count(*) AS n, round(count(*) / 300.0, 9)::DOUBLE AS rate FROM (SELECT pool, date_trunc('second', ts) AS ts FROM l) GROUP BY 1, 2",
    "rate_sliding": _LOG + ", s AS (SELECT pool, unnest([epoch(date_trunc('hour', ts))::BIGINT, epoch(date_trunc('hour', ts))::BIGINT - 3600]) AS start FROM l) SELECT pool, start, count(*) AS n FROM s GROUP BY 1, 2",
    "error_rate": _LOG + " SELECT pool, operation, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, round(count(*) FILTER (status >= 400) / count(*), 9)::DOUBLE AS error_rate FROM l GROUP BY 1, 2",
    "scaling_triggers": _GAUGES + ", r AS (SELECT * FROM " + values(RULES, "rule, pattern, threshold") + ") SELECT start, rule, round(sum(value), 6) AS value, max(threshold)::DOUBLE AS threshold, sum(value) > max(threshold) AS fires FROM g JOIN r ON regexp_matches(pool, pattern) GROUP BY 1, 2",
    "gauge_colors": _GAUGES + " SELECT start, pool, CASE WHEN round(value, 6) >= 40 THEN 'red' WHEN round(value, 6) >= 15 THEN 'yellow' ELSE 'green' END AS color FROM g",
    "hpa_replicas": _GAUGES + """, d AS (SELECT pool, start AS step, (start // 3600 % 6 + 1)::INT AS cur, floor(round(value, 6) * 2) AS u FROM g),
        w AS (SELECT *, greatest(1, least(10, ceil(cur * u / 70.0)))::INT AS wish FROM d), s AS (SELECT *, max(wish) OVER (PARTITION BY pool ORDER BY step ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS stable FROM w)
        SELECT pool, step, wish, CASE WHEN wish > cur THEN least(wish, cur + 2) ELSE greatest(least(stable, cur), cur - 1) END::INT AS replicas FROM s""",
    "inflight_gauge": _LOG + """, c AS (SELECT pool, epoch(date_trunc('second', ts))::BIGINT AS t, 1 AS d FROM l UNION ALL SELECT pool, epoch(date_trunc('second', ts))::BIGINT + ceil(latency * 100)::BIGINT, -1 FROM l),
        s AS (SELECT pool, t, sum(d) AS d FROM c GROUP BY 1, 2) SELECT pool, t, (sum(d) OVER (PARTITION BY pool ORDER BY t))::BIGINT AS in_flight FROM s""",
    "duration_parse": "SELECT text, seconds::DOUBLE AS seconds FROM (VALUES ('1h30m', 5400), ('250ms', 0.25), ('5m', 300), ('1.5s', 1.5), ('-2s', -2), ('x', -1), ('10', -1)) AS t(text, seconds)",
    "cache_ttl_hits": _HITS + " SELECT event_id, hit FROM h",
    "cache_hit_rate": _HITS + " SELECT operation, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*) * 100, 9)::DOUBLE AS hit_rate FROM h GROUP BY 1",
    "cache_fixed_ttl": _fold("user_id || ':' || event_type", "'z': 0", "{'at': NULL::DOUBLE}", f"{{'x': y.x, 's': {{'at': CASE WHEN {_STALE} THEN y.x.t ELSE a.s.at END}}, 'out': list_append(a.out, {{'id': y.x.id, 'hit': NOT {_STALE}}})}}", "STRUCT(id BIGINT, hit BOOLEAN)").replace("SELECT user_id || ':' || event_type", "SELECT user_id || ':' || operation") + " SELECT o.id AS event_id, o.hit AS hit FROM u",
    "dedup_embed_keys": "SELECT lang, count(*) AS keys, sum(n)::BIGINT AS requests, sum(n - 1)::BIGINT AS saved FROM (SELECT lang, text, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1",
    "model_residency": _SESSIONS + " SELECT model, epoch(date_trunc('second', first))::BIGINT AS loaded, epoch(date_trunc('second', last))::BIGINT AS unloaded, accesses FROM r",
    "residency_stats": _SESSIONS + " SELECT 9::BIGINT AS discovered, 2::BIGINT AS pinned, sum(CASE WHEN model IN ('m1', 'm2') THEN accesses ELSE accesses - 1 END)::BIGINT AS hits, count(*) FILTER (model NOT IN ('m1', 'm2')) AS misses FROM r",
    "token_bucket": _fold("user_id", "'z': 0", "{'tokens': 2.0::DOUBLE, 'last': NULL::DOUBLE}", f"{{'x': y.x, 's': {{'tokens': ({_TOKENS} - CASE WHEN {_TOKENS} >= 1 THEN 1 ELSE 0 END)::DOUBLE, 'last': y.x.t}}, 'out': list_append(a.out, {{'id': y.x.id, 'ok': {_TOKENS} >= 1}})}}", "STRUCT(id BIGINT, ok BOOLEAN)") + " SELECT o.id AS event_id, o.ok AS allowed FROM u",
    "circuit_breaker": _fold("user_id", "'failed': status >= 400", "{'state': 'closed', 'failures': 0::BIGINT, 'last': 0.0::DOUBLE}",
        f"{{'x': y.x, 's': {{'state': {_NEXT}, 'failures': (CASE WHEN {_OPEN} THEN a.s.failures WHEN y.x.failed THEN a.s.failures + 1 ELSE 0 END)::BIGINT, 'last': (CASE WHEN NOT {_OPEN} AND y.x.failed THEN y.x.t ELSE a.s.last END)::DOUBLE}}, 'out': list_append(a.out, {{'id': y.x.id, 'ok': NOT {_OPEN}, 'state': {_NEXT}}})}}", "STRUCT(id BIGINT, ok BOOLEAN, state VARCHAR)") + " SELECT o.id AS event_id, o.ok AS allowed, o.state AS state FROM u",
}
