"""Routing queries: ``events`` as requests, small control tables as routes and endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.hashing import fnv32a
from spindrift.operators import routing as R
from spindrift.plans.literals import frame, values
from spindrift.sources.tables import table

# name, priority, operations, models, tenant prefix, window start, window end, days
ROUTES = [
    ("night-embed", 300, ["embed"], [], None, "22:00", "06:00", []), ("weekend", 250, [], [], None, "08:00", "20:00", [0, 6]),
    ("small-models", 200, ["embed", "rerank"], ["m1*", "m2?"], None, None, None, []), ("tenant-a", 200, [], [], "a-", None, None, []),
    ("chunks", 150, ["chunk"], ["m*.v1", "m3*"], None, None, None, []), ("never", 140, [], [], None, "10:00", "10:00", []), ("catch-rerank", 10, ["rerank"], [], None, None, None, [])]
# route, position, pool, weight, queue op, queue value, replica op, replica value, require loaded
DESTINATIONS = [
    ("night-embed", 0, "batch", 20, "<", 40.0, None, None, False), ("night-embed", 1, "fast", 80, "<", 5.0, None, None, False), ("weekend", 0, "batch", 50, None, None, ">=", 2.0, False),
    ("weekend", 1, "fast", 50, None, None, ">=", 2.0, False), ("small-models", 0, "fast", 10, None, None, None, None, True), ("tenant-a", 0, "empty", 100, None, None, None, None, False),
    ("chunks", 0, "batch", 5, ">", 1.0, None, None, False), ("catch-rerank", 0, "fast", 1, ">", 1000.0, None, None, False)]
# route, action, redirect pool, status code, message, retry after
FALLBACKS = [("tenant-a", "redirect", "batch", None, None, None), ("small-models", "reject", None, 429, "not loaded", 7), ("catch-rerank", "reject", None, None, "busy", 5)]
# address, pool, models, queue depth, connections, healthy
ENDPOINTS = [
    ("http://10.0.0.1:8080", "fast", ["m1", "m12"], 3, 4, True), ("http://10.0.0.2:8080", "fast", ["m2", "m1"], 9, 2, True), ("http://10.0.0.3:8080", "batch", ["m3"], 30, 1, True),
    ("http://10.0.0.4:8080", "batch", ["m1", "m3"], 60, 0, True), ("http://10.0.0.5:8080", "batch", [], 12, 0, True), ("http://10.0.0.6:8080", "gone", ["m1"], 0, 0, False)]
THRESHOLDS = [">50", ">=100", "<10", "==3", "7", ">100ms", "<2s", "=5", "1e3", ">50%", "abc", "1.5.2", "<-4", " >= 20ms ", ""]
CLOCKS = [("09:00", "17:00", []), ("22:00", "06:00", []), ("10:00", "10:00", []), ("09:00", "17:00", [0])]

REQUESTS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'embed' WHEN 'view' THEN 'rerank' WHEN 'purchase' THEN 'chunk' WHEN 'signup' THEN 'embed' ELSE 'other' END AS operation,
    concat('m', CAST(event_id % 41 AS STRING), CASE WHEN event_id % 3 = 0 THEN '.v1' ELSE '' END) AS model,
    concat(CASE WHEN user_id % 4 = 0 THEN 'a-' ELSE 'b-' END, CAST(user_id AS STRING)) AS tenant, CAST(ts AS TIMESTAMP) AS ts,
    CASE WHEN user_id % 10 = 3 THEN 'fast' ELSE '' END AS pool_header, CASE WHEN user_id % 7 = 2 THEN 'burst' ELSE '' END AS workload_header FROM {events}"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.sql(REQUESTS.format(events="{events}"), events=events).withColumn("headers", F.create_map(F.lit("X-Tenant"), "tenant")).withColumn("source_table", F.lit(None).cast("string"))


def routes(spark: SparkSession) -> DataFrame:
    rows = [(n, p, o, m, {"x-tenant": (None, t, None)} if t else None, None, (s, e, d) if s else None) for n, p, o, m, t, s, e, d in ROUTES]
    return frame(spark, rows, R.ROUTE_SCHEMA)


def endpoints(spark: SparkSession) -> DataFrame:
    return frame(spark, ENDPOINTS, "address string, pool string, models array<string>, queue_depth int, connections int, healthy boolean")


def destinations(spark: SparkSession) -> DataFrame:
    rows = frame(spark, DESTINATIONS, "route string, position int, pool string, weight int, queue_op string, queue_value double, replica_op string, replica_value double, require_loaded boolean")
    return rows.withColumn("window", F.lit(None).cast("struct<start:string,end:string,days:array<int>>"))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.choose_destination(R.match_routes(requests(spark, sf_dir), routes(spark)), destinations(spark), endpoints(spark), request_id="event_id")


def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_routes(requests(spark, sf_dir), routes(spark)).select("event_id", "route")


def route_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).select("event_id", "route", "destination")


def pool_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    fallbacks = frame(spark, FALLBACKS, "route string, action string, redirect_pool string, status_code int, message string, retry_after int")
    return R.resolve(_chosen(spark, sf_dir), fallbacks).select("event_id", "status", "message", F.coalesce("retry_after", F.lit(0)).alias("retry_after"), "pool", "workload")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("model", F.element_at(F.array(F.lit("fast"), F.lit("batch"), F.lit("gone")), (F.col("event_id") % 3 + 1).cast("int")).alias("pool")).distinct()


def _picked(workload: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.pick_endpoint(R.candidates(_keys(spark, sf_dir), endpoints(spark)), workload)
    return query


def threshold_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, [(t,) for t in THRESHOLDS], "text string").select("text", R.parse_threshold(F.col("text")).alias("t"))
    return rows.select("text", "t.op", F.round("t.value", 6).alias("value"))


def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    flags = [R.in_window(ts, F.lit(s), F.lit(e), F.array(*map(F.lit, d)).cast("array<int>")).alias(f"w{k}") for k, (s, e, d) in enumerate(CLOCKS)]
    return table(spark, sf_dir, "events").select("event_id", *flags)


def fnv32a_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("tenant").distinct().select("tenant", fnv32a(F.col("tenant")).alias("hash"))


def endpoint_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("http://e"), F.col("user_id")).alias("address"), "event_type", "event_id")
    updates = e.select("address", F.col("event_type").alias("pool"), (F.col("event_type") != "error").alias("ready"), F.col("event_id").alias("ts"))
    return R.latest_endpoints(updates)


def endpoint_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    probes = e.select(F.concat(F.lit("http://e"), F.col("user_id")).alias("address"), F.col("event_id").alias("ts"), F.when(F.col("event_type") == "error", 500).when(F.col("event_type") != "view", 200).alias("status"))
    return R.health(probes)


def route_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered_routes(routes(spark)).select(F.posexplode("_routes").alias("place", "r")).select("place", "r.name")


def retry_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, [("5xx",), ("429",), ("4xx",), ("retry",), ("6xx",)], "pattern string")
    return rows.select("pattern", F.explode(R.expand_status(F.col("pattern"))).alias("status"))


def int_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", R.clamp_int32(F.col("o_totalprice") * (F.col("o_orderkey") % 9 - 4) * 10_000).alias("clamped"))


QUERIES = {
    "route_match": route_match, "route_destination": route_destination, "pool_resolution": pool_resolution, "endpoint_hash_affinity": _picked("read-heavy"),
    "endpoint_least_loaded": _picked("general"), "endpoint_queue_aware": _picked("burst"), "threshold_parse": threshold_parse, "time_window": time_window, "fnv32a": fnv32a_query,
    "endpoint_registry": endpoint_registry, "endpoint_health": endpoint_health, "route_order": route_order, "retry_statuses": retry_statuses, "int_clamp": int_clamp}

_REQ = "req AS (" + REQUESTS.format(events="events") + ")"
_ROUTES = "routes AS (SELECT name, priority, operations::VARCHAR[] AS operations, models::VARCHAR[] AS models, tenant_prefix::VARCHAR AS tenant_prefix, w_start::VARCHAR AS w_start, w_end::VARCHAR AS w_end, days::INT[] AS days FROM " + values(ROUTES, "name, priority, operations, models, tenant_prefix, w_start, w_end, days") + ")"


def _window_sql(ts: str, start: str, end: str, days: str) -> str:
    now = f"(hour({ts}) * 60 + minute({ts}))"
    lo, hi = (f"(substr({x}, 1, 2)::INT * 60 + substr({x}, 4, 2)::INT)" for x in (start, end))
    return f"((len({days}) = 0 OR list_contains({days}, dayofweek({ts}))) AND CASE WHEN {lo} <= {hi} THEN {now} >= {lo} AND {now} < {hi} ELSE {now} >= {lo} OR {now} < {hi} END)"


_MATCH = f"""{_REQ}, {_ROUTES},
    hits AS (SELECT q.event_id, r.name, row_number() OVER (PARTITION BY q.event_id ORDER BY r.priority DESC, r.name) AS n FROM req q JOIN routes r
        ON (len(r.operations) = 0 OR list_contains(r.operations, q.operation))
        AND (len(r.models) = 0 OR len(list_filter(r.models, lambda p: regexp_full_match(q.model, replace(replace(replace(p, '.', '\\.'), '?', '\\?'), '*', '.*')))) > 0)
        AND (r.tenant_prefix IS NULL OR starts_with(q.tenant, r.tenant_prefix))
        AND (r.w_start IS NULL OR {_window_sql('q.ts', 'r.w_start', 'r.w_end', 'r.days')})),
    m AS (SELECT q.*, h.name AS route FROM req q LEFT JOIN hits h ON h.event_id = q.event_id AND h.n = 1)"""
_EP = "ep AS (SELECT address, pool, models::VARCHAR[] AS models, queue_depth, connections, healthy FROM " + values(ENDPOINTS, "address, pool, models, queue_depth, connections, healthy") + ")"
_OPS = lambda op, bound, v: f"(CASE {op} WHEN '>' THEN {v} > {bound} WHEN '<' THEN {v} < {bound} WHEN '>=' THEN {v} >= {bound} WHEN '<=' THEN {v} <= {bound} WHEN '==' THEN {v} = {bound} ELSE {op} IS NULL END)"
_DEST = f"""{_MATCH}, {_EP},
    st AS (SELECT pool, count(*) AS replicas, avg(queue_depth) AS aq, flatten(list(models)) AS loaded FROM ep WHERE healthy GROUP BY pool),
    de AS (SELECT * FROM {values(DESTINATIONS, "route, position, pool, weight, queue_op, queue_value, replica_op, replica_value, require_loaded")}),
    el AS (SELECT m.event_id, d.pool, row_number() OVER (PARTITION BY m.event_id ORDER BY d.weight DESC, d.position) AS n FROM m JOIN de d ON d.route = m.route JOIN st ON st.pool = d.pool
        WHERE {_OPS('d.queue_op', 'd.queue_value', 'st.aq')} AND {_OPS('d.replica_op', 'd.replica_value', 'st.replicas')} AND (NOT d.require_loaded OR list_contains(st.loaded, m.model))),
    c AS (SELECT m.*, el.pool AS destination FROM m LEFT JOIN el ON el.event_id = m.event_id AND el.n = 1)"""


def _fnv_sql(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(generate_series(1, strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::HUGEINT)), lambda h, b: ((xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 16777619) % 4294967296)::HUGEINT)"


_KEYS = f"{_REQ}, {_EP}, k AS (SELECT DISTINCT model, ['fast', 'batch', 'gone'][event_id % 3 + 1] AS pool FROM req)"
_CAND = f"""{_KEYS},
    wm AS (SELECT k.model, k.pool, e.pool AS home, e.address, e.connections, e.queue_depth FROM k JOIN ep e ON e.healthy AND list_contains(e.models, k.model)),
    nr AS (SELECT model, pool, address, connections, queue_depth FROM (SELECT *, max((home = pool)::INT) OVER (PARTITION BY model, pool) AS any_home FROM wm) WHERE any_home = 0 OR home = pool),
    ca AS (SELECT * FROM nr UNION ALL SELECT k.model, k.pool, e.address, e.connections, e.queue_depth FROM k JOIN ep e ON e.healthy AND e.pool = k.pool WHERE NOT EXISTS (SELECT 1 FROM wm WHERE wm.model = k.model AND wm.pool = k.pool))"""
ORACLE_SQL = {
    "route_match": f"WITH {_MATCH} SELECT event_id, route FROM m",
    "route_destination": f"WITH {_DEST} SELECT event_id, route, destination FROM c",
    "pool_resolution": f"""WITH {_DEST}, f AS (SELECT * FROM {values(FALLBACKS, "route, action, redirect_pool, status_code, message, retry_after")}),
        j AS (SELECT c.*, f.action, f.redirect_pool, f.status_code, f.message, f.retry_after, c.route IS NOT NULL AND c.destination IS NULL AND coalesce(f.action = 'reject', false) AS rejected,
                c.route IS NOT NULL AND c.destination IS NULL AND coalesce(f.action = 'redirect', false) AS redirected FROM c LEFT JOIN f ON f.route = c.route)
        SELECT event_id, CASE WHEN rejected THEN coalesce(status_code::INT, 503) ELSE 200 END AS status, CASE WHEN rejected THEN message END AS message, CASE WHEN rejected THEN coalesce(retry_after::INT, 0) ELSE 0 END AS retry_after,
            CASE WHEN NOT rejected THEN coalesce(destination, CASE WHEN redirected THEN redirect_pool END, nullif(pool_header, ''), 'default') END AS pool,
            coalesce(nullif(workload_header, ''), CASE WHEN operation IN ('embed', 'rerank') THEN 'read-heavy' WHEN operation = 'chunk' THEN 'write-heavy' ELSE 'general' END) AS workload FROM j""",
    "endpoint_hash_affinity": f"""WITH {_CAND}, sc AS (SELECT *, row_number() OVER (PARTITION BY model, pool ORDER BY xor(({_fnv_sql('model')})::UBIGINT, ({_fnv_sql('address')})::UBIGINT), address) AS n FROM ca),
        le AS (SELECT *, row_number() OVER (PARTITION BY model, pool ORDER BY connections, address) AS r FROM sc WHERE n <= 3) SELECT model, pool, address FROM le WHERE r = 1""",
    "endpoint_least_loaded": f"WITH {_CAND} SELECT model, pool, address FROM (SELECT *, row_number() OVER (PARTITION BY model, pool ORDER BY connections, address) AS r FROM ca) WHERE r = 1",
    "endpoint_queue_aware": f"WITH {_CAND} SELECT model, pool, coalesce(min(CASE WHEN queue_depth < 50 THEN address END), arg_min(address, {{'c': connections, 'a': address}})) AS address FROM ca GROUP BY 1, 2",
    "threshold_parse": "SELECT text, op, value FROM " + values(
        [(">50", ">", 50.0), (">=100", ">=", 100.0), ("<10", "<", 10.0), ("==3", "==", 3.0), ("7", "==", 7.0), (">100ms", ">", 0.1), ("<2s", "<", 2.0), ("=5", "==", 5.0), ("1e3", "==", 13.0), (">50%", ">", 50.0),
         ("abc", "==", 0.0), ("1.5.2", "==", 1.52), ("<-4", "<", -4.0), (" >= 20ms ", ">=", 0.02), ("", "==", 0.0)], "text, op, value").replace("FROM (VALUES", "FROM (VALUES", 1),
    "time_window": "SELECT event_id, " + ", ".join(_window_sql("ts", f"'{s}'", f"'{e}'", f"{d}::INT[]") + f" AS w{k}" for k, (s, e, d) in enumerate(CLOCKS)) + " FROM events",
    "fnv32a": f"WITH {_REQ}, t AS (SELECT DISTINCT tenant FROM req) SELECT tenant, ({_fnv_sql('tenant')})::BIGINT AS hash FROM t",
    "endpoint_registry": "SELECT 'http://e' || user_id AS address, arg_min(event_type, event_id) AS pool, max(event_id) AS last_seen FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'",
    "endpoint_health": "SELECT 'http://e' || user_id AS address, coalesce(last(CASE WHEN event_type = 'error' THEN 500 WHEN event_type <> 'view' THEN 200 END ORDER BY event_id) = 200, false) AS healthy FROM events GROUP BY 1",
    "route_order": "SELECT (row_number() OVER (ORDER BY priority DESC, name) - 1)::INT AS place, name FROM " + values(ROUTES, "name, priority, o, m, t, s, e, d"),
    "retry_statuses": "SELECT '5xx' AS pattern, unnest(generate_series(500, 599))::INT AS status UNION ALL SELECT '4xx', unnest(generate_series(400, 499))::INT UNION ALL SELECT '6xx', unnest(generate_series(600, 699))::INT",
    "int_clamp": "SELECT o_orderkey, trunc(greatest(least(o_totalprice * (o_orderkey % 9 - 4) * 10000, 2147483647.0), -2147483648.0))::INT AS clamped FROM orders",
}
