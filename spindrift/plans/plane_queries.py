"""Control-plane queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import udtf
from spindrift.operators import registry as G
from spindrift.operators.metrics import counters
from spindrift.operators.routing import latest_endpoints
from spindrift.sources import control_plane as P
from spindrift.sources.tables import table

ROUTE_BODY = """concat('{"metadata":{"namespace":"ns', p_size % 3, '","name":"r', p_partkey, '"},"spec":{', CASE WHEN p_partkey % 2 = 0 THEN concat('"priority":', p_partkey % 500, ',') ELSE '' END,
    '"match":{"models":["m', p_size, '*"]},"route":[{"pool":"a","condition":{"queueDepth":"<', p_size, '"}},{"pool":"b","weight":', p_size, '}]',
    CASE WHEN p_partkey % 3 = 0 THEN concat(',"rateLimiting":{"requestsPerSecond":', p_size, '}') ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ',"retry":{"retryOn":["5xx"]}' ELSE '' END, '}}')"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_routes(table(spark, sf_dir, "part").select(F.expr(ROUTE_BODY).alias("body")))


def route_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("name", "priority", F.get("models", F.lit(0)).alias("model"), F.coalesce("limiter.rate", F.lit(0)).alias("rate"), F.coalesce("limiter.burst", F.lit(0)).alias("burst"),
                                         F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce(F.size("retry_statuses"), F.lit(0)).alias("n_retry"))


def route_source_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.destination_rows(_routes(spark, sf_dir)).select("route", "position", "pool", "weight", F.coalesce("queue_op", F.lit("")).alias("queue_op"), F.coalesce("queue_value", F.lit(-1.0)).alias("queue_value"))


def endpoint_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = table(spark, sf_dir, "events").selectExpr(
        "concat('svc-', user_id % 6) AS service", "CASE WHEN user_id % 2 = 0 THEN map('pool', concat('p', user_id % 4)) ELSE map('workload', 'burst') END AS labels",
        "CASE WHEN user_id % 5 = 0 THEN array(named_struct('name', 'metrics', 'port', 1), named_struct('name', 'http', 'port', 8080)) ELSE array(named_struct('name', 'metrics', 'port', 1)) END AS ports",
        "array(named_struct('ready', event_type <> 'error', 'addresses', array(concat('10.0.0.', user_id)))) AS endpoints", "event_id AS ts")
    return latest_endpoints(P.endpoint_updates(slices, "svc-"))


def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("pool"), F.col("user_id") % 4).alias("pool"), F.col("event_type").alias("operation"))
    return P.exposition(counters(log, ["pool", "operation"]), "requests_total", ["pool", "operation"], "requests_total")


def version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.version(spark).select("version")


def remote_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "part").selectExpr("p_name AS name", "CASE WHEN p_size % 2 = 0 THEN 'embedder' ELSE 'chunker' END AS type", "concat_ws(' ', p_name, p_brand, p_type, p_name, p_brand, p_type) AS description", "CAST(p_size AS BIGINT) AS size")
    return G.remote_list(index, "embedder")


def preload_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("node"), (F.col("p_size") % 4 == 0).alias("ok"))
    return G.preload_outcome(tries, "node")


def chunk_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    udtf.register(spark)
    docs = table(spark, sf_dir, "documents")
    return spark.sql("SELECT d.doc_id, c.chunk_id, c.start_char, c.end_char FROM {docs} d, LATERAL chunk_text(d.text, 120, 10, chr(10)) c", docs=docs)


QUERIES = {n.__name__: n for n in (route_source, route_source_destinations, endpoint_source, metrics_exposition, version, remote_list, preload_outcome, chunk_udtf)}


def _udtf_sql() -> str:
    from spindrift.plans.chunk_queries import CONFIGS, fixed_sql

    return fixed_sql(CONFIGS["chunk_fixed_newline_sep"]) + """, numbered AS (SELECT k, unnest(generate_series(1, len(out))) AS i, out FROM chunks)
        SELECT k AS doc_id, (i - 1)::INT AS chunk_id, out[i].start_char AS start_char, out[i].end_char AS end_char FROM numbered"""


ORACLE_SQL = {
    "route_source": """SELECT 'ns' || p_size % 3 || '/r' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 500 ELSE 100 END::INT AS priority, 'm' || p_size || '*' AS model,
        CASE WHEN p_partkey % 3 = 0 AND p_size > 0 THEN p_size ELSE 0 END::INT AS rate, CASE WHEN p_partkey % 3 = 0 AND p_size > 0 THEN p_size ELSE 0 END::INT AS burst,
        CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END::INT AS attempts, CASE WHEN p_partkey % 5 = 0 THEN 100 ELSE 0 END::INT AS n_retry FROM part""",
    "route_source_destinations": """SELECT 'ns' || p_size % 3 || '/r' || p_partkey AS route, 0::INT AS position, 'a' AS pool, 100::INT AS weight, '<' AS queue_op, p_size::DOUBLE AS queue_value FROM part
        UNION ALL SELECT 'ns' || p_size % 3 || '/r' || p_partkey, 1, 'b', p_size::INT, '', -1.0 FROM part""",
    "endpoint_source": """WITH u AS (SELECT 'http://10.0.0.' || user_id || ':' || CASE WHEN user_id % 5 = 0 THEN 8080 ELSE 11433 END AS address, CASE WHEN user_id % 2 = 0 THEN 'p' || user_id % 4 ELSE (user_id % 6)::VARCHAR END AS pool, event_type <> 'error' AS ready, event_id AS ts FROM events)
        SELECT address, arg_min(pool, ts) AS pool, max(ts) AS last_seen FROM u GROUP BY 1 HAVING arg_max(ready, ts)""",
    "metrics_exposition": "SELECT 'requests_total{pool=\"pool' || user_id % 4 || '\",operation=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY user_id % 4, event_type",
    "version": "SELECT '0.1.0' AS version",
    "remote_list": "SELECT p_name AS name, 'embedder' AS type, CASE WHEN strlen(t) > 50 THEN t[1:47] || '...' ELSE t END AS description, p_size || ' B' AS size FROM (SELECT p_name, p_size, concat_ws(' ', p_name, p_brand, p_type, p_name, p_brand, p_type) AS t FROM part WHERE p_size % 2 = 0)",
    "preload_outcome": "SELECT p_partkey % 400 AS node, count(*) AS asked, count(*) FILTER (p_size % 4 = 0) AS loaded, count(*) FILTER (p_size % 4 = 0) = 0 AS failed FROM part GROUP BY 1",
    "chunk_udtf": _udtf_sql(),
}
