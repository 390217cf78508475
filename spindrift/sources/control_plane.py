"""Control-plane objects as tables: route objects, endpoint slices, metric exposition, version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.routing import clamp_int32, expand_status, parse_threshold

WINDOW = "struct<start:string,end:string,days:array<int>>"
ROUTE_OBJECT = (
    "struct<metadata:struct<namespace:string,name:string>,spec:struct<priority:double,"
    f"match:struct<operations:array<string>,models:array<string>,headers:map<string,struct<exact:string,prefix:string,regex:string>>,source:struct<tables:array<string>>,timeWindow:{WINDOW}>,"
    f"route:array<struct<pool:string,weight:double,condition:struct<queueDepth:string,availableReplicas:string,latency:string,modelLoaded:boolean,timeOfDay:{WINDOW}>>>,"
    "fallback:struct<action:string,errorResponse:struct<statusCode:double,message:string,retryAfter:double>,redirectPool:string>,"
    "rateLimiting:struct<requestsPerSecond:double,burstSize:double,perModel:boolean>,retry:struct<attempts:double,retryOn:array<string>>>>")
#: The port of an endpoint that names none; a fixed value.
DEFAULT_PORT = 11433


def _number(value: Column, default: int) -> Column:
    return F.coalesce(clamp_int32(value), F.lit(default))


def parse_routes(objects: DataFrame, body: str = "body") -> DataFrame:
    """Route objects as JSON to rows for ``match_routes``, with destinations, fallback, limiter and retry as nested columns.

    Priority and weight default to 100, the burst to the rate, retries to 3. An object without a spec gives no row.
    """
    o = objects.select(F.from_json(body, ROUTE_OBJECT).alias("o")).where(F.col("o.spec").isNotNull())
    m, fb, limit, retry = (F.col(f"o.spec.{n}") for n in ("match", "fallback", "rateLimiting", "retry"))

    def condition(text: Column, name: str) -> Column:
        return F.when(text.isNotNull(), parse_threshold(text)).alias(name)

    destinations = F.transform("o.spec.route", lambda d, k: F.struct(
        k.alias("position"), d["pool"].alias("pool"), _number(d["weight"], 100).alias("weight"), condition(d["condition"]["queueDepth"], "queue_depth"),
        condition(d["condition"]["availableReplicas"], "replicas"), condition(d["condition"]["latency"], "latency"),
        F.coalesce(d["condition"]["modelLoaded"], F.lit(False)).alias("require_loaded"), d["condition"]["timeOfDay"].alias("window")))
    rate = clamp_int32(limit["requestsPerSecond"])
    return o.select(
        F.concat_ws("/", F.coalesce("o.metadata.namespace", F.lit("")), F.coalesce("o.metadata.name", F.lit(""))).alias("name"), _number(F.col("o.spec.priority"), 100).alias("priority"),
        m["operations"].alias("operations"), m["models"].alias("models"), m["headers"].alias("headers"), m["source"]["tables"].alias("source_tables"), m["timeWindow"].alias("window"), destinations.alias("destinations"),
        F.when(fb.isNotNull(), F.struct(fb["action"].alias("action"), fb["redirectPool"].alias("redirect_pool"), _number(fb["errorResponse"]["statusCode"], 503).alias("status_code"),
                                        fb["errorResponse"]["message"].alias("message"), clamp_int32(fb["errorResponse"]["retryAfter"]).alias("retry_after"))).alias("fallback"),
        F.when(rate > 0, F.struct(rate.alias("rate"), F.coalesce(clamp_int32(limit["burstSize"]), rate).alias("burst"), F.coalesce(limit["perModel"], F.lit(False)).alias("per_model"))).alias("limiter"),
        F.when(retry.isNotNull(), _number(retry["attempts"], 3)).alias("attempts"), F.flatten(F.transform(retry["retryOn"], expand_status)).alias("retry_statuses"))


def destination_rows(routes: DataFrame) -> DataFrame:
    """Parsed routes to the destination table of ``choose_destination``."""
    d = routes.select(F.col("name").alias("route"), F.inline("destinations"))
    return d.select("route", "position", "pool", "weight", F.col("queue_depth.op").alias("queue_op"), F.col("queue_depth.value").alias("queue_value"), F.col("replicas.op").alias("replica_op"), F.col("replicas.value").alias("replica_value"), "require_loaded", "window")


def endpoint_updates(slices: DataFrame, service_prefix: str = "") -> DataFrame:
    """Slices (service, labels, ports, endpoints, ts) to registry updates (address, pool, workload, ready, ts).

    The pool is its label, else the service name without the prefix; the port is the first one named http or api, else the default.
    """
    pool = F.coalesce(F.nullif(F.element_at("labels", "pool"), F.lit("")), F.regexp_replace("service", f"^\\Q{service_prefix}\\E", "") if service_prefix else F.col("service"))
    named = F.filter("ports", lambda p: p["name"].isin("http", "api"))
    port = F.coalesce(F.get(named, F.lit(0))["port"], F.lit(DEFAULT_PORT))
    each = slices.select(pool.alias("pool"), F.coalesce(F.nullif(F.element_at("labels", "workload"), F.lit("")), F.lit("general")).alias("workload"), port.alias("port"), "ts", F.explode("endpoints").alias("e"))
    flat = each.select("pool", "workload", "port", "ts", F.coalesce("e.ready", F.lit(False)).alias("ready"), F.explode("e.addresses").alias("ip"))
    return flat.select(F.concat(F.lit("http://"), "ip", F.lit(":"), "port").alias("address"), "pool", "workload", "ready", "ts")


def exposition(counts: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Counter rows as exposition lines: ``name{label="value",...} number``."""
    quoted = [F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels]
    return counts.select(F.concat(F.lit(metric + "{"), F.concat_ws(",", *quoted), F.lit("} "), F.col(value).cast("string")).alias("line"))


def version(spark: SparkSession, number: str = "0.1.0") -> DataFrame:
    return spark.sql(f"SELECT '{number}' AS version, version() AS engine")
