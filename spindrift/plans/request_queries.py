"""Request and registry queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import registry as G
from spindrift.operators import requests as Q
from spindrift.plans.literals import frame, values
from spindrift.sources.content import data_uri, refused
from spindrift.sources.tables import table

MODELS = [("mini", ["text/plain"]), ("pair", ["text/plain", "image/png"])]
#: Bodies by document number; the number decides the shape, the text is the document's.
EMBED_BODY = """CASE doc_id % 8 WHEN 0 THEN concat('{"model":"mini","input":', q, '}') WHEN 1 THEN concat('{"model":"pair","input":[', q, ',', q, ']}')
    WHEN 2 THEN concat('{"model":"mini","input":[{"type":"text","text":', q, '},{"type":"image_url","image_url":{"url":"data:image/png;base64,AAAA"}}]}')
    WHEN 3 THEN '{"model":"mini","input":[]}' WHEN 4 THEN concat('{"model":"nope","input":', q, '}') WHEN 5 THEN concat('{"input":', q, '}') WHEN 6 THEN '{"model":"mini","input":[1,2]}' ELSE 'not json' END"""
EMBED_STATUS = "CASE doc_id % 8 WHEN 0 THEN (CASE WHEN text = '' THEN 400 ELSE 200 END) WHEN 1 THEN 200 WHEN 2 THEN 400 WHEN 3 THEN 400 WHEN 4 THEN 404 ELSE 400 END"
RERANK_BODY = """CASE doc_id % 6 WHEN 0 THEN concat('{"model":"mini","query":"q","prompts":[', q, ']}') WHEN 1 THEN '{"model":"mini","query":"q","prompts":[]}' WHEN 2 THEN concat('{"model":"mini","prompts":[', q, ']}')
    WHEN 3 THEN concat('{"query":"q","prompts":[', q, ']}') WHEN 4 THEN concat('{"model":"other","query":"q","prompts":[', q, ']}') ELSE '{' END"""
CHUNK_BODY = """CASE doc_id % 4 WHEN 0 THEN concat('{"text":', q, ',"config":{"model":"m","target_tokens":40,"overlap_tokens":-3}}') WHEN 1 THEN concat('{"text":', q, ',"config":{"max_chunks":7,"threshold":0.25,"separator":"--"}}') WHEN 2 THEN '{"text":""}' ELSE '' END"""


def _bodies(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    return table(spark, sf_dir, "documents").select("doc_id", "text", quoted.alias("q")).select("doc_id", "text", F.expr(body).alias("body"))


def _models(spark: SparkSession) -> DataFrame:
    return frame(spark, MODELS, "name string, mime array<string>")


def union_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every embed body: how many, and their characters."""
    items = Q.parse_input(Q._raw_input(F.col("body")))
    d = _bodies(spark, sf_dir, EMBED_BODY).select("doc_id", items.alias("i"))
    return d.select("doc_id", F.coalesce(F.size(F.when(F.col("i").isNotNull(), F.col("i"))), F.lit(0)).alias("n_items"),
                    F.coalesce(F.aggregate("i", F.lit(0), lambda a, x: a + F.coalesce(F.char_length(x["text"]), F.lit(0))), F.lit(0)).cast("long").alias("n_chars"))


def request_validation_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_embed(_bodies(spark, sf_dir, EMBED_BODY), _models(spark)).select("doc_id", "status")


def request_validation_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_chunk(_bodies(spark, sf_dir, CHUNK_BODY)).select("doc_id", "status", "error")


def request_validation_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_rerank(_bodies(spark, sf_dir, RERANK_BODY), _models(spark)).select("doc_id", "status", "error")


def chunk_config_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _bodies(spark, sf_dir, CHUNK_BODY).select("doc_id", Q.chunk_options(F.col("body")).alias("o"))
    return d.select("doc_id", "o.*")


def mime_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violating item positions of the bodies that parse, per model."""
    d = _bodies(spark, sf_dir, EMBED_BODY).select("doc_id", Q.parse_input(Q._raw_input(F.col("body"))).alias("items")).where(F.col("items").isNotNull())
    return d.crossJoin(F.broadcast(_models(spark))).select("doc_id", "name", F.array_join(Q.mime_violations(F.col("items"), F.col("mime")).cast("array<string>"), ",").alias("bad"))


REFS = [("bge-small-en-v1.5-i8",), ("m-i8-st",), ("x-bf16",), ("plain",), ("a-f32",), ("-i4",), ("b-f16-i8",), ("hf:org/repo-f16",)]


def model_ref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, REFS, "ref string").select("ref", G.model_ref(F.col("ref")).alias("r"), F.coalesce(G.hub_ref(F.col("ref")), F.lit("")).alias("hub")).select("ref", "r.name", "r.variant", "hub")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of made-up models, from ``part``."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('model', p_size) AS model", "CASE p_size % 3 WHEN 0 THEN 'embedder' WHEN 1 THEN 'chunker' ELSE 'reranker' END AS type",
        "CASE p_partkey % 9 WHEN 0 THEN 'model.onnx' WHEN 1 THEN 'model_f16.onnx' WHEN 2 THEN 'model_i8.onnx' WHEN 3 THEN 'model_i8-st.onnx' WHEN 4 THEN 'tokenizer.json' WHEN 5 THEN 'visual_model.onnx' WHEN 6 THEN 'text_model.onnx' WHEN 7 THEN 'config.json' ELSE 'other.onnx' END AS file",
        "CAST(p_retailprice * 1000 * (p_partkey % 13 + 1) * (p_size % 5 + 1) AS BIGINT) AS size")


def variant_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.discover_variants(_files(spark, sf_dir))


def list_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.discover_variants(_files(spark, sf_dir)).select("type", F.col("registry_name").alias("name"))
    return G.list_models(found).select(*[F.array_join(f"{t}s", ",").alias(f"{t}s") for t in G.TYPES])


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.readiness(G.discover_variants(_files(spark, sf_dir)).select("type", F.col("registry_name").alias("name"))).select(F.col("models").cast("long").alias("models"), "status")


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, size = "concat('tok', p_partkey % 3, '.json')", "CAST(p_retailprice AS BIGINT)"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"""named_struct('schemaVersion', CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END, 'name', CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('m', p_partkey) END,
        'type', CASE p_partkey % 7 WHEN 0 THEN 'Embedders' WHEN 1 THEN 'reranker' WHEN 2 THEN 'widget' ELSE 'chunker' END,
        'files', CASE p_partkey % 5 WHEN 0 THEN array(named_struct('name', {file}, 'digest', 'sha256:aa', 'size', {size})) WHEN 1 THEN array(named_struct('name', 'model.onnx', 'digest', 'md5:aa', 'size', {size}))
            ELSE array(named_struct('name', {file}, 'digest', 'sha256:aa', 'size', {size}), named_struct('name', 'model.onnx', 'digest', 'sha256:bb', 'size', {size} * 10)) END,
        'variants', CASE WHEN p_partkey % 4 = 0 THEN map('f16', named_struct('name', 'model_f16.onnx', 'digest', 'sha256:cc', 'size', {size} * 5)) WHEN p_partkey % 4 = 1 THEN map('x9', named_struct('name', 'q', 'digest', 'sha256:dd', 'size', {size})) END) AS m""")


def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifests(spark, sf_dir).select("p_partkey", G.validate_manifest(F.col("m")).alias("v")).select("p_partkey", "v.status", F.coalesce("v.error", F.lit("")).alias("error"))


def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _manifests(spark, sf_dir).where(G.validate_manifest(F.col("m"))["status"] == 200).select("m.*")
    plan = G.download_plan(good, F.array(F.lit("f32"), F.lit("f16")))
    return plan.groupBy("model").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.local_sizes(_files(spark, sf_dir)).select("model", "size", G.format_bytes(F.col("size")).alias("shown"))


def multimodal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.multimodal_models(_files(spark, sf_dir))


def description_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", G.ellipsis(F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_name"), 30).alias("shown"))


def route_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    refs = F.transform(F.sequence(F.lit(1).cast("long"), F.col("o_orderkey") % 3 + 1), lambda k: F.concat(F.lit("p"), (F.col("o_custkey") * k % 97)))
    routes = o.select(F.col("o_orderkey").alias("route"), F.concat(F.lit("ns"), F.col("o_custkey") % 4).alias("namespace"), refs.alias("pools"))
    pools = table(spark, sf_dir, "customer").select(F.concat(F.lit("ns"), F.col("c_custkey") % 4).alias("namespace"), F.concat(F.lit("p"), F.col("c_custkey")).alias("name"))
    return G.active_routes(routes, pools)


def pool_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", G.pool_phase(F.col("p_partkey") % 7 != 0, F.col("p_size") % 4, F.col("p_partkey") % 4).alias("phase"))


def tpu_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, [("2x4",), ("",), ("1x1x1",), ("axb",), ("16x16",), ("4",)], "topology string").select("topology", G.tpu_count(F.col("topology")).alias("chips"))


def preload_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").selectExpr("concat('pool', p_size % 5) AS pool", "concat('m', p_partkey) AS name", "CASE p_partkey % 3 WHEN 0 THEN 'i8' WHEN 1 THEN '' ELSE NULL END AS variant")
    return G.preload_groups(m)


URIS = [("data:text/plain;base64,aGVsbG8=",), ("data:,a%20b",), ("https://example.org/a.png",), ("http://10.1.2.3/x",), ("http://localhost/x",), ("http://172.20.0.1/",), ("http://172.40.0.1/",), ("file:///etc/passwd",), ("ftp://example.org/",)]


def content_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, URIS, "uri string").select("uri", refused(F.col("uri")).alias("why"), data_uri(F.col("uri")).alias("d"))
    return d.select("uri", F.coalesce("why", F.lit("")).alias("refused"), F.coalesce("d.mime", F.lit("")).alias("mime"), F.coalesce(F.decode("d.content", "utf-8"), F.lit("")).alias("content"))


QUERIES = {
    "union_parse": union_parse, "request_validation_embed": request_validation_embed, "request_validation_chunk": request_validation_chunk, "request_validation_rerank": request_validation_rerank,
    "chunk_config_defaults": chunk_config_defaults, "mime_check": mime_check, "model_ref_parse": model_ref_parse, "variant_discovery": variant_discovery, "list_models": list_models, "readiness": readiness,
    "manifest_validate": manifest_validate, "download_plan": download_plan, "format_bytes": format_bytes, "multimodal_models": multimodal, "description_ellipsis": description_ellipsis, "route_active": route_active,
    "pool_phase": pool_phase, "tpu_count": tpu_count, "preload_groups": preload_groups, "content_policy": content_policy}

_FILES = """f AS (SELECT 'model' || p_size AS model, CASE p_size % 3 WHEN 0 THEN 'embedder' WHEN 1 THEN 'chunker' ELSE 'reranker' END AS type,
    CASE p_partkey % 9 WHEN 0 THEN 'model.onnx' WHEN 1 THEN 'model_f16.onnx' WHEN 2 THEN 'model_i8.onnx' WHEN 3 THEN 'model_i8-st.onnx' WHEN 4 THEN 'tokenizer.json' WHEN 5 THEN 'visual_model.onnx' WHEN 6 THEN 'text_model.onnx' WHEN 7 THEN 'config.json' ELSE 'other.onnx' END AS file,
    trunc(p_retailprice * 1000 * (p_partkey % 13 + 1) * (p_size % 5 + 1))::BIGINT AS size FROM part)"""
_VARIANTS = f"""WITH {_FILES}, k AS (SELECT * FROM (VALUES ('model.onnx', ''), ('model.onnx', 'f32'), ('model_f16.onnx', 'f16'), ('model_i8.onnx', 'i8'), ('model_i8-st.onnx', 'i8-st')) AS t(file, variant)),
    v AS (SELECT DISTINCT model, type, variant, CASE WHEN variant = '' THEN model ELSE model || '-' || variant END AS registry_name FROM f JOIN k USING (file))"""
_MAN = "CASE WHEN p_partkey % 11 = 0 THEN 'unsupported schema version' WHEN p_partkey % 13 = 0 THEN 'name is required' WHEN p_partkey % 7 = 2 THEN 'invalid type' WHEN p_partkey % 5 = 1 THEN 'digest must start with sha256:' WHEN p_partkey % 5 = 0 THEN 'model.onnx is required' WHEN p_partkey % 4 = 1 THEN 'unknown variant' ELSE '' END"
_ENDINGS = "CASE WHEN size >= 1024*1024*1024 THEN printf('%.1f GB', size / (1024*1024*1024.0)) WHEN size >= 1024*1024 THEN printf('%.1f MB', size / (1024*1024.0)) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE size || ' B' END"
ORACLE_SQL = {
    "union_parse": "SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 4, 5) AND text <> '' THEN 1 WHEN doc_id % 8 IN (1, 2) THEN 2 ELSE 0 END::INT AS n_items, CASE WHEN doc_id % 8 IN (0, 2, 4, 5) THEN length(text) WHEN doc_id % 8 = 1 THEN 2 * length(text) ELSE 0 END::BIGINT AS n_chars FROM documents",
    "request_validation_embed": f"SELECT doc_id, ({EMBED_STATUS})::INT AS status FROM documents",
    "request_validation_chunk": "SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND text <> '' THEN 200 ELSE 400 END::INT AS status, CASE WHEN doc_id % 4 = 3 THEN 'decoding request' WHEN doc_id % 4 = 2 OR text = '' THEN 'text is required' END AS error FROM documents",
    "request_validation_rerank": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 200 WHEN 4 THEN 404 ELSE 400 END::INT AS status, CASE doc_id % 6 WHEN 1 THEN 'prompts are required' WHEN 2 THEN 'query is required' WHEN 3 THEN 'model is required' WHEN 4 THEN 'model not found' WHEN 5 THEN 'decoding request' END AS error FROM documents",
    "chunk_config_defaults": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'm' ELSE 'fixed-bert-tokenizer' END AS model, CASE WHEN doc_id % 4 = 0 THEN 40 ELSE 500 END::INT AS target_tokens, 50::INT AS overlap_tokens, CASE WHEN doc_id % 4 = 1 THEN '--' ELSE chr(10) || chr(10) END AS separator, CASE WHEN doc_id % 4 = 1 THEN 7 ELSE 50 END::INT AS max_chunks, CASE WHEN doc_id % 4 = 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS threshold FROM documents",
    "mime_check": "SELECT doc_id, name, CASE WHEN doc_id % 8 = 2 AND name = 'mini' THEN '1' ELSE '' END AS bad FROM documents, (VALUES ('mini'), ('pair')) AS t(name) WHERE doc_id % 8 IN (1, 2) OR (doc_id % 8 IN (0, 4, 5) AND text <> '')",
    "model_ref_parse": "SELECT ref, CASE WHEN v = '' THEN ref ELSE ref[1:length(ref) - length(v) - 1] END AS name, v AS variant, CASE WHEN ref LIKE 'hf:%' THEN ref[4:] ELSE '' END AS hub FROM (SELECT ref, regexp_extract(ref, '-(f32|f16|bf16|i8-st|i8|i4)$', 1) AS v FROM " + values(REFS, "ref") + ")",
    "variant_discovery": _VARIANTS + " SELECT * FROM v",
    "list_models": _VARIANTS + " SELECT " + ", ".join(f"coalesce(string_agg(registry_name, ',' ORDER BY registry_name) FILTER (type = '{t}'), '') AS {t}s" for t in G.TYPES) + " FROM v",
    "readiness": _VARIANTS + " SELECT count(*) AS models, CASE WHEN count(*) > 0 THEN 200 ELSE 503 END::INT AS status FROM v",
    "manifest_validate": f"SELECT p_partkey, CASE WHEN e = '' THEN 200 ELSE 400 END::INT AS status, e AS error FROM (SELECT p_partkey, {_MAN} AS e FROM part)",
    "download_plan": f"""WITH g AS (SELECT p_partkey, trunc(p_retailprice)::BIGINT AS s, p_partkey % 4 = 0 AS f16 FROM part WHERE {_MAN} = '')
        SELECT 'm' || p_partkey AS model, CASE WHEN f16 THEN 3 ELSE 2 END::BIGINT AS n_files, (s * CASE WHEN f16 THEN 16 ELSE 11 END)::BIGINT AS size, 'model.onnx' || CASE WHEN f16 THEN ',model_f16.onnx' ELSE '' END || ',tok' || p_partkey % 3 || '.json' AS files FROM g""",
    "format_bytes": f"WITH {_FILES}, s AS (SELECT model, sum(CASE WHEN file = 'model.onnx' THEN 2 * size WHEN file IN ('other.onnx', 'visual_model.onnx', 'text_model.onnx') THEN 0 ELSE size END)::BIGINT AS size FROM f GROUP BY 1) SELECT model, size, {_ENDINGS} AS shown FROM s",
    "multimodal_models": f"WITH {_FILES} SELECT model FROM f WHERE file IN ('visual_model.onnx', 'text_model.onnx') GROUP BY 1 HAVING count(DISTINCT file) = 2",
    "description_ellipsis": "SELECT p_partkey, CASE WHEN strlen(t) > 30 THEN t[1:27] || '...' ELSE t END AS shown FROM (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_name) AS t FROM part)",
    "route_active": """WITH r AS (SELECT o_orderkey AS route, 'ns' || o_custkey % 4 AS namespace, o_custkey, unnest(generate_series(1, o_orderkey % 3 + 1)) AS k FROM orders),
        p AS (SELECT DISTINCT 'ns' || c_custkey % 4 AS namespace, 'p' || c_custkey AS name FROM customer)
        SELECT r.namespace, r.route, bool_and(p.name IS NOT NULL) AS active FROM r LEFT JOIN p ON p.namespace = r.namespace AND p.name = 'p' || (r.o_custkey * r.k % 97) GROUP BY 1, 2""",
    "pool_phase": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Pending' WHEN p_partkey % 4 = p_size % 4 THEN 'Running' WHEN p_partkey % 4 > 0 THEN 'Scaling' ELSE 'Pending' END AS phase FROM part",
    "tpu_count": "SELECT topology, chips::INT AS chips FROM (VALUES ('2x4', 8), ('', 4), ('1x1x1', 4), ('axb', 4), ('16x16', 256), ('4', 4)) AS t(topology, chips)",
    "preload_groups": """WITH m AS (SELECT 'pool' || p_size % 5 AS pool, 'm' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'i8' ELSE 'f32' END AS variant FROM part),
        g AS (SELECT pool, variant, string_agg(name, ' ' ORDER BY name) AS names FROM m GROUP BY 1, 2) SELECT pool, string_agg('pull --variants ' || variant || ' ' || names, ' && ' ORDER BY variant) AS command FROM g GROUP BY 1""",
    "content_policy": "SELECT * FROM " + values([
        ("data:text/plain;base64,aGVsbG8=", "", "text/plain", "hello"), ("data:,a%20b", "", "text/plain", "a b"), ("https://example.org/a.png", "", "", ""), ("http://10.1.2.3/x", "private address", "", ""), ("http://localhost/x", "private address", "", ""),
        ("http://172.20.0.1/", "private address", "", ""), ("http://172.40.0.1/", "", "", ""), ("file:///etc/passwd", "", "", ""), ("ftp://example.org/", "unknown scheme", "", "")], "uri, refused, mime, content"),
}
