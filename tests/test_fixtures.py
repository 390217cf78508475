"""Hand-worked cases: chunk traces, thresholds, hashing, windows, buckets, breaker, codec, specs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions.hashing import fnv32a
from spindrift.functions.text import from_hex
from spindrift.functions.vectors import cosine, l2_normalize, spearman
from spindrift.operators import control as C
from spindrift.operators import registry as G
from spindrift.operators import requests as Q
from spindrift.operators import routing as R
from spindrift.operators.chunking import ChunkConfig, cut_at_boundaries, join_to_target
from spindrift.functions.text import to_hex
from spindrift.sources.vector_stream import deserialize, serialize


def words_chunks(spark, monkeypatch, text, config):
    """Fixed chunks with white-space words as tokens, the unit of the worked traces."""
    from spindrift.operators import chunking

    monkeypatch.setattr(chunking, "len4", lambda raw: F.size(F.filter(F.split(F.decode(F.unhex(F.regexp_replace(raw, "^(80|A9|C3$)+", "")), "utf-8"), r"\s+"), lambda w: w != "")).cast("long"))
    out = chunking.fixed_chunks_hex(F.col("text"), config)
    row = spark.createDataFrame([(text,)], "text string").select(F.transform(out, lambda c: F.struct(from_hex(c["text"]).alias("t"), c["start_char"].alias("s"), c["end_char"].alias("e"))).alias("c")).first()
    return [(r["t"], r["s"], r["e"]) for r in row["c"]]


@pytest.mark.parametrize("text, target, overlap, most, want", [
    ("one two\n\nthree four\n\nfive six", 4, 1, 50, [("one two\n\nthree four", 0, 19), ("four \n\nfive six", 21, 36)]),
    ("one two\nthree four\nfive six", 4, 1, 50, [("one two\n\nthree four", 0, 19), ("four \n\nfive six", 21, 36)]),
    ("One two. Three four. Five six.", 4, 1, 50, [("One two.\n\nThree four.", 0, 21), ("our. \n\nFive six.", 23, 39)]),
    ("one two\n\nthree four\n\nfive six", 2, 1, 1, [("one two", 0, 7)]),
    ("  \n ", 4, 1, 50, [("", 0, 4)]),
    ("éé éé\n\nb b b", 3, 1, 50, [("éé éé", 0, 9), ("éé \n\nb b b", 11, 23)]),
    ("a b c d e f", 2, 1, 50, [("a b c d e f", 0, 11)]),
    ("a b\n\n\n\n c d\n\n", 50, 1, 50, [("a b\n\nc d", 0, 8)]),
    ("one two three\n\nfour five\n\nsix", 3, 50, 50, [("one two three", 0, 13), ("one two three \n\nfour five", 15, 40), ("one two three \n\nfour five \n\nsix", 42, 73)]),
])
def test_fixed_chunk_traces(spark, monkeypatch, text, target, overlap, most, want):
    assert words_chunks(spark, monkeypatch, text, ChunkConfig(target, overlap, "\n\n", most)) == want


@pytest.mark.parametrize("threshold, target, want", [
    (0.5, 500, [("Alpha beta.\n\nGamma delta. Epsilon zeta.", 0, 38)]),
    (0.3, 2, [("Alpha beta.", 0, 11), ("Gamma delta.", 11, 24), ("Epsilon zeta.", 24, 38)]),
    (0.3, 5, [("Alpha beta.\n\nGamma delta.", 0, 24), ("Epsilon zeta.", 24, 38)]),
    (0.95, 500, [("Alpha beta. Gamma delta. Epsilon zeta.", 0, 38)]),
])
def test_boundary_traces(spark, threshold, target, want):
    df = spark.sql("SELECT 'Alpha beta. Gamma delta. Epsilon zeta.' AS text, array(named_struct('entity', 'separator', 'score', 0.9D, 'end', 11), named_struct('entity', 'B-separator', 'score', 0.4D, 'end', 24), named_struct('entity', 'O', 'score', 0.99D, 'end', 30)) AS e")
    pieces = join_to_target(cut_at_boundaries(to_hex(F.col("text")), F.col("e"), ChunkConfig(target, 50, "\n\n", 50, threshold)), target, 50)
    got = df.select(F.transform(pieces, lambda c: F.struct(from_hex(c["text"]).alias("t"), c["start_char"].alias("s"), c["end_char"].alias("e"))).alias("c")).first()["c"]
    assert [(r["t"], r["s"], r["e"]) for r in got] == want


def test_chunk_config_rules():
    assert ChunkConfig(overlap_tokens=-1).overlap_tokens == 50
    with pytest.raises(ValueError):
        ChunkConfig(target_tokens=50).checked()
    assert ChunkConfig.request(0, 0, 0.0, separator="x", overlap_tokens=3) == ChunkConfig()


def test_fnv_and_affinity(spark):
    names = ["hello", "", "bge-small-en-v1.5", "mxbai-rerank-base-v1"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", fnv32a(F.col("n")).alias("h"))
    assert {r["n"]: r["h"] for r in df.collect()} == {"hello": 1335831723, "": 2166136261, "bge-small-en-v1.5": 3636556644, "mxbai-rerank-base-v1": 2861055220}


def test_strict_thresholds(spark):
    df = spark.createDataFrame([("<2s",), ("abc",), (">=1.5",)], "t string").select("t", R.parse_threshold_strict(F.col("t")).alias("p"))
    assert {r["t"]: (r["p"] and tuple(r["p"])) for r in df.collect()} == {"<2s": ("<", 2.0), "abc": None, ">=1.5": (">=", 1.5)}


def test_headers_match_exact_prefix_regex_in_any_case(spark):
    schema = R.ROUTE_SCHEMA
    routes = spark.createDataFrame([("r", 1, [], [], {"x-a": ("v", None, None), "X-B": (None, "p", "z$")}, ["orders"], None)], schema)
    req = spark.createDataFrame([(1, {"X-A": "v", "x-b": "pq"}, "orders"), (2, {"x-a": "w", "x-b": "p"}, "orders"), (3, {"x-a": "v"}, "orders"), (4, {"x-a": "v", "x-b": "az"}, None), (5, {"x-a": "v", "x-b": "az"}, "orders")], "id int, headers map<string,string>, source_table string")
    req = req.withColumn("operation", F.lit("embed")).withColumn("model", F.lit("m")).withColumn("ts", F.lit("2024-01-07 10:00:00").cast("timestamp"))
    assert {r["id"]: r["route"] for r in R.match_routes(req, routes).collect()} == {1: "r", 2: None, 3: None, 4: None, 5: "r"}


def test_token_bucket_and_breaker_steps():
    step = C.bucket_step(1.0, 2)
    assert [step({"t": t})[0] for t in (0, 0, 0, 1.0, 1.5, 2.0)] == [True, True, False, True, False, True]
    b = C.breaker_step()
    assert [b({"t": float(t), "failed": True})[1] for t in range(5)] == ["closed"] * 4 + ["open"]
    assert b({"t": 34.0, "failed": True}) == (False, "open")
    assert b({"t": 35.0, "failed": True}) == (True, "open")
    assert b({"t": 66.0, "failed": False}) == (True, "closed")


def test_queue_step():
    q = C.queue_step(1, 1, 5.0)
    assert q({"t": 0.0, "service": 10.0}) == (200, 0.0)
    assert q({"t": 1.0, "service": 1.0}) == (504, 5.0)
    assert q({"t": 2.0, "service": 1.0}) == (503, 0.0)
    assert q({"t": 7.0, "service": 1.0}) == (200, 3.0)
    assert q({"t": 20.0, "service": 1.0}) == (200, 0.0)
    assert C.queue_step(0)({"t": 0.0, "service": 9.0}) == (200, 0.0)


def test_lru_step():
    s = C.lru_step(2, 100.0, frozenset({"p"}))
    assert [s({"model": m, "t": float(t)}) for m, t in [("a", 0), ("b", 1), ("a", 2), ("c", 3), ("p", 4), ("b", 5), ("b", 200)]] == [
        (False, None), (False, None), (True, None), (False, "b"), (True, None), (False, "a"), (False, None)]


@pytest.mark.parametrize("rows", [[], [[1, 2, 3]], [[1, 2, 3], [4, 5, 6], [7, 8, 9]], [[-1, 0, 1], [-2.5, 0, 2.5]], [[1e-10, 1e10], [3.14159, 2.71828]]])
def test_codec_round_trip(rows):
    assert [list(map(np.float32, r)) for r in deserialize(serialize(rows))] == [list(map(np.float32, r)) for r in rows]


@pytest.mark.parametrize("raw, message", [(b"", "number of vectors"), (b"1234567", "number of vectors"), (struct.pack("<Q", 1), "dimension"), (struct.pack("<QQf", 1, 2, 1.0), "vector 0, dimension 1: EOF")])
def test_codec_errors(raw, message):
    with pytest.raises(ValueError, match=message):
        deserialize(raw)


def test_vectors(spark):
    df = spark.sql("SELECT array(3f, 4f) AS a, array(0f, 0f) AS z, array(1f) AS s")
    r = df.select(l2_normalize(F.col("a")).alias("n"), l2_normalize(F.col("z")).alias("z"), cosine(F.col("a"), F.col("z")).alias("c0"), cosine(F.col("a"), F.col("s")).alias("c1"), cosine(F.col("a"), F.col("a")).alias("c2")).first()
    assert [round(x, 6) for x in r["n"]] == [0.6, 0.8] and list(r["z"]) == [0, 0] and (r["c0"], r["c1"], r["c2"]) == (0, 0, 1)
    pairs = spark.createDataFrame([("same", k, float(k), float(k)) for k in range(3)] + [("flip", k, float(k), float(-k)) for k in range(3)] + [("one", 0, 1.0, 1.0)], "k string, p int, a double, b double")
    assert {r["k"]: r["rho"] for r in spearman(pairs, "k", "a", "b", "p").collect()} == {"same": 1.0, "flip": -1.0, "one": None}


def found(spark, schema, errors, rows):
    got = spark.createDataFrame(rows, "j string, want string").select("want", F.from_json("j", schema).alias("s"))
    return [(r["want"], "; ".join(r["e"])) for r in got.select("want", errors(F.col("s")).alias("e")).collect()]


def test_route_specs(spark):
    rows = [
        ('{"route":[{"pool":"a","weight":80},{"pool":"b","weight":20}]}', ""), ('{"route":[]}', "at least one destination is required"), ("{}", "at least one destination is required"),
        ('{"route":[{"pool":"","weight":101}]}', "pool is required; weight must be 0-100"),
        ('{"route":[{"pool":"a"},{"pool":"a"}],"fallback":{"action":"redirect"}}', "duplicate unconditional pool; redirectPool is required"),
        ('{"route":[{"pool":"a"},{"pool":"a","condition":{"queueDepth":">5"}}],"fallback":{"action":"redirect","redirectPool":"b"}}', ""),
        ('{"route":[{"pool":"a"}],"match":{"operations":["x"],"timeWindow":{"start":"9:00","end":"17:60","days":[7]}},"retry":{"attempts":-1}}', "unknown operation; time must be HH:MM; day must be 0-6; attempts must not be negative"),
        ('{"route":[{"pool":"a"}],"match":{"timeWindow":{"start":"9:00","end":""},"models":["bge-*"],"headers":{"x":{"regex":"^a+$"}}},"retry":{"retryOn":["5xx","reset"]}}', ""),
        ('{"route":[{"pool":"a"}],"match":{"models":["", "a(*"],"headers":{"":{"exact":"v"},"h":{},"r":{"regex":"("}}},"retry":{"retryOn":["503"]}}',
         "empty model pattern; model pattern does not compile; empty header name; header needs exact, prefix or regex; header regex does not compile; unknown retry condition"),
        ('{"route":[{"pool":"a"}],"fallback":{"action":"drop"},"rateLimiting":{"requestsPerSecond":0,"burstSize":-1}}', "unknown fallback action; requestsPerSecond must be positive; burstSize must not be negative")]
    got = found(spark, G.ROUTE_SPEC, G.route_errors, rows)
    assert [g for _, g in got] == [w for w, _ in got]


def test_pool_specs(spark):
    rows = [
        ('{"replicas":{"min":1,"max":3}}', ""), ('{"replicas":{"min":4,"max":3}}', "max must not be below min"), ('{"replicas":{"min":-1,"max":0}}', "min must not be negative; max must be positive"),
        ('{"gke":{"autopilotComputeClass":"Accelerator"}}', "compute class requires autopilot; Accelerator requires a GPU"),
        ('{"gke":{"autopilot":true,"autopilotComputeClass":"Accelerator"},"limits":{"nvidia.com/gpu":"1"}}', ""), ('{"gke":{"autopilot":true,"autopilotComputeClass":"Fast"}}', "unknown compute class"),
        ('{"gke":{"autopilot":true},"hardware":{"spot":true,"accelerator":"tpu-v5"}}', "spot conflicts with autopilot")]
    got = found(spark, G.POOL_SPEC, G.pool_errors, rows)
    assert [g for _, g in got] == [w for w, _ in got]
    rows = [
        ('{"gke":{"autopilot":true},"hardware":{"spot":true,"accelerator":"tpu-v5"}}', ""), ('{"gke":{"autopilot":true},"hardware":{"spot":true}}', "spot conflicts with autopilot"),
        ('{"gke":{"autopilotComputeClass":"Accelerator"},"replicas":{"min":1,"max":0}}', "compute class requires autopilot; max must be positive; max must not be below min")]
    got = found(spark, G.POOL_SPEC, G.controller_pool_errors, rows)
    assert [g for _, g in got] == [w for w, _ in got]
    pairs = [
        ('{"gke":{"autopilot":true}}', '{"gke":{"autopilot":false}}', "autopilot is immutable"), ('{"gke":{"autopilot":true}}', "{}", ""), ("{}", '{"gke":{"autopilot":true}}', "gke must not be removed"),
        ('{"gke":{"autopilot":true,"autopilotComputeClass":"Balanced"}}', '{"gke":{"autopilot":true}}', "compute class is immutable"), ('{"gke":{"autopilot":false}}', '{"gke":{}}', "")]
    d = spark.createDataFrame(pairs, "new string, old string, want string").select("want", F.from_json("new", G.POOL_SPEC).alias("new"), F.from_json("old", G.POOL_SPEC).alias("old"))
    assert all(r["want"] == "; ".join(r["e"]) for r in d.select("want", G.pool_errors(F.col("new"), F.col("old")).alias("e")).collect())


def test_requests_edges(spark):
    bodies = ['["a","b"]', '"a"', '""', "[]", "[1]", '[{"type":"text","text":"t"},{"type":"image_url","image_url":{"url":"u"}}]', '[{"type":"video"}]', "{}", "nope", None]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(F.size(F.coalesce(Q.parse_input(F.col("b")), F.array().cast("array<struct<type:string,text:string,url:string>>")))).collect()]
    assert got == [2, 1, 0, 0, 0, 2, 0, 0, 0, 0]


def test_pools_blobs_hub_and_config(spark):
    files = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"abd"))], "path string, content binary")
    digest = "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    want = spark.createDataFrame([("a", digest, 3), ("b", digest, 3), ("c", digest, 3)], "path string, digest string, size long")
    assert {r["path"]: r["state"] for r in G.verify_blobs(files, want).collect()} == {"a": "ok", "b": "hash mismatch", "c": "missing"}
    listing = spark.createDataFrame([("r", "x/tokenizer.json"), ("r", "a/tokenizer.json"), ("r", "onnx/model.onnx"), ("r", "onnx/model.onnx_data"), ("r", "onnx/model_i8.onnx"), ("r", "README.md")], "repo string, path string")
    assert sorted(r["path"] for r in G.hub_files(listing).collect()) == ["a/tokenizer.json", "onnx/model.onnx", "onnx/model.onnx_data"]
    assert G.hub_variants(listing).first()["variants"] == ["f32", "i8"]
    merged = spark.sql("SELECT map('a', '1') AS u, map('a', '0', 'b', '2') AS d").select(G.merge_config(F.col("u"), F.col("d")).alias("m")).first()["m"]
    assert merged == {"a": "1", "b": "2"}
    assert len(spark.sql("SELECT named_struct('x', 1) AS s").select(G.template_hash(F.col("s"))).first()[0]) == 16
