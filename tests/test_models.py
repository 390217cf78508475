"""Models behind UDFs, CLIP processing, content by URI, and small request and cache helpers on worked cases."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spindrift.functions import clip
from spindrift.functions.hashing import chunk_key, rerank_key
from spindrift.functions.models import OverlapScorer, SentenceBoundaries, WordPieceCounter, boundary_udf, count_udf, overlap_score, score_udf
from spindrift.operators import caching, registry, requests, routing, serving
from spindrift.sources import content
from spindrift.streaming.sources import request_stream


def test_score_udf(spark):
    rows = [(k, q, p) for k, (q, p) in enumerate([("a b", "b c"), ("", "x"), (None, "x"), ("x", None), ("X y", "x  Y\tz"), ("q", "")] * 7)]
    d = spark.createDataFrame(rows, "k int, q string, p string")
    got = {r["k"]: r["s"] for r in d.select("k", score_udf(OverlapScorer, batch=4)("q", "p").alias("s")).collect()}
    assert [got[k] for k in range(6)] == [0.5, None, None, None, 1.0, 0.0] and len(got) == 42
    same = d.where("q <> '' and p is not null").select(score_udf(OverlapScorer)("q", "p").alias("a"), overlap_score(F.col("q"), F.col("p")).alias("b"))
    assert all(r["a"] == r["b"] for r in same.collect())
    assert d.limit(0).select(score_udf(OverlapScorer)("q", "p")).collect() == []

    class Short:
        def score(self, queries, prompts):
            return np.zeros(1)

    with pytest.raises(PySparkException, match="1 scores for 2 prompts"):
        spark.createDataFrame([("a", "b"), ("c", "d")], "q string, p string").coalesce(1).select(score_udf(Short)("q", "p")).collect()


def test_boundary_udf(spark):
    d = spark.createDataFrame([(1, "é. b. c"), (2, ""), (3, None), (4, "none")], "k int, t string")
    got = {r["k"]: [(e["entity"], e["end"]) for e in r["e"]] for r in d.select("k", boundary_udf(SentenceBoundaries)("t").alias("e")).collect()}
    assert got == {1: [("separator", 4), ("B-SEPARATOR", 7)], 2: [], 3: [], 4: []}


def test_word_piece_counts(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "##s", ",", "a", "##a", "\u4e2d"]) + "\n")
    cases = [("unaffable", 3), ("Caf\u00e9s, CAFE", 4), ("", 0), (None, 0), ("aaa a", 4), ("xyz unx", 2), ("\u4e2d\u4e2d", 2), ("a\u0000a", 2)]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r["k"]: r["n"] for r in d.select("k", count_udf(lambda: WordPieceCounter(str(path)))("t").alias("n")).collect()}
    assert [got[k] for k in range(len(cases))] == [n for _, n in cases]


def png(pixels, modes):
    """An 8-bit PNG whose lines use the given filters."""
    height, width, depth = pixels.shape
    flat = pixels.reshape(height, -1).astype(int)
    data = b""
    for y in range(height):
        above = flat[y - 1] if y else np.zeros(width * depth, int)
        line = [modes[y % len(modes)]]
        for x in range(width * depth):
            left, up, corner = (flat[y, x - depth] if x >= depth else 0), above[x], (above[x - depth] if x >= depth else 0)
            p = left + up - corner
            near = sorted([(abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)])[0][2]
            line.append((flat[y, x] - [0, left, up, (left + up) // 2, near][line[0]]) % 256)
        data += bytes(int(v) for v in line)

    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_png_and_preprocess(spark, depth):
    pixels = np.random.default_rng(depth).integers(0, 256, (7, 5, depth))
    raw = png(pixels, [0, 1, 2, 3, 4])
    want = np.repeat(pixels, 3, axis=2) if depth == 1 else pixels[:, :, :3]
    assert (clip.read_png(raw) == want).all()
    config = clip.ClipConfig(image_size=4)
    plane = [((want[y * 7 // 4, x * 5 // 4, c] / 255) - config.mean[c]) / config.std[c] for c in range(3) for y in range(4) for x in range(4)]
    d = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "k int, raw binary")
    got = {r["k"]: r["p"] for r in d.select("k", clip.preprocess_udf(config)("raw").alias("p")).collect()}
    assert np.allclose(got[1], plane, atol=1e-5) and got[2] is None
    with pytest.raises(ValueError):
        clip.read_png(b"GIF89a")


def test_clip_text_config_and_projection(spark, tmp_path):
    vocabulary = {"a": 1, "b": 2, " cat": 3, "dog": 4}
    small = clip.ClipConfig(max_length=5, bos=90, eos=91)
    assert clip.tokenize("Cat dog  ab?", vocabulary, small) == [90, 3, 4, 1, 91]
    assert clip.tokenize("", vocabulary, small) == [90, 91] and clip.tokenize("cat ab", vocabulary) == [49406, 3, 1, 2, 49407]
    assert clip.ClipConfig.load(str(tmp_path)) == clip.ClipConfig()
    (tmp_path / "config.json").write_text(json.dumps({"projection_dim": 640, "vision_config": {"image_size": 336}}))
    (tmp_path / "clip_config.json").write_text(json.dumps({"projection_dim": 0}))
    assert clip.ClipConfig.load(str(tmp_path)) == clip.ClipConfig(projection_dim=640, image_size=336)
    d = spark.sql("SELECT array(1f, 2f) AS v, array(0f, 0f) AS z, CAST(NULL AS array<float>) AS n")
    r = d.select(clip.project(F.col("v"), [[1, 1], [2, 1]]).alias("v"), clip.project(F.col("z"), [[1, 1]]).alias("z"), clip.first_vector(F.col("n"), F.col("v")).alias("f")).first()
    assert np.allclose(r["v"], [0.6, 0.8]) and list(r["z"]) == [0] and list(r["f"]) == [1, 2]


def test_fetch(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    (tmp_path / "long.bin").write_bytes(b"x" * 11)
    a, long, gone = (f"file://{tmp_path}/{n}" for n in ("a.bin", "long.bin", "gone.bin"))
    rows = [a, a, long, gone, "data:,hi", "data:," + "y" * 11, "file:///etc/hostname", "ftp://x/y", "http://127.0.0.1:1/", "http://[::1]:1/", "http://100.64.0.1/", None]
    policy = content.ContentPolicy(allowed_paths=[str(tmp_path)], max_bytes=10)
    got = {r["uri"]: (bytes(r["content"]) if r["content"] is not None else None, r["error"]) for r in content.fetch(spark.createDataFrame([(u,) for u in rows], "uri string"), policy=policy).collect()}
    assert len(got) == 11 - 1 and got[a] == (b"hello", None) and got["data:,hi"] == (b"hi", None)
    assert got[long] == got["data:," + "y" * 11] == (None, "too large") and got[gone][0] is None and "gone.bin" in got[gone][1]
    assert got["file:///etc/hostname"] == (None, "path not allowed") and got["ftp://x/y"] == (None, "unknown scheme")
    assert all(got[u] == (None, "private address") for u in ("http://127.0.0.1:1/", "http://[::1]:1/", "http://100.64.0.1/"))


def test_small_helpers(spark, tmp_path):
    d = spark.createDataFrame([('{"model":"m"}', "application/json"), ('{"config":{"model":"c"}}', "*/*"), ("{", None)], "b string, a string")
    assert [tuple(r) for r in d.select(requests.request_model(F.col("b")), requests.wants_json(F.col("a"))).collect()] == [("m", True), ("c", False), ("", False)]
    loaded = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "model string, pinned boolean")
    assert {r["model"] for r in registry.unload(loaded, ["a", "b"]).collect()} == {"a", "c"}
    asked = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    assert {tuple(r) for r in caching.coalesced(asked, F.col("k")).collect()} == {("x", 2, 1), ("y", 1, 0)}
    counted = serving.check_score_count(spark.sql("SELECT array('a', 'b') AS prompts, array(1f) AS scores UNION ALL SELECT array('a'), array(1f)")).collect()
    assert [(r["status"], r["error"]) for r in counted] == [(500, "score count mismatch"), (200, None)]
    items = spark.createDataFrame([("r", 1, [2.0]), ("r", 0, [1.0])], "request_id string, pos int, embedding array<float>")
    assert serving.embed_response(items).first()["embeddings"] == [[1.0], [2.0]]
    keys = spark.sql("SELECT array('a', 'b') AS p, array('ab') AS q").select(*[rerank_key(F.lit("m"), F.lit("x"), F.col(c)).alias(c) for c in "pq"],
        *[chunk_key(F.lit("t"), F.lit("m"), F.lit(n), F.lit(1), F.lit("s"), F.lit(5), F.lit(0.5)).alias(f"c{n}") for n in (1, 11)]).first()
    assert len(set(keys)) == 4
    (tmp_path / "in").mkdir()
    content.write_json(spark.createDataFrame([("1", "/embed", "{}")], "request_id string, path string, body string"), str(tmp_path / "in" / "x"))
    q = request_stream(spark, str(tmp_path / "in" / "x")).writeStream.format("memory").queryName("asked_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["request_id"], r["path"]) for r in spark.table("asked_stream").collect()] == [("1", "/embed")]


def test_breaker_narrows_candidates(spark):
    keys = spark.createDataFrame([("m", "p")], "model string, pool string")
    up = spark.createDataFrame([(["m"], "p", "a", 1, 0, True, False), (["m"], "o", "b", 2, 0, True, True), ([], "p", "c", 0, 0, True, True)], "models array<string>, pool string, address string, connections int, queue_depth int, healthy boolean, allowed boolean")
    assert [r["address"] for r in routing.candidates(keys, up).collect()] == ["b"]
    assert [r["address"] for r in routing.candidates(keys, up.drop("allowed")).collect()] == ["a"]
