"""The facade and registry files."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException

from spindrift.client import Client
from spindrift.operators.chunking import ChunkConfig
from spindrift.sources import content
from spindrift.sources.vector_stream import deserialize


def test_client_verbs(spark):
    c = Client(spark)
    a, b, a2 = c.embed(["x", "y", "x"])
    assert a == a2 != b and len(a) == 64 and abs(np.linalg.norm(a) - 1) < 1e-5
    assert [list(map(float, v)) for v in deserialize(c.embed_binary(["x"]))] == [list(a)]
    assert c.chunk("one two\nthree four", ChunkConfig(2, 0)) == [{"id": 0, "text": "one two", "start_char": 0, "end_char": 7}, {"id": 1, "text": "three four", "start_char": 9, "end_char": 19}]
    assert c.chunk("") == []
    assert c.rerank("deep learning", ["deep sea", "learning deep nets", "x"]) == [0.5, 1.0, 0.0]
    assert c.models([("embedder", "b"), ("embedder", "a"), ("chunker", "c")]) == {"embedders": ["a", "b"], "chunkers": ["c"], "rerankers": []}
    assert c.version() == "0.1.0"


def test_registry_files(spark, tmp_path):
    index = {"schemaVersion": 1, "models": [{"name": "m", "type": "embedder", "description": "d", "size": 5, "variants": ["f16"]}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    assert content.registry_index(spark, str(tmp_path / "index.json")).first()["name"] == "m"
    (tmp_path / "bad.json").write_text(json.dumps(index | {"schemaVersion": 2}))
    with pytest.raises(PySparkException):
        content.registry_index(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "models" / "m1").mkdir(parents=True)
    (tmp_path / "models" / "m1" / "model.onnx").write_bytes(b"abc")
    assert [tuple(r) for r in content.model_files(spark, str(tmp_path / "models")).collect()] == [("m1", "model.onnx", 3)]
    assert hashlib.sha256(content.read_binary(spark, str(tmp_path / "models")).first()["content"]).hexdigest() == hashlib.sha256(b"abc").hexdigest()


def test_policy_hosts_and_paths(spark):
    policy = content.ContentPolicy(allowed_hosts=["ok.example"], allowed_paths=["/data/"])
    uris = ["https://ok.example/a", "https://no.example/a", "file:///data/x", "file:///etc/x", "data:,x"]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(u,) for u in uris], "u string").select(content.refused(F.col("u"), policy)).collect()
    assert [r[0] for r in got] == [None, "host not allowed", None, "path not allowed", None]
