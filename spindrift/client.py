"""A thin facade with the service's verbs over small in-memory requests; large inputs go to the operators directly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrift.functions.models import Embedder, HashEmbedder, overlap_score
from spindrift.operators.chunking import ChunkConfig, chunk_fixed
from spindrift.operators.registry import TYPES, list_models
from spindrift.operators.serving import embed_texts, rerank
from spindrift.session import ship
from spindrift.sources.control_plane import version
from spindrift.sources.vector_stream import serialize


class Client:
    def __init__(self, spark: SparkSession, embedder: Callable[[], Embedder] = HashEmbedder) -> None:
        self.spark, self.embedder = ship(spark), embedder

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector per text, in order."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "pos int, text string")
        return [r["embedding"] for r in embed_texts(rows, self.embedder).orderBy("pos").collect()]

    def embed_binary(self, texts: list[str]) -> bytes:
        """The same as a binary vector stream."""
        return serialize(self.embed(texts))

    def chunk(self, text: str, config: ChunkConfig = ChunkConfig()) -> list[dict]:
        rows = chunk_fixed(self.spark.createDataFrame([(0, text)], "doc_id int, text string"), config)
        return [{"id": r["chunk_id"], "text": r["text"], "start_char": r["start_char"], "end_char": r["end_char"]} for r in rows.orderBy("chunk_id").collect()]

    def rerank(self, query: str, prompts: list[str]) -> list[float]:
        """Scores in the order of the prompts."""
        pairs = self.spark.createDataFrame([(k, query, p) for k, p in enumerate(prompts)], "pos int, query string, prompt string")
        return [r["score"] for r in rerank(pairs, overlap_score).orderBy("pos").collect()]

    def models(self, registered: list[tuple[str, str]]) -> dict[str, list[str]]:
        """Sorted names by type, from (type, name) pairs; every type is present."""
        row = list_models(self.spark.createDataFrame(registered, "type string, name string")).first()
        return {f"{t}s": list(row[f"{t}s"]) for t in TYPES}

    def version(self) -> str:
        return version(self.spark).select(F.col("version")).first()[0]
