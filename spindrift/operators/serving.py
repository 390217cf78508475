"""Embedding and reranking over request tables.

Equal requests share one model call: keys are made distinct before the UDF and
results are joined back, which covers both result caching and coalescing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.models import Embedder, embed_udf, overlap_score


def embed_texts(requests: DataFrame, make: Callable[[], Embedder], *, text_col: str = "text", model_col: str | None = None) -> DataFrame:
    """``requests`` with an ``embedding`` column; each distinct (model, text) is embedded once."""
    keys = [text_col] + ([model_col] if model_col else [])
    distinct = requests.select(*keys).where(F.col(text_col).isNotNull()).distinct()
    vectors = distinct.withColumn("embedding", embed_udf(make)(F.col(text_col)))
    return requests.join(vectors, keys, "left")


def embed_response(items: DataFrame, *, key: str = "request_id", position: str = "pos") -> DataFrame:
    """One row per request with its vectors in input order."""
    ordered = F.array_sort(F.collect_list(F.struct(position, "embedding")))
    return items.groupBy(key).agg(F.transform(ordered, lambda x: x["embedding"]).alias("embeddings"))


def rerank(pairs: DataFrame, score: Callable[[Column, Column], Column] = overlap_score, *, query_col: str = "query", prompt_col: str = "prompt") -> DataFrame:
    """(query, prompt) rows with a ``score``; the order is the input's, sorting is left to the caller."""
    return pairs.withColumn("score", score(F.col(query_col), F.col(prompt_col)))


def check_score_count(responses: DataFrame, *, prompts_col: str = "prompts", scores_col: str = "scores") -> DataFrame:
    """status 500 where the number of scores differs from the number of prompts."""
    ok = F.size(scores_col) == F.size(prompts_col)
    return responses.withColumn("status", F.when(ok, 200).otherwise(500)).withColumn("error", F.when(~ok, "score count mismatch"))


def prefer_quantized(files: DataFrame) -> DataFrame:
    """Per model the file to load: the int8 file where there is one (``files``: model, file)."""
    return files.groupBy("model").agg(F.when(F.bool_or(F.col("file") == "model_i8.onnx"), "model_i8.onnx").otherwise("model.onnx").alias("file"))
