"""Pluggable models as vectorised UDFs: each worker loads its model once and sees Arrow batches.

No weights come with the library. ``HashEmbedder`` and ``overlap_score`` are
deterministic stand-ins with the real shapes; ``OnnxModel`` runs a model file if a
path is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, queries: list[str], prompts: list[str]) -> np.ndarray: ...


class BoundaryModel(Protocol):
    def boundaries(self, texts: list[str]) -> list[list[dict]]: ...


class TokenCounter(Protocol):
    def count(self, texts: list[str]) -> list[int]: ...


class HashEmbedder:
    """Unit vectors drawn from a hash of the text."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dimensions), np.float32)
        for k, t in enumerate(texts):
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).normal(size=self.dimensions)
            out[k] = v / np.linalg.norm(v)
        return out


class OverlapScorer:
    """The share of the query's distinct words that the prompt holds, as a model; ``overlap_score`` is the same as an expression."""

    def score(self, queries: list[str], prompts: list[str]) -> np.ndarray:
        words = lambda t: set(re.split(r"[ \t\n\x0b\f\r]+", t.lower())) - {""}
        pairs = [(words(q), words(p)) for q, p in zip(queries, prompts, strict=True)]
        return np.array([len(q & p) / len(q) if q else 0.0 for q, p in pairs], np.float32)


class SentenceBoundaries:
    """An entity at every sentence end but the text's, labelled and scored by its place: the shape of a token classifier's output.

    The label goes round ``separator``, ``B-SEPARATOR`` and ``O``; the end counts bytes.
    """

    def boundaries(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            end, found = 0, []
            for k, part in enumerate(text.encode().split(b". ")[:-1]):
                end += len(part) + 2
                found.append({"entity": ("separator", "B-SEPARATOR", "O")[k % 3], "score": end * 7919 % 1000 / 1000, "end": end})
            out.append(found)
        return out


class OnnxModel:
    """An ONNX file on one thread; inputs are given by name."""

    def __init__(self, path: str) -> None:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])

    def run(self, **inputs: np.ndarray) -> np.ndarray:
        return self.session.run(None, inputs)[0]


class BpeCounter:
    """Token counts by a byte-level BPE file of ranks."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        self.ranks_path, self.pattern, self._encoding = ranks_path, pattern, None

    def count(self, texts: list[str]) -> list[int]:
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(self._encoding.encode_ordinary(t)) for t in texts]


class WordPieceCounter:
    """Token counts by a WordPiece vocabulary (one piece a line): cleaned, lower-cased, accents stripped, no end marks."""

    def __init__(self, vocabulary_path: str) -> None:
        self.vocabulary_path, self._tokenizer = vocabulary_path, None

    def count(self, texts: list[str]) -> list[int]:
        if self._tokenizer is None:
            from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

            with open(self.vocabulary_path, encoding="utf-8") as lines:
                pieces = {line.rstrip("\n"): k for k, line in enumerate(lines) if line != "\n"}
            self._tokenizer = Tokenizer(models.WordPiece(pieces, unk_token="[UNK]"))
            self._tokenizer.normalizer = normalizers.BertNormalizer()
            self._tokenizer.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
        return [len(e.ids) for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]


def embed_udf(make: Callable[[], Embedder]):
    """A column function text to vector. Null and empty texts give null."""
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            some = texts[texts.notna() & (texts != "")]
            found = dict(zip(some.index, model.embed(some.tolist()) if len(some) else [], strict=True))
            yield pd.Series([found.get(k) for k in texts.index], index=texts.index, dtype=object)
    return embed


def count_udf(make: Callable[[], TokenCounter]):
    """A column function text to token count; null counts 0."""
    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(model.count(texts.fillna("").tolist()), index=texts.index)
    return count


def score_udf(make: Callable[[], Scorer], batch: int = 16):
    """A column function (query, prompt) to score, ``batch`` pairs a call. A null or empty query, or a null prompt, gives null.

    A model that returns another number of scores than it got pairs fails the task.
    """
    @F.pandas_udf(FloatType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for queries, prompts in batches:
            some = np.flatnonzero((queries.notna() & (queries != "") & prompts.notna()).to_numpy())
            out = np.full(len(queries), None, object)
            for k in range(0, len(some), batch):
                rows = some[k:k + batch]
                found = model.score(queries.iloc[rows].tolist(), prompts.iloc[rows].tolist())
                if len(found) != len(rows):
                    raise ValueError(f"{len(found)} scores for {len(rows)} prompts")
                out[rows] = [float(x) for x in found]
            yield pd.Series(out, index=queries.index)
    return score


ENTITIES = ArrayType(StructType([StructField("entity", StringType()), StructField("score", DoubleType()), StructField("end", LongType())]))


def boundary_udf(make: Callable[[], BoundaryModel], batch: int = 16):
    """A column function text to entities for ``cut_at_boundaries``, ``batch`` texts a call. Null and empty texts have none."""
    @F.pandas_udf(ENTITIES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            some = np.flatnonzero((texts.notna() & (texts != "")).to_numpy())
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for k in range(0, len(some), batch):
                rows = some[k:k + batch]
                for row, found in zip(rows, model.boundaries(texts.iloc[rows].tolist()), strict=True):
                    out[row] = found
            yield pd.Series(out, index=texts.index)
    return find


def overlap_score(query: Column, prompt: Column) -> Column:
    """The share of the query's distinct words that the prompt holds; 0 for an empty query."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    asked = words(query)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, words(prompt))) / F.size(asked)).cast("float")
