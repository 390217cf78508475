"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A
text is cut into blocks of ``block`` bytes, and each block is compressed with
both. The normalised size difference (bad - good) / (bad + good), over the whole
text and at its extreme blocks, together with the compressed rate, goes through a
calibrated logistic model.

The fit uses at most ``dictionary_rows`` and ``calibration_rows`` labelled texts
per class, chosen by a hash of the id (documented bounds); their texts count whole,
and the dictionaries are trained on the same blocks that scoring compresses. Rows
with crc32(id) mod 4 = 2 are never used. An id with both labels counts as bad. Class weights restore the labelled prior. Scoring covers every
row and its whole text; labels, language, source and id are no inputs.

Nulls and edge cases: a null text scores as the empty text. Labels with a null id
or a value other than 0 and 1 are ignored; repeated label rows count once each.
With no labels, or labels of one class only, every score is the smoothed share
(good + 1) / (all + 2). An empty table gives an empty table. Other columns are
ignored by ``quality_scores`` and carried unchanged by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrow_parts import text_parts
from .workspace import whole_row

FEATURES = 7
LEVEL = 3


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    block: int
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    prior: float

    def scorer(self):
        """A function from a list of texts to scores, for one worker."""
        if self.weights is None:
            return lambda texts: np.full(len(texts), self.prior)
        measure = measurer(self.good, self.bad, self.block)
        return lambda texts: _probability(_design(np.array([measure(t) for t in texts]).reshape(-1, FEATURES), self.mean, self.scale), self.weights)


def blocks_of(text: str | None, block: int) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[k:k + block] for k in range(0, len(raw), block)] or [b""]


def measurer(good: bytes, bad: bytes, block: int):
    """A function from a text to its compression features."""
    def compressor(raw: bytes):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    by_good, by_bad = compressor(good), compressor(bad)

    def measure(text: str | None) -> list[float]:
        blocks = blocks_of(text, block)
        g = np.array([len(by_good(b)) for b in blocks], dtype=np.float64)
        c = np.array([len(by_bad(b)) for b in blocks], dtype=np.float64)
        size = np.array([max(len(b), 1) for b in blocks], dtype=np.float64)
        lean, n = (c - g) / (c + g), max(sum(map(len, blocks)), 1)
        return [(c.sum() - g.sum()) / (c.sum() + g.sum()), lean.min(), lean.max(), g.sum() / n, (g / size).min(), np.log(n) / 10, size[lean < 0].sum() / n]
    return measure


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.clip((x - mean) / scale, -8, 8)
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def _probability(design: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))


def _logistic(design: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = _probability(design, w)
        h = (design * (importance * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(h, design.T @ (importance * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples for the trainer make a plain one of their bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n"


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                dictionary_rows: int = 1000, calibration_rows: int = 2000, dictionary_bytes: int = 112640, block: int = 1024) -> QualityModel:
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    constant = QualityModel(b"", b"", block, None, None, None, (counts.get(1, 0) + 1) / (total + 2))
    if len(counts) < 2:
        return constant
    rows = dictionary_rows + calibration_rows
    chosen = None
    for y in (0, 1):  # at most 2 * rows small rows reach the driver
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    picked = [(r["id"], r["y"]) for r in chosen.collect()]
    split = {y: [i for i, v in picked if v == y] for y in (0, 1)}
    # a third of each class makes the dictionaries, the rest the calibration
    for_dictionary = {i: y for y in (0, 1) for i in split[y][: max(1, min(dictionary_rows, len(split[y]) // 3))]}
    for_fit = [(i, y) for i, y in picked if i not in for_dictionary] or picked
    spark = docs.sparkSession
    id_type = usable.schema["id"].dataType.simpleString()

    def texts_of(ids: list) -> DataFrame:
        wanted = spark.createDataFrame([(i,) for i in sorted(set(ids))], f"wanted {id_type}")
        two = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return two.join(F.broadcast(wanted), F.col("id") == F.col("wanted"), "left_semi")

    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in texts_of(list(for_dictionary)).orderBy("id", "text").toLocalIterator():
        samples[for_dictionary[r["id"]]] += blocks_of(r["text"], block)
    good, bad = _dictionary(samples[1], dictionary_bytes), _dictionary(samples[0], dictionary_bytes)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = measurer(good, bad, block)
        for part in text_parts(batches):
            x = [measure(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    measured: dict = {r["id"]: r["x"] for r in texts_of([i for i, _ in for_fit]).mapInArrow(features, f"id {id_type}, x array<double>").collect()}
    found = [(measured[i], y) for i, y in sorted(for_fit) if i in measured]
    y = np.array([v for _, v in found], dtype=np.float64)
    if len(set(y)) < 2:
        return constant
    x = np.array([v for v, _ in found])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    importance = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean()))
    return QualityModel(good, bad, block, mean, scale, _logistic(_design(x, mean, scale), y, importance), constant.prior)


def _scoring(model: QualityModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for part in text_parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1).to_pylist()), pa.float64())], ["carried", "score"])
    return score


def _scored(docs: DataFrame, model: QualityModel, carried: Column, text_col: str) -> DataFrame:
    two = docs.select(carried.alias("carried"), F.col(text_col).alias("text"))
    return two.mapInArrow(_scoring(model), StructType([two.schema["carried"], StructField("score", DoubleType())]))


def quality_scores(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted — one row per input row."""
    scored = _scored(docs, model, F.col(id_col), text_col)
    return scored.select(F.col("carried").alias("doc_id"), held_out(F.col("carried")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that score at least ``threshold``, with their own columns only."""
    return _scored(docs, model, whole_row(docs), text_col).where(F.col("score") >= threshold).select("carried.*")
