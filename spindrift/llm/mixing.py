"""Mixing sources to target weights by iterative proportional fitting.

Each document falls into a cell (source group, language group, topic). Cells hold
token weights; raking scales the cells until their sums meet the target shares of
all three marginals. The cell count is bounded by the targets, because values
without a target of their own share the group ``*``; so the cells fit the driver
at any scale. The raked weight of a cell over its tokens is the rate at which its
documents should be drawn; the rates are calibrated by one scale so that the
expected tokens equal the budget although no probability exceeds one.

A document is drawn when a uniform number made from a hash of its id is below its
probability, so the draw does not depend on partitions or retries.

Tokens are estimated as ceil(bytes / 4). The topic is the form of the text, by
fixed rules: ``table`` (cells with bars), ``shout`` (doubled exclamation marks),
``symbols`` (runs of marks), else ``prose``; any other topic column can be passed.

Nulls and edge cases: null or unlisted sources, languages and topics belong to
``*``. A null text has zero tokens, like an empty one; such documents keep their
cell's probability and cost nothing. A null id is drawn by the hash of the empty
string. Rows repeated whole are drawn together. A target whose group holds no
tokens is left out and the other shares of that marginal are scaled up. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import whole_row

REST = "*"


@dataclass(frozen=True)
class Targets:
    """Shares by value for each marginal; ``*`` holds all values that are not listed."""

    source: Mapping[str, float]
    lang: Mapping[str, float]
    topic: Mapping[str, float]
    budget: float = 0.5

    @property
    def marginals(self) -> list[Mapping[str, float]]:
        return [self.source, self.lang, self.topic]


def topic_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.contains(" | "), "table").when(text.contains("!! "), "shout")
            .when(text.rlike(r"[*#$%&]{3}\s"), "symbols").otherwise("prose"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def group_of(value: Column, shares: Mapping[str, float]) -> Column:
    """The value itself if it has a target, else ``*``."""
    listed = [v for v in shares if v != REST]
    return F.when(value.isin(listed), value).otherwise(REST) if listed else F.lit(REST)


def rake(tokens: np.ndarray, cells: np.ndarray, shares: list[dict[int, float]], rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Cell weights whose marginal sums are the shares; ``cells`` has one column of group numbers per marginal."""
    weight = tokens / max(tokens.sum(), 1)
    for _ in range(rounds):
        worst = 0.0
        for k, share in enumerate(shares):
            size = int(cells[:, k].max()) + 1
            now = np.bincount(cells[:, k], weight, size)
            want = np.array([share.get(g, 0.0) for g in range(size)])
            want = np.where(now > 0, want, 0)
            want = want / want.sum() if want.sum() else now
            factor = np.divide(want, now, out=np.zeros(size), where=now > 0)
            worst = max(worst, float(np.abs(want - now).max()))
            weight = weight * factor[cells[:, k]]
        if worst < tolerance:
            break
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities proportional to weight / tokens, at most 1, with expected tokens budget * sum(tokens) where possible."""
    rate = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    if not rate.any():
        return np.where(tokens > 0, 0.0, 1.0)
    goal = min(budget * tokens.sum(), tokens[rate > 0].sum())
    low, high = 0.0, 1.0 / rate[rate > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * rate) * tokens).sum() < goal else (low, mid)
    return np.where(tokens > 0, np.minimum(1, high * rate), 1.0)


def mix(docs: DataFrame, targets: Targets, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        topic: Column | None = None, seed: int = 0, carry: Column | None = None) -> DataFrame:
    """Per row: doc_id, source_group, lang_group, topic, tokens, weight, probability, sampled (and ``carry``)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *([carry.alias("carried")] if carry is not None else []),
        group_of(F.col(source_col), targets.source).alias("source_group"), group_of(F.col(lang_col), targets.lang).alias("lang_group"),
        group_of(topic_of(text) if topic is None else topic, targets.topic).alias("topic"), token_estimate(text).alias("tokens"))
    names = ["source_group", "lang_group", "topic"]
    found = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")).collect()  # at most the product of the targets' sizes
    levels = [{v: k for k, v in enumerate(sorted({r[n] for r in found}))} for n in names]
    cells = np.array([[levels[k][r[n]] for k, n in enumerate(names)] for r in found], dtype=np.int64).reshape(-1, 3)
    tokens = np.array([r["tokens"] for r in found], dtype=np.float64)
    shares = [{levels[k][v]: s for v, s in m.items() if v in levels[k]} for k, m in enumerate(targets.marginals)]
    if len(found):
        weight = rake(tokens, cells, shares)
        chance = calibrate(tokens, weight, targets.budget)
    else:
        weight = chance = np.zeros(0)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(*(r[n] for n in names), float(w), float(p)) for r, w, p in zip(found, weight, chance, strict=True)],
        "source_group string, lang_group string, topic string, weight double, probability double")
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)
    return rows.join(F.broadcast(table), names).withColumn("sampled", uniform < F.col("probability"))


def sample_mixture(docs: DataFrame, targets: Targets, **options) -> DataFrame:
    """The drawn rows, with their own columns only."""
    return mix(docs, targets, carry=whole_row(docs), **options).where("sampled").select("carried.*")
