"""The corpus pipeline: filter by quality, dedup, near-dedup, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
to the shared folder and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``; the last returns one row per packed
piece of the documents that stayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.exact_dedup import drop_exact_duplicates
from spindrift.llm.minhash import drop_near_duplicates
from spindrift.llm.mixing import sample_mixture
from spindrift.llm.packing import pack
from spindrift.llm.quality import fit_quality, keep_good
from spindrift.llm.queries import mixture_targets, table, vocabulary
from spindrift.llm.workspace import materialize, scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects (score below 0.7) go."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded), the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at similarity 0.8 or more, the least doc_id stays."""
    return drop_near_duplicates(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that tokens meet the target shares."""
    return sample_mixture(docs, mixture_targets())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents as pieces of 2048-token sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; every table but the last stage's result is deleted on the way."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as outputs:
        for name, stage in STAGES:
            with scratch(spark):
                docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", scope=None if name == STAGES[-1][0] else outputs)
    return docs
