"""Exact deduplication in three combining stages (JVM expressions only).

Texts are equal when they are identical after lower-casing A-Z. Equal texts are
combined locally in each map task, then per (digest, salt), then over the salts;
every stage groups by digest *and* the whole normalised text, so a digest alone
never decides. A group of any size reaches a reducer as at most one row per map
task (salted stage) or one row per salt (global stage). The small table of
winners is written to the shared folder and joined back to the rows by digest;
that join has plain exchanges on both sides, so adaptive execution splits the
partition of a hot digest.

Nulls and edge cases: a null text counts as the empty text; empty texts are equal
to each other. A null id ranks below every other id; a group of null ids only has
a null ``keep_id`` and all its rows are kept. Rows repeated whole (same id, same
text) share one id, so they share ``kept`` in ``exact_duplicates``, which marks
rows; ``drop_exact_duplicates`` lets one row of a text stay, also of rows repeated
whole or with null ids. Other columns are ignored by ``exact_duplicates`` and
carried unchanged by ``drop_exact_duplicates``. An empty table gives an empty
table. Very long texts are whole cells of two shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, one_of_repeats, whole_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the vectorised ``lower``."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def combine(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    norm = docs.select(F.col(id_col).alias("_id"), fold_ascii(F.col(text_col)).alias("_norm"))
    keyed = norm.select("_id", "_norm", F.unhex(F.sha2("_norm", 256)).alias("_digest"),
                        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    # The partial aggregate of this groupBy is the local stage, its final one the salted stage.
    salted = keyed.groupBy("_digest", "_norm", "_salt").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    groups = salted.groupBy("_digest", "_norm").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return groups.groupBy("_digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts"))


def _judge(docs: DataFrame, id_col: str, text_col: str, salts: int, carry: Column) -> DataFrame:
    groups = materialize(combine(docs, id_col, text_col, salts), "exact-groups")
    rows = docs.select(F.col(id_col).alias("doc_id"), carry.alias("_carry"),
                       F.unhex(F.sha2(fold_ascii(F.col(text_col)), 256)).alias("_digest"))
    # Two different texts under one SHA-256 digest stop the job instead of being merged.
    sure = F.assert_true(F.col("_texts") == 1, F.lit("two texts share a SHA-256 digest"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("_sure").isNull()
    return rows.join(groups.withColumn("_sure", sure), "_digest").withColumn("kept", kept)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    judged = _judge(docs, id_col, text_col, salts, F.lit(None).cast("boolean"))
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    kept = _judge(docs, id_col, text_col, salts, whole_row(docs)).where("kept").select("doc_id", "_digest", "_carry")
    return one_of_repeats(kept, "doc_id", ["_digest"], docs.select(id_col)).select("_carry.*")
