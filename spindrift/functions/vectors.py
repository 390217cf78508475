"""Vector columns: normalise, compare, correlate. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import let


def l2_normalize(vector: Column) -> Column:
    """Unit length in single precision: float32 sum of squares, reciprocal of the root, product. Zero vectors stay."""
    total = F.aggregate(vector, F.lit(0).cast("float"), lambda acc, x: (acc + (x * x).cast("float")).cast("float"))
    scale = lambda t: (F.lit(1.0) / F.sqrt(t.cast("double"))).cast("float")
    return let(total, lambda t: F.when(t == 0, vector).otherwise(let(scale(t), lambda r: F.transform(vector, lambda x: (x * r).cast("float")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, cast to float at the end; 0 for unequal lengths or a zero vector."""
    norms = let(dot(a, a), lambda x: let(dot(b, b), lambda y: F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(x) * F.sqrt(y)))))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(norms).cast("float")


def score_min(scores: Column) -> Column:
    return F.coalesce(F.array_min(scores), F.lit(0).cast("float"))


def score_max(scores: Column) -> Column:
    return F.coalesce(F.array_max(scores), F.lit(0).cast("float"))


def ranks(df: DataFrame, key: str, score: str, position: str, name: str) -> DataFrame:
    """Rank 1 is best; equal scores rank by position (the tie-break is ours, the original order of ties is unspecified)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), position)))


def spearman(df: DataFrame, key: str, a: str, b: str, position: str) -> DataFrame:
    """1 - 6 sum(d^2) / (n (n^2 - 1)) of the ranks of two scores per key; null for a single row."""
    both = ranks(ranks(df, key, a, position, "_ra"), key, b, position, "_rb")
    d = F.col("_ra") - F.col("_rb")
    summed = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum((d * d).cast("double")).alias("_dd"))
    return summed.select(key, "n", F.when(F.col("n") > 1, 1 - 6 * F.col("_dd") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("rho"))
