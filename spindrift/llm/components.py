"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregate (with map-side combine) and at most one join, so a hub
with very many links costs one partial row per map task and a join partition that
adaptive execution can split. Every round is written to the shared folder, which
cuts lineage and lets a lost executor be replaced. The driver sees one count and
one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge is (a, b) with b < a: all b of one a meet in the least of them
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least.hint("merge"), "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
    return met.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % F.lit(1 << 40)))).first()
    return row[0], row[1] or 0


def components(links: DataFrame, *, max_rounds: int = 60, one_task_edges: int = 500_000) -> DataFrame:
    """``links`` (a, b) of comparable ids to (id, root) for every id that is not its component's least one.

    Links to itself and null ends are ignored; repeated links count once; an
    empty table gives an empty table. At most ``one_task_edges`` edges (8 MB) run
    in a single task without any shuffle; more are spread as usual.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        if before[0] <= one_task_edges:
            edges = edges.coalesce(1)
        edges = materialize(_small_star(_large_star(edges)), "stars")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
