"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are compared only with vectors of the same label and dimension. Equal
vectors become one representative with a count. Representatives are dealt by hash
into tiles of about ``tile_rows`` per label; a task gets one pair of tiles, so a
label of any size spreads over as many tasks as it has tile pairs, and no task
holds more than two tiles. In a tile pair the vectors are rotated onto the
principal axes of a bounded sample (the rotation keeps cosines and only decides
speed) and dot products accumulate the leading axes first; a pair is dropped as
soon as its sum plus the product of the two suffix norms is below the threshold.
Survivors are decided by the cosine of the unrotated vectors in double precision.

A tile pair returns, per vector, how many vectors it links to and the root of its
local spanning forest, never the pairs. Components are joined across tiles.

Nulls and edge cases: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, likewise rows with a null label or id;
they come back with n_links 0 and themselves as component. Rows repeated whole
are vectors of their own that link with each other. Other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import materialize

SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def principal_axes(rows: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, by falling second moment; with more dimensions than rows, those that the rows span."""
    if rows.shape[1] > len(rows):
        return np.ascontiguousarray(np.linalg.svd(rows, full_matrices=False)[2].T)
    _, axes = np.linalg.eigh(rows.T @ rows)
    return np.ascontiguousarray(axes[:, ::-1])


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose cosine reaches the threshold; with ``same``, each pair once."""
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    ra, rb = ua @ axes, ub @ axes
    dim = axes.shape[1]
    cuts = [c for c in (8, 16, 32) if c < dim] + [dim]
    # the norm of what lies behind the first c axes, also what no axis covers; a little more than rounding can take away
    tails_a, tails_b = (np.sqrt(np.maximum(1 - np.pad(np.cumsum(r * r, axis=1), ((0, 0), (1, 0))), 0) + 1e-12) for r in (ra, rb))
    lead = cuts[0]
    x, y = [], []
    for s in range(0, len(ra), 512):  # 512 rows at a time bound the work arrays
        dot = ra[s:s + 512, :lead] @ rb[:, :lead].T
        rest = tails_a[s:s + 512, lead][:, None] * tails_b[:, lead][None, :]
        i, j = np.nonzero(dot + rest >= threshold - SLACK)
        if same:
            i, j = i[i + s < j], j[i + s < j]
        value = dot[i, j]
        i = i + s
        for lo, hi in zip(cuts, cuts[1:]):
            value = value + np.einsum("ij,ij->i", ra[i, lo:hi], rb[j, lo:hi])
            keep = value + tails_a[i, hi] * tails_b[j, hi] >= threshold - SLACK
            i, j, value = i[keep], j[keep], value[keep]
        exact = np.einsum("ij,ij->i", a[i], b[j]) / (np.linalg.norm(a[i], axis=1) * np.linalg.norm(b[j], axis=1))
        x.append(i[exact >= threshold])
        y.append(j[exact >= threshold])
    return np.concatenate(x or [np.empty(0, int)]), np.concatenate(y or [np.empty(0, int)])


def forest_roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least row number reachable from each of ``n`` rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _comparer(axes_by_dim: dict[int, np.ndarray], threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")  # roots are least ids
        rep, copies, side = (table.column(n).to_numpy()[order] for n in ("rep", "copies", "side"))
        rows = matrix(table.column("vector"), dim)[order]
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        axes = axes_by_dim.get(dim)
        x, y = linked_pairs(rows[left], rows[right], np.eye(dim) if axes is None else axes, threshold, same)
        x, y = left[x], right[y]
        links = np.bincount(x, copies[y], len(rep)).astype(np.int64) + np.bincount(y, copies[x], len(rep)).astype(np.int64)
        root = rep[forest_roots(x, y, len(rep))]
        hit = links > 0
        return pa.table({"rep": pa.array(rep[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()), "root": pa.array(root[hit], pa.int64())})
    return compare


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           threshold: float = 0.98, tile_rows: int = 2048, sample_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept — one row per input row."""
    vector = F.col(vector_col).cast("array<double>")
    sound = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector) > 0)
             & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(sound, vector).alias("vector"))
    reps = materialize(rows.where(F.col("vector").isNotNull()).groupBy("label", "vector")
                       .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vector")), "vectors")
    axes: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("vector").collect():
        axes.setdefault(len(r[0]), []).append(r[0])
    axes = {d: principal_axes(np.array(v)) for d, v in axes.items()}
    sizes = materialize(reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("tiles")), "tiles")
    tiled = reps.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    met = (tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
           .select("label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                   (F.col("tile") > F.col("other")).cast("int").alias("side"), "rep", "copies", "vector"))
    found = materialize(met.groupBy("label", "dim", "i", "j").applyInArrow(_comparer(axes, threshold), "rep long, links long, root long"), "tile-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_vector = materialize(
        reps.join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "vector-classes")
    component = F.coalesce("root", "vec_id")
    return rows.join(by_vector, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
