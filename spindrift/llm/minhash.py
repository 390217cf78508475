"""Near-duplicate documents by HyperMinHash.

One pass hashes every distinct five-word shingle into one of ``registers``
buckets. A bucket keeps its least value, compressed to the leading-zero count and
the ten bits after the leading one; an empty bucket borrows from a filled one
along a fixed random probe order, so that short texts keep the property that a
register agrees with probability equal to the Jaccard similarity. Documents with
the same shingle set become one class at once. Bands of compressed registers give
the candidate buckets.

Candidates are never expanded to all pairs of a bucket. Each bucket's most
connected class leads it and is compared with every other member. A bucket whose
other members then lie in one component is settled. In the rest, only members of
different components are compared: pair by pair in buckets of at most ``small``
members, and in larger ones tile by tile inside tasks, which return only edges
that join components. So no pair of a bucket is skipped unless its ends are
already connected. Before a comparison the registers give a collision-corrected
Jaccard estimate, which rules out pairs far below the threshold; sets too small
for the estimate skip it. A comparison intersects the full shingle sets.

There are as many bands of four registers as keep the probability that a pair at
the threshold shares no band below ``miss`` (one in a million); the estimate's cut
lies over five standard errors below the threshold.

Nulls and edge cases: null, empty and blank texts have an empty set and link with
nothing; rows repeated whole share their class, and ``drop_near_duplicates`` lets
one of them stay; rows with a null id are compared with nothing and come back with
a null component that is kept. Ids must be integers or castable to them. Other
columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_parts import give_back, raw_texts, text_parts
from .components import components
from .shingles import mix, shingle_hashes
from .workspace import materialize, one_of_repeats, whole_row

MANTISSA = 10
PROBES = 256
#: That registers of different values agree: equal leading-zero counts (sum of 4^-k) and equal mantissas.
CHANCE = 2.0 ** -MANTISSA / 3


def _probe_order(registers: int) -> np.ndarray:
    return np.random.default_rng(77).integers(0, registers, (PROBES, registers))


def compress(values: np.ndarray) -> np.ndarray:
    """Leading-zero count and the mantissa bits after the leading one, in 16 bits."""
    top = np.frexp(values.astype(np.float64))[1].astype(np.int64)  # bits up to the leading one, or one more by rounding
    low = values >> np.maximum(top - 1, 0).astype(np.uint64)
    top = np.where((values > 0) & (low == 0), top - 1, top)
    shift = top - 1 - MANTISSA
    mantissa = np.where(shift >= 0, values >> np.maximum(shift, 0).astype(np.uint64), values << np.maximum(-shift, 0).astype(np.uint64))
    return (((64 - top) << MANTISSA) | (mantissa.astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)


def register_table(hashes: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """One row of compressed registers per document; rows of empty sets are zero."""
    bucket = ((hashes >> np.uint64(40)) % np.uint64(registers)).astype(np.int64)
    value = mix(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    least = np.full(docs * registers, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * registers + bucket, value)
    filled = (least != np.iinfo(np.uint64).max).reshape(docs, registers)
    table = np.where(filled, compress(least).reshape(docs, registers), 0).astype(np.uint16)
    todo = np.flatnonzero(filled.any(1) & ~filled.all(1))
    source, have, done = table[todo], filled[todo], filled[todo].copy()
    out = source.copy()
    for probe in _probe_order(registers):
        take = ~done & have[:, probe]
        out[take] = source[:, probe][take]
        done |= take
        if done.all():
            break
    for shift in range(1, registers):  # the probes almost never fail; then the next filled register to the right serves
        if done.all():
            break
        take = ~done & np.roll(have, -shift, axis=1)
        out[take] = np.roll(source, -shift, axis=1)[take]
        done |= take
    table[todo] = out
    return table


def _sketcher(width: int, registers: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            n = part.num_rows
            h, d = shingle_hashes(raw_texts(part.column(1)), width)
            regs = register_table(h, d, n, registers)
            size = np.bincount(d, minlength=n).astype(np.int64)
            first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            if len(h):
                at = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                first[d[at]] = np.add.reduceat(mix(h + np.uint64(1)), at)
                second[d[at]] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
            raw = pa.array([r.tobytes() for r in regs], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), raw],
                ["doc_id", "n_shingles", "set_a", "set_b", "regs"])
    return sketch


def sketches(docs: DataFrame, *, id_col: str, text_col: str, width: int, registers: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit fingerprint of the set), regs."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(_sketcher(width, registers), "doc_id long, n_shingles long, set_a long, set_b long, regs binary")


def _set_reader(width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            h, d = shingle_hashes(raw_texts(part.column(1)), width)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=part.num_rows)))).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["id", "shingles"])
    return read


def _band_keys(rows: int, bands: int):
    """Column expressions: the bytes of each band, hashed together with the band's number."""
    return F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 2 * rows * k + 1, 2 * rows)) for k in range(bands)])


def _estimator(cut: float, trusted: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for name in ("regs_a", "regs_b"))
            agree = (a == b).mean(1)
            estimate = (agree - CHANCE) / (1 - CHANCE)
            small = np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) < trusted
            yield batch.select(["a", "b"]).filter(pa.array((estimate >= cut) | small))
    return keep


def _tile_verifier(percent: int, rows: int, cut: float, trusted: int):
    """Links between the members of one pair of a large bucket's tiles, as edges that join components."""
    def verify(table: pa.Table) -> pa.Table:
        ids, size, side, root = (table.column(n).to_numpy() for n in ("id", "n_shingles", "side", "root"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(len(ids), -1)
        sets = table.column("shingles").combine_chunks()
        start, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)  # sets are sorted as unsigned numbers
        band, same = table.column("band")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        label = np.unique(root, return_inverse=True)[1]
        a, b = [], []
        for x in left:
            near = right[(label[right] != label[x]) & (np.minimum(size[right], size[x]) * 100 >= np.maximum(size[right], size[x]) * percent)]
            if same:
                near = near[near > x]
            if not len(near):
                continue
            equal = regs[near] == regs[x]
            estimate = (equal.mean(1) - CHANCE) / (1 - CHANCE)
            # a pair that shares an earlier band is settled in that band's bucket
            earlier = equal[:, : band * rows].reshape(len(near), band, rows).all(2).any(1)
            near = near[((estimate >= cut) | (np.minimum(size[near], size[x]) < trusted)) & ~earlier]
            if not len(near):
                continue
            own = flat[start[x]:start[x + 1]]
            parts = [flat[start[k]:start[k + 1]] for k in near]
            joined = np.concatenate(parts)
            found = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
            both = np.add.reduceat(found, np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])), dtype=np.int64)
            for k in near[both * 100 >= (size[near] + size[x] - both) * percent]:
                if label[k] != label[x]:
                    a.append(ids[x])
                    b.append(ids[k])
                    label[label == label[k]] = label[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return verify


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


class NearDuplicates:
    """The search over one table; ``classes()`` gives its result."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5,
                 rows: int = 4, miss: float = 1e-6, margin: float = 0.22, trusted: int = 256, small: int = 16,
                 tile_rows: int = 512, tile_shingles: int = 1_000_000) -> None:
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.percent, self.width, self.rows = percent, width, rows
        self.bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
        self.cut, self.trusted, self.small = percent / 100 - margin, trusted, small
        self.tile_rows, self.tile_shingles = tile_rows, tile_shingles

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(id, shingles) of the wanted ids, recomputed from their texts. The ids grow with the table, so they are not broadcast."""
        texts = self.docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).alias("text"))
        some = texts.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi")
        return materialize(some.mapInArrow(_set_reader(self.width), "id long, shingles array<long>"), "sets")

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those that the registers' estimate does not rule out."""
        regs = self.reps.select("id", "regs", "n_shingles")
        sized = (pairs.join(regs.select(F.col("id").alias("a"), F.col("regs").alias("regs_a"), F.col("n_shingles").alias("n_a")), "a")
                 .join(regs.select(F.col("id").alias("b"), F.col("regs").alias("regs_b"), F.col("n_shingles").alias("n_b")), "b")
                 # the intersection is at most the smaller size and the union at least the larger one
                 .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent))
        return materialize(sized.mapInArrow(_estimator(self.cut, self.trusted), "a long, b long"), "likely")

    def _links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that reach the threshold on their full sets."""
        a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
        both = F.size(F.array_intersect("s", "t"))
        linked = pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.size("s") + F.size("t") - both) * self.percent)
        return materialize(linked.select("a", "b"), "linked")

    def _leaders(self, members: DataFrame) -> DataFrame:
        """Per bucket, the member with the most mass of buckets; ties go to the least id."""
        mass = members.groupBy("id").agg(F.sum("size").alias("mass"))
        ranked = members.join(mass, "id").select("key", F.struct(F.col("mass"), (-F.col("id")).alias("less")).alias("rank"))
        return ranked.groupBy("key").agg((-F.max("rank")["less"]).alias("leader"))

    def _tile_links(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links inside large buckets, compared tile by tile; every member's set travels once per tile of its bucket."""
        dealt = members.withColumn("tile", F.pmod(F.xxhash64("id", "key"), F.col("tiles")))
        full = dealt.join(self.reps.select("id", "regs", "n_shingles"), "id").join(sets, "id")
        met = (full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
               .select("key", "band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                       (F.col("tile") > F.col("other")).cast("int").alias("side"), "id", "root", "n_shingles", "regs", "shingles"))
        verify = _tile_verifier(self.percent, self.rows, self.cut, self.trusted)
        return materialize(met.groupBy("key", "i", "j").applyInArrow(verify, "a long, b long"), "tile-links")

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept — one row per input row."""
        registers = self.bands * self.rows
        sketch = materialize(sketches(self.docs, id_col=self.id_col, text_col=self.text_col, width=self.width, registers=registers), "sketch")
        named = sketch.where("n_shingles > 0 and doc_id is not null")
        self.reps = materialize(
            named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"), F.min_by("regs", "doc_id").alias("regs")), "reps")
        bands = self.reps.select("id", "n_shingles", F.posexplode(_band_keys(self.rows, self.bands)).alias("band", "key"))
        shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("mass")).where("size > 1")
        tiles = F.greatest(F.ceil(F.col("size") / self.tile_rows), F.ceil(F.col("mass") / self.tile_shingles))
        members = materialize(bands.join(shared.select("key", "size", tiles.alias("tiles")), "key").select("key", "band", "id", "size", "tiles"), "members")
        led = members.join(materialize(self._leaders(members), "leaders"), "key").where("id <> leader")
        rays = self._likely(led.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
        stars = self._links(rays, self._sets(ends(rays)))
        roots = components(stars)
        placed = materialize(led.join(roots, "id", "left").select("key", "band", "id", "size", "tiles", F.coalesce("root", "id").alias("root")), "placed")
        # a bucket whose members, without its leader, lie in one component holds no unsettled pair
        split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        unsettled = materialize(placed.join(split, "key"), "unsettled")
        few, many = unsettled.where(F.col("size") <= self.small), unsettled.where(F.col("size") > self.small)
        x, y = (few.select("key", F.col("id").alias(i), F.col("root").alias(r)) for i, r in (("a", "ra"), ("b", "rb")))
        crossing = self._likely(x.join(y, "key").where("a < b and ra <> rb").select("a", "b").distinct())
        sets = self._sets(ends(crossing).union(many.select("id")))
        roots = components(stars.union(self._links(crossing, sets)).union(self._tile_links(many, sets)))
        named_sets = materialize(self.reps.join(roots, "id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("root", "id").alias("root")), "classes")
        out = sketch.join(named_sets, ["set_a", "set_b", "n_shingles"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (least reachable doc_id), kept; see ``NearDuplicates`` for the options."""
    return NearDuplicates(docs, **options).classes()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group: the row whose id is its component's least one; rows with a null id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("not kept")
    dropped = materialize(found.select(F.col("doc_id").alias("_dropped")).distinct(), "near-dropped")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_same"), whole_row(docs).alias("_row"))
    kept = rows.join(dropped, F.col("_id") == F.col("_dropped"), "left_anti")
    ids = docs.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null")
    return one_of_repeats(kept, "_id", ["_id", "_same"], ids).select("_row.*")
