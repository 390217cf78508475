"""The binary vector stream: little-endian uint64 count, uint64 dimension (absent for count 0), float32 rows.

The dimension is the first row's; rows of other lengths are written as they are,
as the format has no check, and a stream that is too short is an error naming
where reading stopped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def serialize(rows: list) -> bytes:
    if not len(rows):
        return struct.pack("<Q", 0)
    return struct.pack("<QQ", len(rows), len(rows[0])) + b"".join(np.asarray(r, "<f4").tobytes() for r in rows)


def deserialize(raw: bytes) -> list[np.ndarray]:
    if len(raw) < 8:
        raise ValueError("reading number of vectors: unexpected end")
    count = struct.unpack_from("<Q", raw)[0]
    if count == 0:
        return []
    if len(raw) < 16:
        raise ValueError("reading dimension: unexpected end")
    dim = struct.unpack_from("<Q", raw, 8)[0]
    have = (len(raw) - 16) // 4
    if have < count * dim:
        raise ValueError(f"reading vector {have // dim}, dimension {have % dim}: EOF")
    return list(np.frombuffer(raw, "<f4", count * dim, 16).reshape(count, dim))


def encode_blocks(vectors: DataFrame, key: str, id_col: str, vector_col: str, block_rows: int = 4096) -> DataFrame:
    """Binary streams of at most about ``block_rows`` vectors: key, block, ids, payload.

    Blocks are dealt by a hash of the id, so no key gathers in one task.
    """
    sizes = vectors.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    dealt = vectors.join(sizes, key).select(key, F.pmod(F.xxhash64(id_col), F.col("_blocks")).alias("block"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return pa.table({key: table.column(key)[:1], "block": table.column("block")[:1], "ids": pa.array([table.column("id").to_pylist()]), "payload": pa.array([serialize(table.column("vector").to_pylist())], pa.binary())})

    kinds = {n: dealt.schema[n].dataType.simpleString() for n in (key, "id")}
    return dealt.groupBy(key, "block").applyInArrow(encode, f"{key} {kinds[key]}, block long, ids array<{kinds['id']}>, payload binary")


def decode_blocks(blocks: DataFrame, payload_col: str = "payload") -> DataFrame:
    """``blocks`` with a ``vectors`` column in place of the payload."""
    rest = [c for c in blocks.columns if c != payload_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if raw is None else deserialize(raw) for raw in batch.column(payload_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(vectors, pa.list_(pa.list_(pa.float32())))], [*rest, "vectors"])

    fields = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in rest)
    return blocks.select(*rest, payload_col).mapInArrow(decode, f"{fields}, vectors array<array<float>>")
