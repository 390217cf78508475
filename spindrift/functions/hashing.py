"""Hashes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis and prime of the 32-bit FNV-1a hash; fixed values.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv32a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    raw = F.hex(F.encode(text, "utf-8"))
    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    code = lambda k: F.conv(F.substring(raw, k * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), lambda h, k: (h.bitwiseXOR(code(k)) * FNV_PRIME) % (1 << 32))


def request_key(*parts: Column) -> Column:
    """A collision-safe key of several parts: every part carries its length."""
    framed = [F.concat(F.octet_length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)


def chunk_key(text: Column, model: Column, target: Column, overlap: Column, separator: Column, max_chunks: Column, threshold: Column) -> Column:
    """Key of a chunk request; the threshold counts to three decimals."""
    return request_key(model, target, overlap, separator, max_chunks, F.format_string("%.3f", threshold.cast("double")), F.sha2(text, 256))


def rerank_key(model: Column, query: Column, prompts: Column) -> Column:
    numbered = F.transform(prompts, lambda p, k: F.concat((k % 65536).cast("string"), F.lit(":"), F.octet_length(p).cast("string"), F.lit(":"), p))
    return request_key(model, query, F.array_join(numbered, "|"))
