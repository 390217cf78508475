"""Chunking texts to a token budget, as one projection without a shuffle.

Decisions on documented-against-implemented behaviour: options that are left out
take the defaults and an overlap of 0 means none (``ChunkConfig.request`` gives the
request semantics in which 0 means default and overlap and separator are dropped);
``start_char`` and ``end_char`` follow the implemented arithmetic, which adds the
trimmed chunk's bytes and the separator's, whatever was really split on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import WHITE_HEX, from_hex, hex_bytes, len4, let, split_literal, to_hex, trim_hex, trim_unicode

CHUNK = "array<struct<text:string,start_char:bigint,end_char:bigint>>"
#: Names under which the fixed chunker is asked for; anything else is a model or falls back to it.
FIXED_MODELS = ("fixed", "fixed-bert-tokenizer", "fixed-bpe-tokenizer")


@dataclass(frozen=True)
class ChunkConfig:
    target_tokens: int = 500
    overlap_tokens: int = 50
    separator: str = "\n\n"
    max_chunks: int = 50
    threshold: float = 0.5

    def __post_init__(self) -> None:
        if self.overlap_tokens < 0:
            object.__setattr__(self, "overlap_tokens", 50)

    @classmethod
    def request(cls, target_tokens: int = 0, max_chunks: int = 0, threshold: float = 0.0, **_dropped: object) -> "ChunkConfig":
        """The service's reading of a request: zero is unset; overlap and separator do not reach the chunker."""
        return cls(target_tokens or 500, 50, "\n\n", max_chunks or 50, threshold or 0.5)

    def checked(self) -> "ChunkConfig":
        """Construction-time rule: the overlap must be smaller than the target."""
        if self.overlap_tokens >= self.target_tokens:
            raise ValueError("overlap_tokens must be less than target_tokens")
        return self


def sections(text: Column, separator: str) -> Column:
    """Parts by separator, else by line, else by sentence; trimmed, without blanks."""
    sentences = F.split(text, r"\. ", -1)
    ended = F.transform(sentences, lambda s, k: F.when(k < F.size(sentences) - 1, F.concat(s, F.lit("."))).otherwise(s))
    by_line, by_separator = F.split(text, "\n", -1), split_literal(text, separator)
    parts = F.when(F.size(by_separator) > 1, by_separator).when(F.size(by_line) > 1, by_line).otherwise(ended)
    return F.filter(F.transform(parts, trim_unicode), lambda s: s != "")


def fixed_chunks_hex(text: Column, config: ChunkConfig) -> Column:
    """Chunks of one text as structs of hexadecimal text, start_char and end_char.

    Parts are trimmed, so the text that a chunk gathers can have white space only
    at the front of its overlap; trimming that once keeps the fold's state trimmed.
    """
    gap, gap_bytes = config.separator.encode().hex().upper(), len(config.separator.encode())
    fresh = F.struct(F.lit("").alias("cur"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("tokens"), F.from_json(F.lit("[]"), CHUNK).alias("out"))

    def closed(acc: Column) -> Column:
        return F.array(F.struct(acc["cur"].alias("text"), acc["start"].alias("start_char"), (acc["start"] + hex_bytes(acc["cur"])).alias("end_char")))

    def add(acc: Column, part: Column) -> Column:
        room = F.size(acc["out"]) < config.max_chunks
        full = room & (acc["tokens"] > 0) & (acc["tokens"] + len4(part) > config.target_tokens)
        overlap = F.right(acc["cur"], F.lit(8 * config.overlap_tokens))
        opened = F.concat(F.regexp_replace(overlap, f"^({WHITE_HEX})+", ""), F.lit("20" + gap), part) if config.overlap_tokens else part
        carried = len4(overlap) if config.overlap_tokens else F.lit(0).cast("long")
        return F.struct(
            F.when(full, opened).when(~room, acc["cur"]).when(acc["cur"] != "", F.concat(acc["cur"], F.lit(gap), part)).otherwise(part).alias("cur"),
            F.when(full, acc["start"] + hex_bytes(acc["cur"]) + gap_bytes).otherwise(acc["start"]).alias("start"),
            (F.when(full, carried).otherwise(acc["tokens"]) + len4(part)).alias("tokens"),
            F.when(full, F.concat(acc["out"], closed(acc))).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        whole = F.array(F.struct(to_hex(trim_unicode(text)).alias("text"), F.lit(0).cast("long").alias("start_char"), F.octet_length(text).cast("long").alias("end_char")))
        return (F.when((acc["cur"] != "") & (F.size(acc["out"]) < config.max_chunks), F.concat(acc["out"], closed(acc)))
                .when(F.size(acc["out"]) == 0, whole).otherwise(acc["out"]))

    return F.aggregate(F.transform(sections(text, config.separator), to_hex), fresh, add, finish)


def cut_at_boundaries(raw: Column, entities: Column, config: ChunkConfig) -> Column:
    """Pieces of hexadecimal text between boundaries that a token classifier found (byte ends)."""
    size = hex_bytes(raw)
    named = F.filter(entities, lambda e: (F.startswith(F.lower(e["entity"]), F.lit("separator")) | F.endswith(F.lower(e["entity"]), F.lit("separator"))) & (e["score"] >= config.threshold))
    cuts = F.array_sort(F.array_distinct(F.filter(F.transform(named, lambda e: e["end"].cast("long")), lambda p: (p > 0) & (p <= size))))
    zero = F.array(F.lit(0).cast("long"))
    whole = F.array(F.struct(trim_hex(raw).alias("text"), F.lit(0).cast("long").alias("start_char"), size.alias("end_char")))

    def cut(at: Column) -> Column:
        spans = F.zip_with(F.concat(zero, at), F.concat(at, F.array(size)), lambda s, e: F.struct(
            trim_hex(F.substring(raw, (s * 2 + 1).cast("int"), ((e - s) * 2).cast("int"))).alias("text"), s.alias("start_char"), e.alias("end_char")))
        return F.filter(spans, lambda p: p["text"] != "")

    return let(let(cuts, cut), lambda pieces: F.when(F.size(pieces) == 0, whole).otherwise(pieces))


def join_to_target(pieces: Column, target_tokens: int, max_chunks: int) -> Column:
    """Consecutive pieces joined by a blank line while their token estimates fit the target."""
    fresh = F.struct(F.from_json(F.lit("[]"), CHUNK).alias("out"), F.lit(0).cast("long").alias("tokens"))

    def add(acc: Column, piece: Column) -> Column:
        n = len4(piece["text"])
        new = (F.size(acc["out"]) == 0) | ((acc["tokens"] > 0) & (acc["tokens"] + n > target_tokens))
        last = F.element_at(acc["out"], -1)
        grown = F.struct(F.concat(last["text"], F.lit("0A0A"), piece["text"]).alias("text"), last["start_char"].alias("start_char"), piece["end_char"].alias("end_char"))
        out = F.when(new, F.concat(acc["out"], F.array(piece))).otherwise(F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(grown)))
        return F.struct(out.alias("out"), F.when(new, n).otherwise(acc["tokens"] + n).alias("tokens"))

    def joined(found: Column) -> Column:
        return F.when(F.size(found) > 1, F.aggregate(found, fresh, add, lambda acc: acc["out"])).otherwise(found)

    return F.slice(let(pieces, joined) if target_tokens > 0 else pieces, 1, max_chunks)


def neural_chunks_hex(text: Column, entities: Column, config: ChunkConfig) -> Column:
    return let(to_hex(text), lambda raw: join_to_target(cut_at_boundaries(raw, entities, config), config.target_tokens, config.max_chunks))


def explode_chunks(docs: DataFrame, id_col: str, chunks: Column, text_col: str = "text") -> DataFrame:
    """One row per chunk: the id, chunk_id, text, start_char, end_char, n_tokens, chunk_md5. Empty and null texts give none."""
    each = docs.where(F.col(text_col) != "").select(id_col, F.posexplode(chunks).alias("chunk_id", "_c"))
    raw = F.col("_c.text")
    return each.select(id_col, "chunk_id", from_hex(raw).alias("text"), F.col("_c.start_char").alias("start_char"), F.col("_c.end_char").alias("end_char"),
                       len4(raw).alias("n_tokens"), F.md5(F.unhex(raw)).alias("chunk_md5"))


def chunk_fixed(docs: DataFrame, config: ChunkConfig = ChunkConfig(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return explode_chunks(docs, id_col, fixed_chunks_hex(F.col(text_col), config), text_col)


def chunk_neural(docs: DataFrame, config: ChunkConfig = ChunkConfig(), *, id_col: str = "doc_id", text_col: str = "text", entities_col: str = "entities") -> DataFrame:
    return explode_chunks(docs, id_col, neural_chunks_hex(F.col(text_col), F.col(entities_col), config), text_col)


def chunk_by_model(docs: DataFrame, models: DataFrame, config: ChunkConfig = ChunkConfig(), *, id_col: str = "doc_id", text_col: str = "text", model_col: str = "model", entities_col: str = "entities") -> DataFrame:
    """Dispatch on the requested model: known model names with entities use them, all else the fixed chunker.

    ``models`` has one ``name`` per registered chunker. Both the requested model and the one that was used come back.
    """
    known = docs.join(models.select(F.col("name").alias("_known")), F.col(model_col) == F.col("_known"), "left")
    neural = F.col("_known").isNotNull() & F.col(entities_col).isNotNull() & ~F.coalesce(F.col(model_col), F.lit("")).isin(*FIXED_MODELS)
    used = F.when(neural, F.col(model_col)).otherwise(F.when(F.col(model_col) == "fixed-bpe-tokenizer", F.col(model_col)).otherwise("fixed-bert-tokenizer"))
    chunks = F.when(neural, neural_chunks_hex(F.col(text_col), F.col(entities_col), config)).otherwise(fixed_chunks_hex(F.col(text_col), config))
    marked = known.withColumn("_key", F.struct(F.col(id_col).alias("id"), F.col(model_col).alias("requested_model"), used.alias("model_used")))
    return explode_chunks(marked, "_key", chunks, text_col).select(F.col("_key.id").alias(id_col), "_key.requested_model", "_key.model_used", "chunk_id", "text", "start_char", "end_char", "n_tokens", "chunk_md5")
