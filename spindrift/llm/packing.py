"""Packing documents into fixed token sequences by shortest-pack-first over the length histogram.

A document's ids (byte-level BPE, then one end id) are cut every ``size`` ids;
the rest is one shorter piece. Only the histogram of piece lengths, at most
``size`` rows, reaches the driver. There lengths are placed longest first: each
goes to the open packs with the smallest sum, as counts of packing patterns, not
pack by pack. A pattern with count c becomes c sequences. Pieces are ranked
within their length and meet their pattern's slot by that rank. Ranks need no
task that sees a whole length: pieces are ranked in buckets of a length, and the
buckets' counts (a bounded number) give each bucket's first rank.

Frequent words are encoded once per task by the tokenizer's own BPE model; texts
are split at single spaces that follow a non-space, where the tokenizer's pattern
always splits too. A memo keeps two generations of ``MEMO`` words of at most
``LONGEST`` characters and ends with its task. Words outside Latin script go to
the tokenizer whole.

Nulls and edge cases: a null or empty text has the end id only. Rows repeated
whole are packed as often as they occur; a null id is kept. Other columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow_parts import text_parts
from .workspace import materialize

#: Words of one generation of a memo, and the longest word that is kept.
MEMO, LONGEST = 200_000, 64
#: The white space that the tokenizer's pattern knows, as the inside of a character class.
SPACES = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
AFTER_SPACE = re.compile(f"[{SPACES}] ")
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{SPACES}{_LETTERS}{_NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@functools.cache
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return tokenizer


class WordMemo(dict):
    """Word to its ids as little-endian 32-bit integers; fills itself. When it is full, it becomes the old generation."""

    def __init__(self, tokenizer, lead: str) -> None:
        super().__init__()
        self.tokenizer, self.lead, self.alphabet = tokenizer, lead, _byte_alphabet()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        raw = self.old.get(word) or self.ids(self.lead + word)
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = raw
        return raw

    def ids(self, text: str) -> bytes:
        bare = text[len(self.lead):]
        if bare.isascii() and bare.isalpha():  # one piece whose bytes stand for themselves
            return array("I", [t.id for t in self.tokenizer.model.tokenize(self.lead.translate(self.alphabet) + bare)]).tobytes()
        if BEYOND_LATIN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            model, alphabet = self.tokenizer.model, self.alphabet
            ids = [t.id for piece in PIECE.findall(text) for t in model.tokenize(piece.encode().decode("latin-1").translate(alphabet))]
        return np.array(ids, dtype="<u4").tobytes() if len(ids) > 64 else array("I", ids).tobytes()


class Encoder:
    """Texts to their ids; the memos live as long as the encoder, which is one task's."""

    def __init__(self, vocabulary: str) -> None:
        self.plain, self.spaced = WordMemo(_tokenizer(vocabulary), ""), WordMemo(_tokenizer(vocabulary), " ")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if AFTER_SPACE.search(text):
            return b"".join(map(self.plain.__getitem__, CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


def encode(text: str, vocabulary: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit integers."""
    return Encoder(vocabulary)(text)


def _cutter(vocabulary: str, size: int, end_id: int):
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in text_parts(batches):
            row, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(part.column(1).to_pylist()):
                raw = encoder(text or "") + tail
                n = len(raw) // 4
                for s in range(0, n, size):
                    row.append(k)
                    start.append(s)
                    length.append(min(size, n - s))
                    crc.append(zlib.crc32(raw[4 * s:4 * (s + size)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return cut


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with the number of packs of each."""
    by_sum: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    shortest = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            open_sums = [s for s in by_sum if s + length <= size and by_sum[s]]
            if not open_sums:
                by_sum[length][(length,)] = by_sum[length].get((length,), 0) + left
                break
            shortest = min(open_sums)
            pattern, count = next(iter(by_sum[shortest].items()))
            take = min(left, count)
            if take == count:
                del by_sum[shortest][pattern]
            else:
                by_sum[shortest][pattern] = count - take
            grown = (*pattern, length)
            by_sum[shortest + length][grown] = by_sum[shortest + length].get(grown, 0) + take
            left -= take
    return [(p, c) for s in sorted(by_sum) for p, c in by_sum[s].items()]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For every slot of every pattern: its length, first rank, first sequence and place in the sequence."""
    used: dict[int, int] = defaultdict(int)
    length, rank, first, place, base = [], [], [], [], 0
    for pattern, count in patterns:
        at = 0
        for piece in pattern:
            length.append(piece)
            rank.append(used[piece])
            first.append(base)
            place.append(at)
            used[piece] += count
            at += piece
        base += count
    out = {k: np.array(v, dtype=np.int64) for k, v in (("length", length), ("rank", rank), ("first", first), ("place", place))}
    order = np.lexsort((out["rank"], out["length"]))
    return {k: v[order] for k, v in out.items()}


def _placer(slots: dict[str, np.ndarray], starts: dict[str, np.ndarray]):
    slot_key = slots["length"] << 44 | slots["rank"]
    start_key = starts["length"] << 44 | starts["bucket"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n).to_numpy() for n in ("length", "bucket", "at")}
            rank = starts["start"][np.searchsorted(start_key, col["length"] << 44 | col["bucket"])] + col["at"]
            slot = np.searchsorted(slot_key, col["length"] << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
                 pa.array(slots["first"][slot] + rank - slots["rank"][slot]), pa.array(slots["place"][slot])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return place


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1,
         least_bucket: int = 256, most_buckets: int = 20_000) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(two.mapInArrow(_cutter(vocabulary, size, end_id), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slot_table(shortest_pack_first(histogram, size))
    # at most most_buckets + size buckets over all lengths, so their counts fit the driver at any scale
    per_bucket = max(least_bucket, -(-sum(histogram.values()) // most_buckets))
    buckets = F.greatest(F.lit(1), F.ceil(F.element_at(F.create_map(*[F.lit(x) for k, v in histogram.items() for x in (k, v)]), F.col("length")) / per_bucket)) if histogram else F.lit(1)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), buckets.cast("long")))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    starts: dict[str, list[int]] = {"length": [], "bucket": [], "start": []}
    run: dict[int, int] = defaultdict(int)
    for r in sorted(counts, key=lambda r: (r["length"], r["bucket"])):
        starts["length"].append(r["length"])
        starts["bucket"].append(r["bucket"])
        starts["start"].append(run[r["length"]])
        run[r["length"]] += r["n"]
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")).cast("long") - 1)
    placed = _placer(slots, {k: np.array(v, dtype=np.int64) for k, v in starts.items()})
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")
