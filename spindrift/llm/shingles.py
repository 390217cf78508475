"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once.

Words are maximal runs of bytes other than space and 0x09-0x0D after lower-casing
A-Z. A text's set holds its distinct five-word shingles; a text with fewer words
has its whole sequence as the only element; a text without words has none.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, in order."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buf = _FOLD[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    space = _SPACE[buf]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    span = np.diff(np.append(starts, len(buf)))
    at = np.arange(starts[0], len(buf)) - np.repeat(starts, span)
    value = _BYTE[buf[starts[0]:]] * _powers(int(span.max()))[at]
    sums = np.add.reduceat(value, starts - starts[0])
    ends = np.cumsum(lengths + 1)
    return mix(sums), np.searchsorted(ends, starts, side="right")


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every distinct shingle, ordered by text then hash."""
    words, doc = word_hashes(texts)
    n = len(words)
    if not n:
        return words, doc
    coef = _powers(width + 1)
    per_doc = np.bincount(doc, minlength=len(texts))
    short = per_doc[doc] < width
    parts, owners = [], []
    if n >= width:
        last = n - width + 1
        whole = (doc[:last] == doc[width - 1:]) & ~short[:last]
        h = np.zeros(last, np.uint64)
        for j in range(width):
            h += words[j:j + last] * coef[j]
        parts.append(mix(h[whole] + np.uint64(width)))
        owners.append(doc[:last][whole])
    if short.any():
        d, w = doc[short], words[short]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        count = np.diff(np.append(first, len(d)))
        place = np.arange(len(d)) - np.repeat(first, count)
        parts.append(mix(np.add.reduceat(w * coef[place], first) + count.astype(np.uint64)))
        owners.append(d[first])
    h, d = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    return h[new], d[new]
