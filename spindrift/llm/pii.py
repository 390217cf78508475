"""Personal data: fixed patterns plus a character-level BiLSTM-CRF.

The patterns give the base spans (email, ip, card, phone) of every whole text.
The tagger adds spans of forms that the patterns miss (kinds ``email_like`` to
``phone_like``): addresses written out with "at" and "dot" or with spaces, national
telephone numbers, numbers broken by a line end, and numbers of a card's form whose
check digit is wrong. It is trained in numpy from labelled spans and reads every
text whole in overlapping windows. Decoded spans are reconciled over the text: a
span that a window's edge cuts is left to the neighbour that sees it whole; pieces
of one kind that overlap are joined; of overlapping kinds the longer one stays
among those that hold, and a span that meets a base span goes.

Offsets are code points, end exclusive.

Nulls and edge cases: a null text is empty and has no spans. Ids must be integers
or castable to them; a null id is kept. Rows repeated whole give their own rows.
Other columns are ignored. An empty table gives an empty table. Very long texts are
read whole, their windows in chunks, in time linear in length and spans.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_parts import text_parts
from .char_tagger import Tagger, char_ids, train

KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match that fails from the first digit of a run fails from every other digit of it too
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EVIDENCE = re.compile(r"[0-9@]")
#: Windows of training; of reading (their lengths in steps of LENGTHS for a text's last one) and how far they lie apart; windows at a time.
SAMPLE, WINDOW, STRIDE, CHUNK = 96, 576, 512, 512
LENGTHS = (64, 128, 256, 384, WINDOW)
PART_BYTES = 1 << 20
AT_SIGN = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The email pattern, found from each ``@`` outwards, which stays linear on long runs."""
    out: list[tuple[int, int]] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def digits_of(raw: str) -> str:
    return "".join(c for c in raw if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    if not EVIDENCE.search(text):
        return {k: [] for k in KINDS}
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(map(_small, m[0].split(".")))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15],
    }


def plausible(kind: str, raw: str) -> bool:
    """What an added span of a kind must look like."""
    digits = digits_of(raw)
    if kind == "email":
        return bool(AT_SIGN.search(raw)) and bool(re.search(r"[A-Za-z]{2}", raw))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", raw)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == "card":
        return 15 <= len(digits) <= 19 and not re.search(r"[A-Za-z]", raw)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", raw) and bool(re.search(r"[^0-9]", raw))


def labelled_texts(rows: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans, in the patterns' forms and in others, among look-alikes without a label."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        w = "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "é", "ü", "ñ", "ou", "st", "ing", "a", "le"]) for _ in range(rng.randint(1, 4)))
        return w.capitalize() if rng.random() < 0.15 else w

    def card() -> str:
        body = number(15)
        return body + (next(d for d in "0123456789" if luhn(body + d)) if rng.random() < 0.5 else number(1))

    def entity(kind: str) -> str:
        if kind == "email":
            user = rng.choice([word(), f"{word()}.{number(2)}", f"{word()}_{word()}", word() + number(3)]).encode("ascii", "ignore").decode() or "me"
            host = f"{rng.choice(['mail', 'example', 'inbox', 'post'])}{rng.choice(['', number(1)])}.{rng.choice(['com', 'org', 'example.com', 'net', 'de'])}"
            shut = rng.choice(["[]", "()", "{}"])
            written = lambda word: f"{rng.choice(['', ' '])}{shut[0]}{word}{shut[1]}{rng.choice(['', ' '])}"
            spelled = user + written("at") + host.replace(".", written("dot"))
            return rng.choice([f"{user}@{host}", f"{user} @ {host}", f"{user}@{host.split('.')[0]}", f"{user}@{host.replace('.', ' . ')}", spelled, f"{user}{written('at')}{host}"])
        if kind == "ip":
            parts = [str(rng.randint(1, 255)) for _ in range(4)]
            return rng.choice([".".join(parts), ".".join(parts), "[.]".join(parts), " . ".join(parts)])
        if kind == "card":
            d = card()
            sep = rng.choice(["", "", "", " ", "-", ".", "/"])
            parts = [d[k:k + 4] for k in range(0, 16, 4)]
            if sep and rng.random() < 0.2:  # broken by a line end
                k = rng.randint(1, 3)
                return sep.join(parts[:k]) + "\n" + sep.join(parts[k:])
            return sep.join(parts)
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+44 {number(4)} {number(6)}", f"+{number(2)}-{a}-{b}-{c}", f"({a}) {b} {c}", f"0{number(2)} / {number(7)}", f"{a}.{b}.{c}", f"+1 ({a})\n{b}-{c}"])

    def decoy() -> str:
        return rng.choice([
            f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}", f"1{number(1)}:{rng.randint(10, 59)}", f"{number(1)}.{number(1)}.{number(2)}", f"${number(3)}.{number(2)}", number(rng.randint(1, 7)),
            f"{number(2)},{number(3)}", hashlib.md5(number(9).encode()).hexdigest(), f"@{word()}", f"v{number(1)}.{number(2)}", f"CC BY-NC {number(1)}.0", f"{number(4)}-{number(4)}", f"No. {number(5)}", f"{number(2)}%", number(rng.randint(20, 30)), f"token = \"{hashlib.sha1(number(9).encode()).hexdigest()}\""])

    out = []
    for _ in range(rows):
        text, spans = "", []
        while len(text) < SAMPLE + SAMPLE // 2:
            roll = rng.random()
            if roll < 0.10:
                kind = rng.choice(KINDS)
                e = entity(kind)
                spans.append((kind, len(text), len(text) + len(e)))
                text += e + rng.choice([" ", " ", ". ", ", ", "### ", "!! "])
            elif roll < 0.18:
                text += decoy() + rng.choice([" ", ". ", ", "])
            else:
                text += word() + rng.choice([" "] * 8 + [". ", ", ", ".\n", "### ", "*** ", " | "])
        out.append((text, spans))
    return out


def windows_of(texts: list[tuple[str, list[tuple[str, int, int]]]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One window of ids and tags per labelled text, at a random place."""
    rng = np.random.default_rng(seed)
    ids, tags = np.zeros((len(texts), SAMPLE), np.int64), np.zeros((len(texts), SAMPLE), np.int64)
    for k, (text, spans) in enumerate(texts):
        at = int(rng.integers(0, len(text) - SAMPLE + 1))
        tag = np.zeros(len(text), np.int64)
        for kind, s, e in spans:
            tag[s:e] = 2 + 2 * KINDS.index(kind)
            tag[s] -= 1
        ids[k], tags[k] = char_ids(text)[at:at + SAMPLE], tag[at:at + SAMPLE]
    return ids, tags


@functools.cache
def fit_tagger(rows: int = 4000, epochs: int = 12, seed: int = 11) -> Tagger:
    """The tagger trained on ``rows`` labelled texts; kept for the life of the process."""
    return train(*windows_of(labelled_texts(rows, seed), seed), 1 + 2 * len(KINDS), epochs=epochs, seed=seed)


def spans_of_paths(paths: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """(row, kind, start, end) of the runs of one kind in decoded paths; a begin tag or another kind starts a new run."""
    kind = (paths + 1) // 2
    edge = np.ones(paths.shape, bool)
    edge[:, 1:] = (kind[:, 1:] != kind[:, :-1]) | (paths[:, 1:] % 2 == 1)
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], paths.size)
    some = kind.ravel()[at] > 0
    at, ends = at[some], ends[some]
    row = at // max(paths.shape[1], 1)
    base = row * paths.shape[1]
    for r, k, s, e in zip(row.tolist(), kind.ravel()[at].tolist(), (at - base).tolist(), (ends - base).tolist(), strict=True):
        yield r, KINDS[k - 1], s, e


def spans_of_path(path: np.ndarray) -> list[tuple[str, int, int]]:
    """The runs of one decoded path."""
    return [run[1:] for run in spans_of_paths(np.asarray(path)[None])]


def reconcile(found: list[tuple[str, int, int]], holds: Callable[[str, int, int], bool] = lambda kind, s, e: True) -> list[tuple[str, int, int]]:
    """Join spans of one kind that overlap, then keep, of those that hold, the longer of overlapping kinds (ties: the earlier)."""
    joined: list[tuple[str, int, int]] = []
    for kind in KINDS:
        last: list[int] | None = None
        for s, e in sorted((s, e) for k, s, e in found if k == kind):
            if last and s < last[1]:
                last[1] = max(last[1], e)
            else:
                if last:
                    joined.append((kind, *last))
                last = [s, e]
        if last:
            joined.append((kind, *last))
    free, kept = Free(), []
    for k, s, e in sorted(joined, key=lambda x: (x[1] - x[2], x[1])):
        if holds(k, s, e) and free.take(s, e):
            kept.append((k, s, e))
    return sorted(kept, key=lambda x: x[1])


class Free:
    """Which places of a text no span has taken yet."""

    def __init__(self, taken: list[tuple[int, int]] | None = None) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(taken or []):  # joined, because base spans of different kinds may overlap
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def has(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e) - 1  # the last taken span that starts before e
        return k < 0 or self.ends[k] <= s

    def take(self, s: int, e: int) -> bool:
        if not self.has(s, e):
            return False
        k = bisect.bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)
        return True


def windows(size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows of a text; only the last one is shorter than ``WINDOW``."""
    start = 0
    while start < size:
        yield start, min(start + WINDOW, size)
        if start + WINDOW >= size:
            return
        start += STRIDE


def own_span(s: int, e: int, start: int, end: int, size: int) -> bool:
    """Whether a window's span is not one that the window's edge cuts and a neighbour sees whole."""
    cut_left = s == start > 0 and e <= start - STRIDE + WINDOW
    cut_right = e == end < size and s >= start + STRIDE
    return not (cut_left or cut_right)


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in " \n\t,;:":
        s += 1
    while e > s and text[e - 1] in " \n\t,;:.":
        e -= 1
    return s, e


def tagged(texts: list[str], model: Tagger) -> list[list[tuple[str, int, int]]]:
    """The tagger's reconciled spans of every text; every window of every text is read."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    waiting: dict[int, list[tuple[int, int, int, np.ndarray]]] = {n: [] for n in LENGTHS}

    def flush(length: int) -> None:
        some = waiting[length]
        ids = np.zeros((len(some), length), np.int64)
        for row, (_, _, _, part) in zip(ids, some, strict=True):
            row[:len(part)] = part
        paths = model.decode(ids) if some else ids
        rows = np.flatnonzero(paths.any(1))
        for k, kind, s, e in spans_of_paths(paths[rows]):
            text, start, end, _ = some[rows[k]]
            s, e = s + start, min(e + start, end)  # what stands behind a text's end is padding
            if s < e and own_span(s, e, start, end, len(texts[text])):
                found[text].append((kind, s, e))
        some.clear()

    for k, text in enumerate(texts):
        ids = char_ids(text)
        for start, end in windows(len(ids)):
            length = next(n for n in LENGTHS if end - start <= n)
            waiting[length].append((k, start, end, ids[start:end]))
            if len(waiting[length]) == CHUNK:
                flush(length)
    for length in LENGTHS:
        flush(length)
    out = []
    for text, spans in zip(texts, found, strict=True):
        bare = [(kind, s, e) for kind, s, e in ((kind, *_trimmed(text, s, e)) for kind, s, e in spans) if s < e]
        out.append(reconcile(bare, lambda k, s, e, text=text: plausible(k, text[s:e])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: n for n, k in enumerate(KINDS + [f"{k}_like" for k in KINDS])}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1])))


def _finder(model: Tagger):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches, limit=PART_BYTES):
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base_hash, spans = [], []
            for text, extra in zip(texts, tagged(texts, model), strict=True):
                base = base_spans(text)
                flat = [(k, s, e) for k in KINDS for s, e in base[k]]
                free = Free([(s, e) for _, s, e in flat])
                more = [(f"{k}_like", s, e) for k, s, e in extra if free.has(s, e)]
                for k in KINDS:
                    counts[k].append(len(base[k]))
                base_hash.append(hashlib.sha256(joined(flat).encode()).hexdigest())
                spans.append(joined(flat + more))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base_hash, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return find


def find_personal_data(docs: DataFrame, model: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) — one row per input row."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(_finder(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: str) -> str:
    """``text`` with every span of a ``spans`` string replaced by its kind in brackets."""
    at = sorted({(int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)})
    out, last = [], 0
    for s, e, k in at:
        if s >= last:
            out += [text[last:s], f"[{k.upper()}]"]
        last = max(last, e)
    return "".join(out) + text[last:]
