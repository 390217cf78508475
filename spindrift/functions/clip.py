"""Pre- and post-processing for CLIP-style models: text to ids, images to planes, projection."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from spindrift.functions.vectors import dot, l2_normalize


@dataclass(frozen=True)
class ClipConfig:
    projection_dim: int = 512
    hidden_size: int = 768
    image_size: int = 224
    patch_size: int = 32
    max_length: int = 77
    bos: int = 49406
    eos: int = 49407
    #: Channel statistics of the published model; fixed values.
    mean: tuple[float, float, float] = (0.48145466, 0.4578275, 0.40821073)
    std: tuple[float, float, float] = (0.26862954, 0.26130258, 0.27577711)

    @classmethod
    def load(cls, folder: str) -> "ClipConfig":
        """The first of the two config files with a positive projection size; else the defaults."""
        for name in ("clip_config.json", "config.json"):
            path = Path(folder) / name
            if path.exists() and json.loads(path.read_text()).get("projection_dim", 0) > 0:
                raw = json.loads(path.read_text())
                return cls(projection_dim=raw["projection_dim"], image_size=raw.get("vision_config", {}).get("image_size", cls.image_size))
        return cls()


def tokenize(text: str, vocabulary: dict[str, int], config: ClipConfig = ClipConfig()) -> list[int]:
    """Ids between the two end marks: by spaced word, by word, else by character; unknown characters drop out; the end mark survives truncation."""
    ids = [config.bos]
    for word in text.lower().split():
        whole = vocabulary.get(f" {word}", vocabulary.get(word))
        ids += [whole] if whole is not None else [vocabulary[c] for c in word if c in vocabulary]
    ids.append(config.eos)
    return ids if len(ids) <= config.max_length else [*ids[:config.max_length - 1], config.eos]


def tokenize_udf(vocabulary_path: str, config: ClipConfig = ClipConfig()):
    """Column function: text to struct(ids padded with 0, mask)."""
    @F.pandas_udf("ids array<int>, mask array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = json.loads(Path(vocabulary_path).read_text())["model"]["vocab"]
        for texts in batches:
            rows = [tokenize(t or "", vocabulary, config) for t in texts]
            pad = config.max_length
            yield pd.DataFrame({"ids": [r + [0] * (pad - len(r)) for r in rows], "mask": [[1] * len(r) + [0] * (pad - len(r)) for r in rows]})
    return run


def read_png(raw: bytes) -> np.ndarray:
    """Height x width x 3 bytes of an 8-bit, non-interlaced grey, RGB or RGBA image."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8:at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("unsupported PNG")
    width, height, depth = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height, width * depth), np.uint8)
    above = np.zeros(width * depth, np.int64)
    for y in range(height):
        mode, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if mode == 2:
            line = (line + above) % 256
        elif mode:
            for x in range(len(line)):
                left, corner = (line[x - depth], above[x - depth]) if x >= depth else (0, 0)
                if mode == 1:
                    guess = left
                elif mode == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) % 256
        out[y], above = line, line
    pixels = out.reshape(height, width, depth)
    return np.repeat(pixels, 3, axis=2) if depth == 1 else pixels[:, :, :3]


def preprocess(pixels: np.ndarray, config: ClipConfig = ClipConfig()) -> np.ndarray:
    """Nearest-neighbour resize to a square, scale to 0-1, normalise, channels first."""
    side, (height, width) = config.image_size, pixels.shape[:2]
    small = pixels[(np.arange(side) * height // side)[:, None], (np.arange(side) * width // side)[None, :]]
    return ((small.astype(np.float32) / 255 - np.float32(config.mean)) / np.float32(config.std)).transpose(2, 0, 1)


def preprocess_udf(config: ClipConfig = ClipConfig()):
    """Column function: PNG bytes to a flat channel-first plane; null stays null."""
    @F.pandas_udf(ArrayType(FloatType()))
    def run(images: pd.Series) -> pd.Series:
        return images.map(lambda raw: None if raw is None else preprocess(read_png(raw), config).ravel())
    return run


def project(vector: Column, matrix: list[list[float]]) -> Column:
    """Matrix times vector, then unit length."""
    rows = F.array(*[dot(F.array(*[F.lit(float(x)) for x in row]), vector).cast("float") for row in matrix])
    return l2_normalize(rows)


def first_vector(*vectors: Column) -> Column:
    """The vector of the first part of an item that produced one."""
    return F.coalesce(*vectors)
