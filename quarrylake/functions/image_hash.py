"""Perceptual hashes of 32 x 32 grey grids (1024 bytes), as 64-bit patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SIDE, LOW = 32, 8


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos((2 * x + 1) * k * np.pi / (2 * SIDE))


def phash_bits(grids: np.ndarray) -> np.ndarray:
    """grids: n x 32 x 32. 63 bits: the low frequencies but the first against their mean. Only the horizontal frequency is scaled."""
    c = _cosines()
    scale = np.where(np.arange(LOW) == 0, 1 / np.sqrt(2), 1.0)
    f = 0.5 * scale * (c @ grids.astype(float) @ c.T)
    f = f.reshape(len(grids), LOW * LOW)[:, 1:]
    return f > f.mean(axis=1, keepdims=True)


def dhash_bits(grids: np.ndarray) -> np.ndarray:
    at = np.arange(9) * (SIDE - 1) // 8
    g = grids[:, at[:8]][:, :, at]
    return (g[:, :, :-1] < g[:, :, 1:]).reshape(len(grids), 64)


def packed(bits: np.ndarray) -> np.ndarray:
    """The first bit is the highest of those there are."""
    weights = np.uint64(1) << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.uint64)
    return (bits * weights).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _hashed(pixels: pd.Series, bits) -> pd.Series:
    ok = pixels.map(lambda p: p is not None and len(p) == SIDE * SIDE)
    out = pd.Series([None] * len(pixels), dtype="Int64", index=pixels.index)
    if ok.any():
        grids = np.frombuffer(b"".join(pixels[ok]), np.uint8).reshape(-1, SIDE, SIDE)
        out[ok] = packed(bits(grids))
    return out


@F.pandas_udf(LongType())
def phash(pixels: pd.Series) -> pd.Series:
    return _hashed(pixels, phash_bits)


@F.pandas_udf(LongType())
def dhash(pixels: pd.Series) -> pd.Series:
    return _hashed(pixels, dhash_bits)
