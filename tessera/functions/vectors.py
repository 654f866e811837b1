"""Hashed state vectors of texts, and the cosine of two vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 256


def state_vector(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hashed letters (0.5 each) and letter pairs (1 each; the last letter stands alone as one), scaled to
    length 1. The hash is h * 33 + code point from 5381, of 32 bits, for all places at once."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    one = (5381 * 33 + c) & np.uint64(0xFFFFFFFF)
    two = (one[:-1] * np.uint64(33) + c[1:]) & np.uint64(0xFFFFFFFF)
    pairs = np.r_[two, one[-1:]]
    v = 0.5 * np.bincount((one % np.uint64(size)).astype(np.int64), minlength=size) + np.bincount((pairs % np.uint64(size)).astype(np.int64), minlength=size)
    length = np.linalg.norm(v)
    return v / length if length else v


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length that are scaled to length 1; null if one is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
