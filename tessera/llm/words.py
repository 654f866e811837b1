"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Bytes of all texts of an Arrow column are handled together. Word ends are single ASCII bytes, so
UTF-8 needs no decoding. A word's hash doesn't depend on where it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 17  # bytes hashed together

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Space and the bytes 09 to 0D end a word.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but letters and digits end a word.
MARKS = np.zeros(256, dtype=bool)
MARKS[:128] = [not chr(i).isalnum() for i in range(128)]

_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.r_[np.uint64(1), np.full(n, _P, dtype=np.uint64)], dtype=np.uint64)
            _INV = np.cumprod(np.r_[np.uint64(1), np.full(n, _P_INV, dtype=np.uint64)], dtype=np.uint64)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def unique(values: np.ndarray) -> np.ndarray:
    """Distinct values in rising order. np.unique hashes 64-bit integers, which takes ten times as long."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts and ends in them. Null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


class Words:
    """``hash[i]``, ``start[i]`` and ``end[i]`` (bytes in ``raw``) of word i; text k has the words
    ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, column: pa.Array, ends: np.ndarray = SPACES):
        raw, at = text_bytes(column)
        self.raw, self.at = raw, at
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[at] = True
        inside = ~ends[raw]
        before = np.r_[False, inside[:-1]] if len(raw) else inside
        after = np.r_[inside[1:], False] if len(raw) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        k = 0
        while k < len(self.start):  # blocks of whole words, for memory
            lo = self.start[k]
            j = max(k + 1, int(np.searchsorted(self.end, lo + _BLOCK, side="right")))
            hi = self.end[j - 1]
            part = _LOWER[raw[lo:hi]].astype(np.uint64) + np.uint64(1)
            pow_, inv = _powers(len(part))
            with np.errstate(over="ignore"):
                total = np.r_[np.uint64(0), np.cumsum(part * pow_[: len(part)], dtype=np.uint64)]
                s, e = self.start[k:j] - lo, self.end[k:j] - lo
                self.hash[k:j] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
            k = j

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, its text's number."""
        return np.repeat(np.arange(len(self)), self.counts())


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each): runs of n words; the whole sequence of a text of fewer words."""
    h, counts = words.hash, words.counts()
    text = words.text_of()
    with np.errstate(over="ignore"):
        if len(h) >= n:
            run = np.zeros(len(h) - n + 1, dtype=np.uint64)
            for j in range(n):
                run = (run + h[j : len(h) - n + 1 + j]) * _P + np.uint64(j)
            whole = text[: len(run)] == text[n - 1 :]
            out, of = mix(run[whole]), text[: len(run)][whole]
        else:
            out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            own = np.zeros(len(few), dtype=np.uint64)
            for j in range(n - 1):
                has = counts[few] > j
                own[has] = (own[has] + h[words.first[few[has]] + j]) * _P + np.uint64(j + 1000)
            out, of = np.r_[out, mix(own + counts[few].astype(np.uint64))], np.r_[of, few]
    return out, of


def distinct(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and where each text starts (n + 1 places)."""
    order = np.argsort(values)
    order = order[np.argsort(of[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]  # short integers are sorted by radix
    values, of = values[order], of[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (of[1:] != of[:-1])]
        values, of = values[new], of[new]
    return values, np.searchsorted(of, np.arange(n + 1))
