"""Whole-batch word splitting and hashing of UTF-8 text with numpy.

Words are runs of bytes of a class. Every byte of a multi-byte character is above 0x7F, so a class that is given over
ASCII, with all other characters in or out, is exact on bytes. A word's hash is a sum of table values times powers of
an odd number modulo 2**64, finished with a mixer, so that no per-word Python code runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text handled at once; a longer document is handled alone
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of words in the contract's two word patterns (the second after lower-casing A-Z).
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them and their end) for consecutive rows of a string column.

    A null is an empty text.
    """
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in order, and for each row the index of its first word (and the total)."""
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, np.zeros(len(offsets), np.int64)
    inside = kind[buf]
    edge = np.empty(n, bool)
    edge[0] = inside[0]
    edge[1:] = inside[1:] & ~inside[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    edge[inner] = inside[inner]  # a word never runs from one row into the next
    starts = np.flatnonzero(edge)
    stop = np.empty(n, bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & ~inside[1:]
    cut = inner[inner > 0] - 1
    stop[cut] = inside[cut]
    ends = np.flatnonzero(stop) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    power, inverse = _grown(n)
    part = _BYTE[buf]
    part *= power[:n]
    part[~inside] = 0
    h = mix(np.add.reduceat(part, starts) * inverse[starts])
    return h, starts, ends, np.searchsorted(starts, offsets)


def hash_words(texts: list[str]) -> np.ndarray:
    """The hash of each text taken as one word."""
    out = np.zeros(len(texts), np.uint64)
    for lo, buf, off in slices(pa.array(texts, pa.string())):
        power, inverse = _grown(max(1, len(buf)))
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * power[: len(buf)], dtype=np.uint64)])
        out[lo : lo + len(off) - 1] = mix((c[off[1:]] - c[off[:-1]]) * inverse[np.minimum(off[:-1], len(inverse) - 1)])
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n])
    return out
