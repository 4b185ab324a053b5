"""Vectorised text work on Arrow batches: words, word hashes, shingles and windows by NumPy.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D; in UTF-8 these bytes never lie
inside a longer character, so byte runs are the words of the contracts. Hashes are polynomials
modulo 2**64 taken from running sums, then mixed; they depend on the bytes alone. Memory is bounded
by the batch (blocks of about a million bytes are hashed at a time), not by any one document.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_FOLD = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
BLOCK = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def give_back() -> None:
    """Returns freed memory to the system, so that a Python worker that waits for its next task holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = int(BASES[which])
        base = pow(base, -1, 1 << 64) if inverse else base
        out = np.full(max(n, BLOCK + 1), U(base))
        out[0] = U(1)
        have = _POWERS[which, inverse] = np.cumprod(out, dtype=U)
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and their offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``most`` bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (and the end)."""
    inside = ~_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; ``lower`` folds A-Z first, ``which`` picks one of two independent hashes."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = starts[i], ends[j - 1]
        part = data[a:b]
        part = (_LOWER[part] if lower else part).astype(U) + U(1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * _powers(which, False, len(part))[: len(part)], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * _powers(which, True, len(part))[s] ^ (e - s).astype(U) * _FOLD[which]
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k words (over the whole array, document borders included), by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, have, power, level, step = None, 0, hashes, 1, int(_FOLD[which]) | 1
    while True:
        if k & level:
            out = power[: len(hashes) - level + 1] if out is None else out[: len(hashes) - have - level + 1] * U(step) + power[have : len(hashes) - level + 1]
            have += level
        if have == k:
            return mix(out ^ U(k))
        power = power[:-level] * U(step) + power[level:]
        step = (step * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF) | 1
        level *= 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its lower-cased k-word shingles; fewer words: one hash of all; none: empty."""
    starts, ends, at = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    grams = window_hashes(hashes, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out
