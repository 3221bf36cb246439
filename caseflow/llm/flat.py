"""Words and word hashes of many texts at once, as flat numpy arrays over their UTF-8 bytes.

All functions work on slices of about a megabyte, so that a task's memory does not depend on how long texts are or how
many rows a batch has (one text is the least that is worked on at a time).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, np.uint64)


def trim() -> None:
    """Gives freed memory back to the system: workers live on between stages, and what they keep counts against executors."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if give is not None:
        give(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, ends of rows in bytes starting with 0); null texts are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if texts.null_count == 0 else texts.is_valid().to_numpy(zero_copy_only=False)
    begin = 0
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1
        end = min(n, max(end, begin + 1))
        own, ends = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        if not valid[begin:end].all():  # a null may have bytes
            own = np.concatenate([own[ends[k] : ends[k + 1]] for k in range(end - begin) if valid[begin + k]] or [own[:0]])
            ends = np.concatenate([[0], np.cumsum(np.where(valid[begin:end], np.diff(ends), 0))])
        yield begin, end, own, ends
        begin = end


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, its row, the number of words before each row and in all)."""
    global _powers
    n, rows = len(data), len(ends) - 1
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = ends[:-1][ends[:-1] < ends[1:]]
    first[at] |= inside[at]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    before = np.searchsorted(starts, ends, "left")
    span = np.diff(starts, append=n)
    place = np.arange(starts[0], n) - np.repeat(starts, span)
    if (longest := int(span.max())) > len(_powers):
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest * 2, _STEP | np.uint64(1)))])
    body = data[starts[0] :]
    values = _BYTE[_LOWER[body]] * _powers[place]
    values[~inside[starts[0] :]] = 0
    h = mix(np.add.reduceat(values, starts - starts[0]))
    return h, np.repeat(np.arange(rows), np.diff(before)), before


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one text; of fewer words, one hash of them all; of none, nothing."""
    if len(h) == 0:
        return h
    if len(h) < size:
        return mix((h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * _PLACE[k]
    return mix(out)
