"""Whole Arrow batches of texts as bytes: spans, words and their hashes, without a loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Texts are worked on together up to so many bytes, as arrays of their words and runs are up to a hundred times as large;
#: a longer text is worked on alone.
ROUND_BYTES = 1 << 17

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the control characters from tab to carriage return end a word.
IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True

_random = np.random.default_rng(20240501)
_BYTE_VALUE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Module caches of worker processes: emptied when a task ends, as workers live on into other operators' tasks.
CACHES: list[dict] = []


def remembered(cache: dict) -> dict:
    """`cache`, emptied at the end of every task that `tidy` wraps."""
    CACHES.append(cache)
    return cache


_powers: dict[str, np.ndarray] = remembered({})


def tidy(work: Callable, keep: tuple[dict, ...] = ()) -> Callable:
    """`work` over batches that at its end gives freed memory back, as workers live on between tasks.

    Caches of `keep` stay for the next task of this kind; one of another kind empties them.
    """
    @wraps(work)
    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*args)
        finally:
            for cache in CACHES:
                if not any(cache is x for x in keep):
                    cache.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return run


def rounds(texts: pa.Array, limit: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Slices [first, last) of `texts`, each of about `limit` bytes or one longer text."""
    length = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
    length = length[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(length, length[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a text: start, end and number of the text."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _power(name: str, base: int, length: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < length:
        steps = np.full(max(length, 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if length <= 2 * ROUND_BYTES:
            _powers[name] = have
    return have[:length]


def mixed(value: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits, one to one."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `data`: a polynomial of random byte values, then mixed."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    value = (sums[end] - sums[start]) * _power("down", inverse, max(len(data), 1))[np.minimum(start, max(len(data) - 1, 0))]
    return mixed(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hash(word: str) -> int:
    """The hash that `hashes` gives this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    length = end - start
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))
