"""Word-shingle sets of whole texts as 64-bit hashes, computed over the Arrow buffers of a batch."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text stands alone.
CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers outlive their tasks, and the next stage shares the executor."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 to the 64th."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, "u8"), np.full(n - 1, b, "u8"))), dtype="u8") for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts data[offsets[i]:offsets[i + 1]], A-Z lower-cased, and the text each is in."""
    n = len(data)
    if not n:
        return np.empty(0, "u8"), np.empty(0, "i8")
    low = _LOWER[data]
    inside = ~_WHITE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    power, inverse = _power(n + 1)
    total = np.concatenate((np.zeros(1, "u8"), np.cumsum((low.astype("u8") + np.uint64(1)) * power[:n], dtype="u8")))
    value = (total[end] - total[start]) * inverse[start]
    return mix(value + (end - start).astype("u8") * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(offsets, start, "right") - 1


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's set of k-word shingles, sorted; a text of fewer words has its whole sequence as one, one without words none."""
    texts = pc.fill_null(texts, "")
    bounds = np.frombuffer(texts.buffers()[1], "i4" if texts.type == pa.string() else "i8")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, "u1") if raw is not None else np.empty(0, "u1")
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
        own = bounds[at : to + 1]
        hashes, text = words(data[own[0] : own[-1]], own - own[0])
        first = np.searchsorted(text, np.arange(to - at + 1))
        if len(hashes) >= k:
            value = np.full(len(hashes) - k + 1, k, "u8")
            for i in range(k):
                value = mix(value * np.uint64(_BASE) + hashes[i : len(hashes) - k + 1 + i])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(value[a : b - k + 1])
            elif b > a:
                one = np.full(1, b - a, "u8")
                for h in hashes[a:b]:
                    one = mix(one * np.uint64(_BASE) + h)
                yield one
            else:
                yield np.empty(0, "u8")
        at = to
