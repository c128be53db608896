"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A word's hash is a polynomial over a random table of byte values modulo
2^64, taken from prefix sums, so that a batch costs a few passes over its
bytes whatever its words are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: All ASCII but letters and digits: what separates words of prose.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = _VALUES.copy()
LOWER_VALUES[65:91] = _VALUES[97:123]
_POWERS: dict[str, np.ndarray] = {}

#: Text that is worked on at once; some ten arrays of eight bytes a byte stand beside it.
CHUNK_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, offsets, bytes) of parts of about `limit` bytes; rows stay whole, nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, offsets[first : last + 1] - offsets[first], whole[offsets[first] : offsets[last]]
        first = last


def words(offsets: np.ndarray, data: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, in order, and for each text where its words begin (one more entry: the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[begins] |= inside[begins]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[ends] |= inside[ends]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER_VALUES[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, offsets)


def grams(h: np.ndarray, *gaps: int) -> np.ndarray:
    """Hashes of (word, word after gaps[0], word after gaps[0] + gaps[1], ...), by first word; crossing of texts is the caller's matter."""
    reach = sum(gaps)
    out = h[: max(0, len(h) - reach)] * np.uint64(0xD6E8FEB86659FD93)
    at = 0
    for i, gap in enumerate(gaps):
        at += gap
        out = mix(out + np.uint64((i + 1) * 0xA0761D6478BD642F % (1 << 64))) + h[at : len(h) - reach + at]
    return mix(out + np.uint64(reach))
