"""Signatures under which similar sets meet: numpy over batches of texts, run inside tasks.

Sets A and B with Jaccard >= t differ in at most (1 - t) / (1 + t) of both
sizes together.  Deal the elements by a hash into one part more than that: in
some part the two sets are equal (Arasu et al. 2006).  A row is such a part of
a set, as a hash of its elements, with the set's size and the parity of its
elements in 128 bits; where parities differ in more bits than the sets may in
elements, the sets cannot be similar.

Elements are distinct windows of three characters of ' text ', or words; they
are those of `functions.text.trigrams_of` and `tokens_of`.  Windows are told
apart exactly, words by 64-bit hashes.

Where one set of texts meets itself (`pack_rows` and what follows), a part is
nine bytes: 32 bits of its hash in one of 1,024 buckets and 40 bits of the
text's number.  Numbers of parts are few, so that most sets are dealt out once:
for their own class, and for the one below if that has another number.  Sizes
and parities are made only for texts that share a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIGNATURES = "id bigint, m int, n int, e bigint, x bigint, y bigint"
#: Characters of texts that are worked on at once.
CHUNK_CHARS = 1 << 20


def size_class(n: int, t: float) -> int:
    """Sets with Jaccard >= t have the same or neighbouring classes."""
    return math.floor(math.log(n) / -math.log(t) + 1e-9) if t < 1 else n


def parts_of(size: int, t: float) -> int:
    """One more than a set of class `size` and a similar one can differ in elements."""
    most = math.floor(t ** -(size + 1) + 1e-6) if t < 1 else size
    return math.floor(most * (1 - t) / t + 1e-6) + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64, copy=False) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def trigram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct window of each text, by row."""
    chars = np.frombuffer(" ".join(f" {s} " for s in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(s) + 2 for s in texts], np.int64)
    # one character between texts
    row = np.repeat(np.arange(len(texts)), sizes + 1)[: len(chars)]
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    seen[ord("?")] = True
    letters = np.flatnonzero(seen)
    bits = max(1, int(len(letters) - 1).bit_length())
    if 3 * bits + len(texts).bit_length() > 63:
        half = len(texts) // 2
        a, b = trigram_sets(texts[:half]), trigram_sets(texts[half:])
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]])
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    c = number[chars]
    end = (np.cumsum(sizes + 1) - 1)[row]
    at = np.flatnonzero(np.arange(len(chars)) + 2 < end)
    key = lambda where, first: (((row[where] << bits) + first << bits) + c[where + 1] << bits) + c[where + 2]
    # Java's regular expressions also begin inside a pair of surrogates, whose second half alone is written as ?
    wide = at[chars[at] > 0xFFFF]
    inside = wide[wide + 3 <= end[wide]]
    # sorted by hand, for np.unique takes five times as long
    found = np.sort(np.concatenate([key(at, c[at]), key(inside, number[ord("?")])]))
    found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
    mask = (1 << bits) - 1
    a, b, z = (letters[(found >> shift) & mask].astype(np.uint64) for shift in (2 * bits, bits, 0))
    return found >> (3 * bits), _mix((a << np.uint64(42)) | (b << np.uint64(21)) | z)


def word_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct word of each text, by row."""
    from pandas.util import hash_array

    words = [w for s in texts for w in dict.fromkeys(s.split(" ")) if w]
    sizes = np.array([len({w for w in s.split(" ") if w}) for s in texts], np.int64)
    hashes = hash_array(np.array(words, object), categorize=True) if words else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(texts)), sizes), _mix(hashes)


MEASURES = [trigram_sets, word_sets]


def _sums(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by place, modulo 2^64; both halves stay exact in a double."""
    low = np.bincount(where, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(where, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def _rows(names: np.ndarray, groups: np.ndarray, texts: list[str], m: int, t: float, near: int) -> Iterator[pa.RecordBatch]:
    row, h = MEASURES[m](texts)
    n = np.bincount(row, minlength=len(texts))
    cell = row * 128 + (h & np.uint64(127)).astype(np.int64)
    parity = (np.bincount(cell, minlength=len(texts) * 128) & 1).astype(np.uint8)
    sketch = np.packbits(parity.reshape(-1, 128), axis=1).view(np.int64)
    sizes = np.array([size_class(int(k), t) if k else 0 for k in n], np.int64)
    place, content = _mix(h) >> np.uint64(32), _mix(h ^ np.uint64(0xA0761D6478BD642F))
    for step in range(-near, near + 1):
        known = {k: parts_of(k, t) for k in np.unique(sizes + step).tolist() if k >= 0}
        parts = np.array([known.get(int(k), 0) if some else 0 for k, some in zip(sizes + step, n, strict=True)], np.int64)
        first = np.cumsum(parts) - parts
        total = int(parts.sum())
        if not total:
            continue
        has = parts[row] > 0
        r = row[has]
        part = ((place[has] * parts[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = _sums(first[r] + part, content[has], total)
        owner = np.repeat(np.arange(len(texts)), parts)
        number = (np.arange(total) - first[owner]).astype(np.uint64)
        kind = (((sizes + step)[owner].astype(np.uint64) << np.uint64(32)) | number) * np.uint64(2) + np.uint64(m)
        e = _mix(_mix(sums ^ _mix(kind)) ^ groups[owner]).view(np.int64)
        for at in range(0, total, 1 << 16):
            o = owner[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[o]), pa.array(np.full(len(o), m, np.int32)), pa.array(n[o].astype(np.int32)), pa.array(e[at : at + (1 << 16)]),
                 pa.array(sketch[o, 0]), pa.array(sketch[o, 1])],
                names=["id", "m", "n", "e", "x", "y"],
            )


def signature_rows(batches: Iterator[pa.RecordBatch], measures: int, t: float, near: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, g, text), g a number of the group, as rows of SIGNATURES; `near` 1 on the side that meets all similar sizes, 0 on the other."""
    for batch in batches:
        texts, names, groups = batch["text"].to_pylist(), batch["id"].to_numpy(), batch["g"].to_numpy().view(np.uint64)
        ends = np.cumsum([len(s) + 3 for s in texts])
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + CHUNK_CHARS, "right")))
            for m in range(measures):
                yield from _rows(names[first:last], groups[first:last], texts[first:last], m, t, near)
            first = last


#: Hash buckets in which the parts of one side are sent, a power of two.
PACKS = 1 << 10
#: Bits of a text's number in a pack.
ID_BITS = 40


def _schemes(t: float) -> Iterator[int]:
    """Numbers of parts that sets are dealt into: every few, then a quarter more each time."""
    n = 1
    while True:
        yield n
        n = max(n + 1, math.ceil(n * 1.25))


def scheme(size: int, t: float) -> int:
    """The number of parts for sets of class `size` and similar ones of this or the next class; 0 for no class."""
    return next(n for n in _schemes(t) if n >= parts_of(size, t)) if size >= 0 else 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(a, g, texts) of CHUNK_CHARS, or of one text."""
    for batch in batches:
        texts, names, groups = batch["text"].to_pylist(), batch["a"].to_numpy(), batch["g"].to_numpy().view(np.uint64)
        ends = np.cumsum([len(s) + 3 for s in texts])
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + CHUNK_CHARS, "right")))
            yield names[first:last], groups[first:last], texts[first:last]
            first = last


def _parts_hashes(groups: np.ndarray, texts: list[str], t: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the parts of each text's trigrams, dealt out for its own class and for the one below."""
    row, h = trigram_sets(texts)
    n = np.bincount(row, minlength=len(texts))
    sizes = np.array([size_class(int(k), t) if k else -1 for k in n], np.int64)
    known = {int(k): scheme(int(k), t) for k in np.unique(np.concatenate([sizes, sizes - 1]))}
    own, below = (np.array([known[int(k)] for k in which], np.int64) for which in (sizes, sizes - 1))
    below[(below == own) | (sizes < 0)] = 0
    place, content = _mix(h) >> np.uint64(32), _mix(h ^ np.uint64(0xA0761D6478BD642F))
    owners, hashes = [], []
    for parts in (own, below):
        first, total = np.cumsum(parts) - parts, int(parts.sum())
        has = parts[row] > 0
        r = row[has]
        part = ((place[has] * parts[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = _sums(first[r] + part, content[has], total)
        owner = np.repeat(np.arange(len(texts)), parts)
        kind = (parts[owner].astype(np.uint64) << np.uint64(32)) | (np.arange(total) - first[owner]).astype(np.uint64)
        owners.append(owner)
        hashes.append(_mix(_mix(sums ^ _mix(kind)) ^ groups[owner]))
    return np.concatenate(owners), np.concatenate(hashes)


def pack_rows(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """(p, b): the parts of (a, g, text) by bucket, 32 bits of a part's hash and a text's number in nine bytes."""
    for names, groups, texts in _chunks(batches):
        owner, h = _parts_hashes(groups, texts, t)
        bucket = (h >> np.uint64(32)) & np.uint64(PACKS - 1)
        order = np.argsort(bucket, kind="stable")
        raw = np.empty((len(order), 9), np.uint8)
        raw[:, :4] = (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)
        raw[:, 4:] = names[owner[order]].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]
        used, cuts = np.unique(bucket[order], return_index=True)
        ends = np.append(cuts, len(order)) * 9
        packs = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), packs], names=["p", "b"])


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, a, r): the parts, of all packs of a task, that r > 1 texts have."""
    keys, names = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for p, b in zip(batch["p"].to_pylist(), batch["b"].to_pylist(), strict=True):
            raw = np.frombuffer(b, np.uint8).reshape(-1, 9)
            keys.append(np.ascontiguousarray(raw[:, :4]).view("<u4")[:, 0].astype(np.uint64) | np.uint64(p << 32))
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw[:, 4:]
            names.append(wide.view("<i8")[:, 0])
    key, name = np.concatenate(keys), np.concatenate(names)
    del keys, names
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    key, name = key[twin], name[order][twin]
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name = key[new], name[new]
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    runs = n[which]
    key, name, runs = key[runs > 1], name[runs > 1], runs[runs > 1]
    for at in range(0, len(key), 1 << 16):
        cut = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[cut].view(np.int64)) for x in (key, name, runs.astype(np.int64))], names=["k", "a", "r"])


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, n, x, y): the size of each text's set of trigrams and the parity of its elements."""
    for names, _, texts in _chunks(batches):
        row, h = trigram_sets(texts)
        cell = row * 128 + (h & np.uint64(127)).astype(np.int64)
        parity = (np.bincount(cell, minlength=len(texts) * 128) & 1).astype(np.uint8)
        sketch = np.packbits(parity.reshape(-1, 128), axis=1).view(np.int64)
        n = np.bincount(row, minlength=len(texts)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], names=["a", "n", "x", "y"])


def pair_rows(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of texts under one (k, i, j), of the blocks i and j, whose sizes and parities allow a similarity of t.

    Rows are k, i, j, u, a, n, x, y with u the text's own block; all of one (k, i, j) are in one task.
    """
    columns = ["k", "i", "j", "u", "a", "n", "x", "y"]
    parts = [np.stack([batch[c].to_numpy().astype(np.int64) for c in columns]) for batch in batches if len(batch)]
    if not parts:
        return
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort(rows[2::-1])]
    i, j, u, a, n = rows[1:6]
    x, y = (rows[c].view(np.uint64) for c in (6, 7))
    new = np.ones(len(a), bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(a)))

    def near(l: np.ndarray, r: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(x[l] ^ x[r]).astype(np.int64) + np.bitwise_count(y[l] ^ y[r])
        may = np.floor((n[l] + n[r]) * ((1 - t) / (1 + t)) + 1e-6)
        met = (i[l] == j[l]) | (u[l] != u[r])
        ok = met & (n[l] >= n[r] * t - 1e-9) & (n[r] >= n[l] * t - 1e-9) & (differ <= may)
        l, r = a[l[ok]], a[r[ok]]
        return np.stack([np.minimum(l, r), np.maximum(l, r)])

    found, fresh = [np.zeros((2, 0), np.int64)], 0
    # each row of a run with the one `step` after it, for all runs at once
    for step in range(1, int(sizes.max())):
        runs = sizes > step
        sizes, starts = sizes[runs], starts[runs]
        for at in range(0, len(starts), 1 << 16):
            count = sizes[at : at + (1 << 16)] - step
            l = np.repeat(starts[at : at + (1 << 16)] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            found.append(near(l, l + step))
            fresh += found[-1].shape[1]
        if fresh > 1 << 20:
            found, fresh = [_distinct(np.concatenate(found, axis=1))], 0
    pairs = _distinct(np.concatenate(found, axis=1))
    for at in range(0, pairs.shape[1], 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0, at : at + (1 << 16)]), pa.array(pairs[1, at : at + (1 << 16)])], names=["a", "b"])


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[:, np.lexsort(pairs)]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, new]
