"""Exact top-k by integer inner product with an impact-ordered, score-at-a-time index.

In a shard every dimension has a posting list that is cut into segments of
equal quantised value.  For a query the impact of a segment is the most that
its value can add to a score.  Segments are processed by descending impact
and add it to their members.  After some of them, the score of any vector is
at most its sum so far plus what the best open segment of each dimension can
still add.  The best sums are scored exactly, and all vectors whose bound
lies below the k-th exact score are proven out.  Processing stops when few
are left, or all segments are done; those left are scored exactly.

Nothing is dropped without that proof, ties included: a vector whose bound
equals the k-th score stays.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; vectors of other lengths than the query's are not
compared; an empty table gives an empty result.  Scores are 64-bit: components
must stay below 2^28 after quantising (|x| below 2^18), larger ones are an error.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.blocks import best, vectors

K = 10
SCALE = 1024
LEVELS = 16
#: Parts of a query's segments after each of which the proof is tried.
PARTS = 8
LIMIT = 1 << 28


def matrices(table: pa.Table):
    """(length, ids, matrix) of the vectors of each length."""
    ids = table["vec_id"].to_numpy()
    v = table["v"].combine_chunks()
    sizes = np.asarray(v.value_lengths())
    values, starts = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), ids[rows], values[starts[rows][:, None] + np.arange(size)]


class Segments:
    def __init__(self, x: np.ndarray, levels: int):
        n, dims = x.shape
        quantum = max(1, -(-(int(np.abs(x).max(initial=0)) + 1) // levels))
        self.rows, self.dims, self.low, self.high = [], [], [], []
        for d in range(dims):
            order = np.argsort(x[:, d], kind="stable")
            level = x[order, d] // quantum
            cuts = np.flatnonzero(np.diff(level)) + 1
            starts = np.concatenate([[0], cuts])
            self.rows += np.split(order, cuts)
            self.dims += [d] * len(starts)
            self.low += list(x[order[starts], d])
            self.high += list(x[order[np.append(cuts, n) - 1], d])
        self.dims, self.low, self.high = np.array(self.dims), np.array(self.low), np.array(self.high)

    def impacts(self, q: np.ndarray) -> np.ndarray:
        w = q[self.dims]
        return np.where(w >= 0, w * self.high, w * self.low)


def search(x: np.ndarray, ids: np.ndarray, index: Segments, q: np.ndarray, own: int, k: int, parts: int = PARTS):
    """Rows of the k best vectors for q, best first, ties to smaller ids, and their scores."""
    n, dims = x.shape
    others = np.flatnonzero(ids != own)
    few = max(8 * k, n // 32)
    impact = index.impacts(q)
    order = np.argsort(-impact, kind="stable")
    # what the best open segment of each dimension can add at most: segments of a dimension close in order
    tops = {d: [] for d in range(dims)}
    for s in order[::-1]:
        tops[index.dims[s]].append(int(impact[s]))
    bound = np.zeros(n, np.int64)
    live = others
    for part in np.array_split(order, parts):
        for s in part:
            bound[index.rows[s]] += impact[s]
            tops[index.dims[s]].pop()
        if len(live) <= few:
            break
        # a vector either was in a closed segment of the dimension or is in an open one
        rest = sum(max(0, t[-1]) for t in tops.values() if t)
        most = bound[live] + rest
        if len(live) > k:
            head = live[np.argpartition(-most, k - 1)[: 2 * k]]
            scores = np.sort(x[head] @ q)[::-1]
            if len(scores) >= k:
                live = live[most >= scores[k - 1]]
    exact = x[live] @ q
    pick = np.lexsort((ids[live], -exact))[:k]
    return live[pick], exact[pick]


def _kernel(shard: pa.Table, queries: pa.Table, k: int, scale: int, levels: int) -> pa.Table:
    out: list[tuple[np.ndarray, ...]] = []
    sides = {size: (ids, m) for size, ids, m in matrices(shard)}
    for size, query_ids, qs in matrices(queries):
        if size not in sides:
            continue
        ids, m = sides[size]
        x, qs = np.floor(scale * m), np.floor(scale * qs)
        if max(np.abs(x).max(initial=0), np.abs(qs).max(initial=0)) >= LIMIT:
            raise ValueError("a component is too large for 64-bit scores")
        x, qs = x.astype(np.int64), qs.astype(np.int64)
        index = Segments(x, levels)
        for own, q in zip(query_ids, qs, strict=True):
            rows, scores = search(x, ids, index, q, own, k)
            out.append((np.full(len(rows), own), ids[rows], scores))
    names = ["query_id", "vec_id", "score"]
    if not out:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})


def top_k(embeddings: DataFrame, k: int = K, scale: int = SCALE, levels: int = LEVELS, **blocks) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest inner products of floor(scale * x)."""
    kernel = partial(_kernel, k=k, scale=scale, levels=levels)
    order = [F.col("score").desc(), F.col("vec_id")]
    return best(vectors(embeddings, zero=True), lambda shard, queries: kernel(shard, queries), order, k, "bigint", **blocks)
