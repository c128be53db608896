"""Nearest neighbours with a vantage-point tree for each shard.

Every shard of the vectors has a tree.  An inner node has a vantage point
and, for either half of the rest, the least and the greatest distance to it.
By the triangle inequality no member of a half is nearer to a query than the
gap between the query's distance to the vantage point and that range.  A
half is passed over if gap * factor exceeds the k-th distance found so far.
Factor 1 is exact search; a greater factor passes over more.

All queries of a block walk a tree together: each first looks at the leaf it
falls in, then every other leaf is visited with the queries that can't rule
it out.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of other lengths than the query's are not
compared; equal distances go to smaller ids; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.blocks import best, vectors
from formweave.llm.impact_topk import matrices

K = 10
LEAF = 64
FACTOR = 1.6
#: Rounding of distances, relative: exact search passes over nothing within it.
SLACK = 1e-12


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


class Tree:
    """Leaves (row arrays) with their paths: (inner node, least, greatest distance to its vantage point)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.points, self.leaves, self.paths = x, [], [], []
        rng = np.random.default_rng(3)
        open_nodes = [(np.arange(len(x)), [])]
        while open_nodes:
            rows, path = open_nodes.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                self.paths.append(path)
                continue
            # of a few rows the one with the widest spread of distances
            tries = rng.choice(rows, 4, replace=False)
            spread = distances(x[tries], x[rng.choice(rows, min(64, len(rows)), replace=False)]).std(axis=1)
            point = tries[int(spread.argmax())]
            d = distances(x[point][None], x[rows])[0]
            order = np.argsort(d, kind="stable")
            node, half = len(self.points), len(rows) // 2
            self.points.append(point)
            for part in (order[:half], order[half:]):
                open_nodes.append((rows[part], [*path, (node, d[part[0]], d[part[-1]])]))

    def gaps(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf the least distance that the triangle inequality leaves."""
        to = distances(queries, self.x[self.points]) if self.points else np.zeros((len(queries), 0))
        out = np.zeros((len(queries), len(self.leaves)))
        for i, path in enumerate(self.paths):
            for node, low, high in path:
                np.maximum(out[:, i], np.maximum(low - to[:, node], to[:, node] - high), out=out[:, i])
        return out


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
    """(ids, distances) of the k nearest found for each query; missing ones have distance inf."""
    best_d = np.full((len(queries), k), np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def visit(leaf: int, who: np.ndarray):
        rows = tree.leaves[leaf]
        d = distances(queries[who], tree.x[rows])
        d[own[who][:, None] == ids[rows][None]] = np.inf
        close = d.min(axis=1, initial=np.inf) <= best_d[who, -1]
        who, d = who[close], d[close]
        all_d = np.concatenate([best_d[who], d], axis=1)
        all_id = np.concatenate([best_id[who], np.broadcast_to(ids[rows], d.shape)], axis=1)
        order = np.lexsort((all_id, all_d), axis=-1)[:, :k]
        best_d[who] = np.take_along_axis(all_d, order, 1)
        best_id[who] = np.take_along_axis(all_id, order, 1)

    gaps = tree.gaps(queries)
    home = gaps.argmin(axis=1)
    for leaf in range(len(tree.leaves)):
        who = np.flatnonzero(home == leaf)
        if len(who):
            visit(leaf, who)
    for leaf in np.argsort(gaps.mean(axis=0), kind="stable"):
        may = gaps[:, leaf] * factor <= best_d[:, -1] * (1 + SLACK) + SLACK
        who = np.flatnonzero(may & (home != leaf))
        if len(who):
            visit(leaf, who)
    return best_id, best_d


def _kernel(shard: pa.Table, queries: pa.Table, k: int, factor: float, leaf: int) -> pa.Table:
    out = []
    sides = {size: (ids, x) for size, ids, x in matrices(shard)}
    for size, own, qs in matrices(queries):
        if size in sides:
            ids, x = sides[size]
            found, d = search(Tree(x, leaf), ids, qs, own, k, factor)
            there = np.isfinite(d)
            out.append((np.broadcast_to(own[:, None], d.shape)[there], found[there], d[there]))
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    if not out:
        return pa.table({n: pa.array([], t) for n, t in kinds.items()})
    return pa.table({n: pa.array(np.concatenate(c), kinds[n]) for n, c in zip(kinds, zip(*out, strict=True), strict=True)})


def nearest(embeddings: DataFrame, k: int = K, factor: float = FACTOR, leaf: int = LEAF, **blocks) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest vectors found, with their distances."""
    kernel = partial(_kernel, k=k, factor=factor, leaf=leaf)
    order = [F.col("score"), F.col("vec_id")]
    return best(vectors(embeddings, zero=False), lambda shard, queries: kernel(shard, queries), order, k, "double", **blocks)
