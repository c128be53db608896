"""Merkle manifest of a dataset: checkpoints every few levels, the rest recomputed for proofs.

Every row is a leaf, every tree (one per group, as a language) folds runs of
FANOUT consecutive nodes until one is left, and the trees' roots fold alike
to the root.  Only the levels 0, STRIDE, 2 * STRIDE ... are stored.  An
aligned subtree between two stored levels has FANOUT ** STRIDE stored
descendants at most, which is what a group of the jobs below ever holds:
building folds them to the next stored node; a proof regenerates the levels
in between from them, takes each descendant's siblings and drops the nodes
again.  Proofs go from the top down, so what all leaves of a subtree share of
their proofs is joined to one row of that subtree, not to its leaves.

How it scales: hashing is a projection; leaves get their position by one
range sort of hashes (no tree is held in a task, however large its group) and
counts per sorted partition; then a shuffle on aligned subtrees per stored
level, each FANOUT ** STRIDE times smaller than the one below.  The driver
learns the height of the highest tree.

Defined cases: null fields are `-`, empty texts `0:`; long texts are hashed
whole; a null group is a group of its own and comes first; rows without an id
come first in their group; rows that repeat an id are leaves each, ordered by
hash (equal rows have equal hashes, so any order gives the same tree); a tree
of one leaf is that leaf; no rows give no proofs; other columns are not read
unless named in `keep`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formweave.llm.shared import new_folder, written

FANOUT, STRIDE = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Tree(NamedTuple):
    """Stored nodes (tree, height, pos, hash, kept) of the levels 0, stride, 2 * stride ...; kept is of level 0 only."""
    levels: list[DataFrame]
    fanout: int
    stride: int

    def roots(self) -> DataFrame:
        """(tree, height, hash): of each tree the node that remains."""
        found = [
            nodes.filter((F.col("height") <= k * self.stride) & (F.col("height") > (k - 1) * self.stride)).select("tree", "height", "hash")
            for k, nodes in enumerate(self.levels)
        ]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out


class Manifest(NamedTuple):
    groups: Tree
    #: The tree over the groups' roots; its leaves keep the group.
    top: Tree


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row of documents; `changed` replaces columns by other values."""
    return sha256(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def _parents(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * fanout + 1, F.lit(fanout)), ""), 256))


def _subtrees(nodes: DataFrame, level: int, fanout: int, stride: int) -> DataFrame:
    """(tree, block, height, depth, below, h0, h1 ...): aligned subtrees with the levels below their roots regenerated.

    below are the stored descendants in order, h<t> the hashes t levels above
    them, as far as the tree goes: depth is the number of levels there are.
    """
    width = fanout**stride
    rows = nodes.groupBy("tree", F.expr(f"pos div {width}").alias("block")).agg(
        F.first("height").alias("height"), F.sort_array(F.collect_list(F.struct("pos", "hash", "kept"))).alias("below")
    )
    rows = rows.select(
        "*", F.least(F.lit(stride), F.col("height") - level).alias("depth"), F.col("below.hash").alias("h0")
    )
    for t in range(1, stride + 1):
        rows = rows.withColumn(f"h{t}", F.when(F.col("depth") >= t, _parents(F.col(f"h{t - 1}"), fanout)).otherwise(F.col(f"h{t - 1}")))
    return rows


def _placed(leaves: DataFrame, order: list[str], fanout: int) -> DataFrame:
    """leaves (tree, hash, kept) with pos, their place in their tree, and the tree's height."""
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    # the id counts on within a sorted partition
    dealt = dealt.select("*", F.shiftright("at", 33).alias("part"))
    runs = dealt.groupBy("part", "tree").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    tree = W.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(
        "part", "tree", "low", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(tree).alias("leaves")
    )
    powers = [fanout**j for j in range(64) if fanout**j < 2**62]
    height = sum(((F.col("leaves") > p).cast("int") for p in powers[1:]), (F.col("leaves") > 1).cast("int"))
    return dealt.join(runs, ["part", "tree"]).select(
        "tree", height.alias("height"), (F.col("at") - F.col("low") + F.col("before")).alias("pos"), "hash", "kept"
    )


def _grown(leaves: DataFrame, order: list[str], fanout: int, stride: int) -> Tree:
    folder = new_folder(leaves.sparkSession, "merkle")
    levels = [written(_placed(leaves, order, fanout), "level-0", folder)]
    highest = levels[0].agg(F.max("height")).first()[0] or 0
    for level in range(0, highest, stride):
        grown = _subtrees(levels[-1].filter(F.col("height") > level), level, fanout, stride).select(
            "tree", "height", F.col("block").alias("pos"), F.col(f"h{stride}")[0].alias("hash"), F.lit(None).cast("string").alias("kept")
        )
        levels.append(written(grown, f"level-{level + stride}", folder))
    return Tree(levels, fanout, stride)


def build(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None, fanout: int = FANOUT, stride: int = STRIDE
) -> Manifest:
    """The stored manifest of docs: a tree per `group`, its leaves by `order`, and the tree over their roots.

    keep names further values of a row that its proof is to be given out with.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(
        tree.alias("tree"), F.col(order).alias("place"), leaf_hash().alias("hash"),
        F.struct(F.col(order), *[c.alias(name) for name, c in (keep or {}).items()]).alias("kept"),
    )
    # hashed once: the range sort reads its input twice; the last key only deals equal rows out
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    groups = _grown(leaves, ["place", "hash", "row"], fanout, stride)
    roots = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("kept"), "hash")
    return Manifest(groups, _grown(roots, ["kept"], fanout, stride))


def _siblings(child: Column, fanout: int, stride: int) -> Column:
    """Of the descendant with that number in its subtree: the run's others before and behind it, level by level."""
    found = []
    for t in range(stride):
        nodes, at = F.col(f"h{t}"), F.floor(child / fanout**t).cast("int")
        first, own = F.floor(at / fanout).cast("int") * fanout, at % fanout
        found.append(F.struct(
            F.array_join(F.slice(nodes, first + 1, own), "").alias("before"),
            F.array_join(F.slice(nodes, first + own + 2, fanout - 1 - own), "").alias("behind"),
        ))
    return F.slice(F.array(*found), F.lit(1), F.col("depth"))


def _paths(tree: Tree, heads: DataFrame) -> DataFrame:
    """Leaves (hash, kept, path, subroot, root) of heads (tree, height, path, subroot, root), from the top down."""
    fanout, stride = tree.fanout, tree.stride
    down = None
    for k in reversed(range(max(1, len(tree.levels) - 1))):
        level = k * stride
        begin = (F.col("height") <= level + stride) & ((F.col("height") > level) | F.lit(k == 0))
        here = heads.filter(begin).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if down is not None:
            here = here.union(down.select("tree", F.col("pos").alias("block"), "path", "subroot", "root"))
        nodes = tree.levels[k] if k == 0 else tree.levels[k].filter(F.col("height") > level)
        met = _subtrees(nodes, level, fanout, stride).join(here, ["tree", "block"])
        children = F.transform("below", lambda x, i: F.struct(x.alias("node"), _siblings(i, fanout, stride).alias("near")))
        down = met.select("tree", "path", "subroot", "root", F.explode(children).alias("child")).select(
            "tree", "child.node.pos", "child.node.hash", "child.node.kept", F.concat("child.near", "path").alias("path"), "subroot", "root"
        )
    return down.select("hash", "kept", "path", "subroot", "root")


def proofs(manifest: Manifest) -> DataFrame:
    """(<order>, <keep ...>, leaf, path, subroot, root): every leaf with its proof.

    path holds for each level, from the leaf up, the siblings before and
    behind its node as joined hex texts.
    """
    nothing = F.expr("CAST(array() AS array<struct<before: string, behind: string>>)")
    crown = manifest.top.roots().select(
        "tree", "height", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")
    )
    subroots = _paths(manifest.top, crown).select(F.col("kept").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    heads = manifest.groups.roots().select("tree", "height").join(subroots, "tree")
    return _paths(manifest.groups, heads).select("kept.*", F.col("hash").alias("leaf"), "path", "subroot", "root")


def proof_text(path: Column) -> Column:
    """All siblings of a proof, from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["behind"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(path, leaf, lambda node, x: sha256(x["before"], node, x["behind"]))
