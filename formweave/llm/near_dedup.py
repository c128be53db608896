"""Near-copies by MinHash with tensored banding, verified on full shingle sets.

Two collections of `halves` short keys are made per text, each of `width`
minhashes.  A table key is the combination of key i of the first collection
with key j of the second, so halves * halves tables cost only
2 * halves * width minhashes.  Two texts of similarity s miss each other with
probability 1 - (1 - (1 - s^width)^halves)^2.  The number of halves follows
from the limit, so that a pair at exactly the limit is missed with
probability MISS at most, one above it far less: 17 halves at 0.85 (9.4e-5),
25 at 0.80 (9.8e-5).  Low limits need very many; give a smaller width there.

The tensor form also thins the tables out: a combination can only meet
another one if both halves do, so a half that no other text has is left out
before combining, and most texts then have no combination at all.

Texts with equal shingle sets are one class before anything is compared.
In every bucket each class is first compared with the bucket's smallest one.
Links that hold make components; a second pass compares what shares a bucket
but not a component.  So a large group of near-copies costs its size, and yet
no pair in a bucket is passed over unless its ends are connected already.
The second pass goes by the keys of the first collection alone, which are
fewer rows and pass over no pair of a table.  It compares sketches first (the
least shingle of each of 512 parts of the hash range), large buckets in
blocks, and goes on only with pairs within 4.5 standard deviations of the
limit (one true link in 300,000 is missed by that), each at its first common key.  A link counts
only if it holds on the full sets of both texts (64-bit shingle hashes).

Defined cases: null or empty texts, or white space only, have an empty set
and are linked with nothing; texts shorter than a shingle are one shingle;
rows that repeat a doc_id are one node; rows without a doc_id are kept,
compared with nothing; an empty table gives an empty result; other columns
are carried unread.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.bytewords import grams, mix, text_chunks, words
from formweave.llm.components import components
from formweave.llm.shared import lean, written

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 80
WIDTH = 5
#: Probability at most that a pair at exactly the limit shares no table key.
MISS = 1e-4
PARTS, NONE, SIGMAS = 512, 255, 4.5
#: Members of a bucket that are compared in one go.
BLOCK = 1024

PROFILE = "doc bigint, text_key bigint, n bigint, s1 bigint, s2 bigint, halves array<bigint>"


def enough_halves(similar: int, width: int = WIDTH) -> int:
    """The least number of halves with which a pair at the limit is missed with probability MISS at most."""
    each = (similar / 100) ** width
    return math.ceil(math.log(1 - math.sqrt(1 - MISS)) / math.log1p(-each)) if each < 1 else 1


def _sets(offsets: np.ndarray, data: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each text of a chunk."""
    h, first = words(offsets, data)
    long = grams(h, *[1] * (size - 1))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(long[a : b - size + 1])
        elif b > a:
            yield mix(grams(h[a:b], *[1] * (b - a - 1)) + np.uint64(b - a))
        else:
            yield h[:0]


def _profiles(batches, size: int, halves: int, width: int):
    salts = np.random.default_rng(11).integers(1, 1 << 63, (2, 2 * halves * width, 1), np.uint64)
    salts[1] |= np.uint64(1)
    for batch in batches:
        n, s1, s2, keys = [], [], [], []
        for _, offsets, data in text_chunks(batch["text"]):
            for found in _sets(offsets, data, size):
                n.append(len(found))
                s1.append(mix(found).sum(dtype=np.uint64))
                s2.append(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if len(found):
                    # in blocks, so that a very long text doesn't need a very large matrix
                    least = np.minimum.reduce([
                        ((found[i : i + 8192] ^ salts[0]) * salts[1]).min(axis=1) for i in range(0, len(found), 8192)
                    ])
                    parts = least.reshape(2 * halves, width)
                    key = np.arange(1, 2 * halves + 1, dtype=np.uint64)
                    for j in range(width):
                        key = mix(key + parts[:, j])
                    keys.append(key.view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
        to = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], batch["text_key"], pa.array(n, pa.int64()), to(s1), to(s2), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc", "text_key", "n", "s1", "s2", "halves"],
        )


def _sketch(shingles: np.ndarray) -> bytes:
    """Seven bits of the least shingle of each of PARTS equal parts of the hash range; NONE where a part has none."""
    out = np.full(PARTS, NONE, np.uint8)
    parts = (shingles >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
    part, first = np.unique(parts, return_index=True)
    out[part] = mix(shingles[first]) & np.uint64(127)
    return out.tobytes()


def _set_rows(batches, size: int):
    for batch in batches:
        found = [s for _, offsets, data in text_chunks(batch["text"]) for s in _sets(offsets, data, size)]
        sets = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch["node"], sets, pa.array(map(_sketch, found), pa.binary())], names=["node", "shingles", "sketch"]
        )


def _close(a: np.ndarray, b: np.ndarray, similar: int) -> np.ndarray:
    """Which sketches of b may be of sets similar to that of the sketch a."""
    filled = ((a != NONE) | (b != NONE)).sum(axis=1)
    equal = ((a == b) & (a != NONE)).sum(axis=1)
    # of about so many different shingles one for each filled part was drawn, without putting back
    union = np.maximum(filled, -PARTS * np.log1p(-np.minimum(filled, PARTS - 0.5) / PARTS))
    t = similar / 100
    # different shingles have the same seven bits by chance
    chance = (1 - t) / 128
    spread = np.sqrt(filled * (t * (1 - t) * (1 - filled / np.maximum(union, 1)) + chance))
    return equal >= filled * t - SIGMAS * spread - 1


def _near_pairs(batches, similar: int):
    """Batches of (bucket, i, j, block, node, label, first, sketch), sorted by bucket, i, j: pairs (a, b) whose sketches are close."""
    def pairs(rows):
        (bucket, i, j), firsts = rows[0][0], [r[4] for r in rows]
        block, node, label = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
        sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), PARTS)
        for x in np.flatnonzero(block == i):
            near = np.flatnonzero((block == j) & (label != label[x]) & ((i != j) | (node > node[x])))
            for y in near[_close(sketch[x], sketch[near], similar)]:
                if min(set(firsts[x]) & set(firsts[y])) == bucket:
                    yield min(node[x], node[y]), max(node[x], node[y])

    def runs():
        rows, key = [], None
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("bucket", "i", "j", "block", "node", "label", "first", "sketch"))
            for *now, block, node, label, first, sketch in zip(*columns, strict=True):
                if now != key and rows:
                    yield rows
                    rows = []
                key = now
                rows.append((now, block, node, label, first, sketch))
        if rows:
            yield rows

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = []
    for rows in runs():
        found += pairs(rows)
        if len(found) > 50_000:
            yield batch_of(found)
            found = []
    yield batch_of(found)


def _shared_halves(profiles: DataFrame, halves: int) -> DataFrame:
    """(node, first, second): per class the half keys that another class has too, by collection."""
    rows = profiles.select("node", F.posexplode("halves").alias("at", "half"))
    # the position is part of the key
    met = rows.groupBy("half").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    left = rows.join(met.select("half"), "half")
    pick = lambda side: F.collect_set(F.when((F.col("at") < halves) == F.lit(side), F.col("half")))
    return left.groupBy("node").agg(pick(True).alias("first"), pick(False).alias("second")).filter(
        (F.size("first") > 0) & (F.size("second") > 0)
    )


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): in every table, each class with the smallest one of its bucket."""
    rows = shared.select("node", F.explode("first").alias("x"), "second").select(
        "node", "x", F.explode("second").alias("y")
    ).select("node", F.xxhash64("x", "y").alias("bucket"))
    met = rows.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("bucket", "a")
    return rows.join(met, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    na, nb = F.size("of_a"), F.size("of_b")
    near = (F.least(na, nb) * 100 >= F.greatest(na, nb) * similar) & (F.least(na, nb) > 0)
    common = F.when(near, F.size(F.array_intersect("of_a", "of_b"))).otherwise(0)
    return both.withColumn("common", common).filter(
        near & (F.col("common") * 100 >= (na + nb - F.col("common")) * similar)
    ).select("a", "b")


def _unconnected(shared: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, i, j, block, node, label, first, sketch) of keys that more than one component has; blocks i and j are to be compared."""
    nodes = shared.join(sets.select("node"), "node").join(labels, "node", "left").select(
        "node", "first", F.coalesce("label", "node").alias("label")
    )
    rows = nodes.select("node", "label", F.explode("first").alias("bucket"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("x < y").select(
        "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    met = rows.join(mixed, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks")).alias("met"))
    dealt = nodes.join(met, "node").join(sets.select("node", "sketch"), "node").select("*", F.explode("met").alias("m")).select(
        "node", "label", "first", "sketch", "m.*"
    ).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", other).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "first", "sketch"
    )


def near_components(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR, halves: int | None = None, width: int = WIDTH) -> DataFrame:
    """(doc, text_key, n, component): one row per distinct (doc_id, text) with its set size and its component.

    Texts are linked if their sets of `shingle` words have at least
    `similar` hundredths in common; without `halves` as many are made as this limit needs.
    """
    halves = halves or enough_halves(similar, width)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )
    profile = partial(_profiles, size=shingle, halves=halves, width=width)
    profiles = written(named.mapInArrow(lean(profile), PROFILE), "profiles")
    filled = profiles.filter("n > 0")
    classes = written(filled.groupBy("s1", "s2").agg(F.min("doc").alias("node"), F.first("halves").alias("halves")), "classes")
    # a document with several texts has several classes; they are one node
    member = filled.join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("doc", "text_key", "node")
    member = written(member, "members")

    shared = written(_shared_halves(classes, halves), "halves")
    stars = written(_stars(shared), "stars")
    needed = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    # alike at every size: a small `needed` would be broadcast, a large one not
    wanted = named.join(needed.hint("merge"), named["doc"] == needed["node"]).select("node", "text")
    sets = written(wanted.mapInArrow(lean(partial(_set_rows, size=shingle)), "node bigint, shingles array<bigint>, sketch binary"), "sets")
    links = written(_confirmed(stars, sets, similar), "star-links")
    # a node whose document has another node is linked with it
    twice = member.join(member.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b"), "doc").select(
        "a", F.col("node").alias("b")
    )
    links = links.union(twice.filter("a <> b"))
    labels = components(links)

    rest = _unconnected(shared, sets, labels)
    order = ["bucket", "i", "j"]
    close = rest.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(partial(_near_pairs, similar=similar)), "a bigint, b bigint")
    more = close.distinct().join(stars, ["a", "b"], "left_anti")
    late = written(_confirmed(written(more, "rest-pairs"), sets, similar), "rest-links")
    if not late.isEmpty():
        # the components found so far stand for their links
        labels = components(late.union(labels.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))))

    named_node = member.join(labels, "node", "left").select("doc", "text_key", F.coalesce("label", "node").alias("component"))
    return profiles.join(named_node.distinct(), ["doc", "text_key"], "left").select(
        "doc", "text_key", "n", F.coalesce("component", "doc").alias("component")
    ).distinct()


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with n_shingles, component_id (smallest doc_id reachable) and kept (whether that is this document)."""
    columns = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    found = near_components(docs, **options).select(
        F.col("doc").alias("__doc"), F.col("text_key").alias("__text"), "n", "component"
    )
    on = (docs["doc_id"].cast("long") == found["__doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["__text"])
    return docs.join(found, on, "left").select(
        *[docs[c] for c in columns],
        F.coalesce(found["n"], F.lit(0)).alias("n_shingles"),
        F.coalesce(found["component"], docs["doc_id"].cast("long")).alias("component_id"),
        F.coalesce(found["component"] == docs["doc_id"], F.lit(True)).alias("kept"),
    )
