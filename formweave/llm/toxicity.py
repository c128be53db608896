"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded sample: at most `per_class` labelled rows of either
class, those with the smallest hashes of their ids.  The ids of the sample
are bounded and so may be sent to the scan of the documents, where features
are made next to the texts; one task then sees the sample's features only.
Learning is per coordinate with L1, so most weights are exactly zero and the
model is a short table, sent to the executors as a literal part of the task.

Features are 64-bit hashes of presence: words, pairs of neighbours and pairs
with one word between them.  Weights are kept by the full hash, so a long
text doesn't hit other features' weights by chance.  Classes are sampled
separately; the intercept is put back to the shares in all labelled rows.

Defined cases: a null or empty text has no features, and its score is the
intercept's; a document with several labels counts as toxic if one says so;
null labels or ids are not learnt from; with no labelled rows, or of one
class only, the score is the share of that class (0 without any); repeated
rows are scored alike; other columns are carried unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.bytewords import MARKS, grams, text_chunks, words
from formweave.llm.shared import give_back, lean, written

#: Labelled rows of each class that are learnt from, at most.
PER_CLASS = 10_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
THRESHOLD = 0.3
COARSE_BITS = 26


@dataclass
class Model:
    intercept: float
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of a chunk, with repeats."""
    h, first = words(offsets, data, MARKS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, owners = [h], [text]
    for gap in (1, 2):
        if len(h) > gap:
            same = text[:-gap] == text[gap:]
            found.append(grams(h, gap)[same])
            owners.append(text[:-gap][same])
    return np.concatenate(owners), np.concatenate(found)


def _feature_rows(batches):
    for batch in batches:
        lists = []
        for _, offsets, data in text_chunks(batch["text"]):
            owner, feature = _features(offsets, data)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(1, len(offsets) - 1))
            lists += [np.unique(x).view(np.int64) for x in np.split(feature[order], cuts)]
        yield pa.RecordBatch.from_arrays(
            [batch["toxic"], pa.array(lists, pa.list_(pa.int64()))], names=["toxic", "features"]
        )


def _fit(batches, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    labels, rows = [], []
    for batch in batches:
        labels += batch["toxic"].to_pylist()
        rows += [np.asarray(x.values).view(np.uint64) for x in batch["features"]]
    if not rows:
        return
    # gradients are below 1: with epochs <= l1 what one document has alone stays zero
    least = 2 if epochs <= l1 else 1
    if least > 1:
        # most of it goes by a coarse look first, to keep memory low
        once, twice = np.zeros(1 << COARSE_BITS, bool), np.zeros(1 << COARSE_BITS, bool)
        coarse = lambda r: r >> np.uint64(64 - COARSE_BITS)
        for r in rows:
            at = coarse(r)
            twice[at[once[at]]] = True
            once[at] = True
        at = None
        rows = [r[twice[coarse(r)]] for r in rows]
        del once, twice
    # the batches go, and nothing stands twice from here on
    batch = r = None
    give_back()
    keys = np.concatenate(rows)
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    keys = keys[first[np.diff(first, append=len(keys)) >= least]]
    del first
    order = np.random.default_rng(5).permutation(len(rows))
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)  # the last is the intercept
    places = rows
    for i, r in enumerate(rows):
        at = np.searchsorted(keys, r)
        at = at[(at < len(keys)) & (keys[np.minimum(at, max(0, len(keys) - 1))] == r)] if len(keys) else at[:0]
        places[i] = np.append(at, len(keys)).astype(np.int32)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order:
            at = places[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - labels[i]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = weights(z, n)
    kept = np.flatnonzero(w[:-1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(keys[kept].view(np.int64), 0)), pa.array(np.append(w[kept], w[-1])), pa.array([False] * len(kept) + [True])],
        names=["key", "weight", "intercept"],
    )


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS,
          alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """A model from labels (doc_id, toxic 0/1) of documents (doc_id, text)."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = written(marks, "labels")
    shares = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        share = 1.0 if 1 in shares else 0.0
        return Model(35.0 if share else -35.0)
    parts = [
        marks.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)
    ]
    sample = written(parts[0].unionByName(parts[1]), "sample")
    # proven bound: 2 * per_class rows
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    rows = written(chosen.mapInArrow(lean(_feature_rows), "toxic int, features array<bigint>"), "sample-features")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        p = shares[1] / (shares[0] + shares[1])
        return Model(math.log(p / (1 - p)))
    fit = partial(_fit, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
    found = rows.repartition(1).mapInArrow(lean(fit), "key bigint, weight double, intercept boolean").collect()
    shift = math.log(shares[1] / shares[0]) - math.log(seen[1] / seen[0])
    model = [(r["key"] & 0xFFFFFFFFFFFFFFFF, r["weight"]) for r in found if not r["intercept"]]
    model.sort()
    start = next(r["weight"] for r in found if r["intercept"])
    return Model(start + shift, np.array([k for k, _ in model], np.uint64), np.array([w for _, w in model], float))


def _score_texts(column: pa.Array, model: Model) -> np.ndarray:
    parts = [np.zeros(0)]
    for _, offsets, data in text_chunks(column):
        n = len(offsets) - 1
        logit = np.full(n, model.intercept)
        if len(model.keys):
            owner, feature = _features(offsets, data)
            at = np.minimum(np.searchsorted(model.keys, feature), len(model.keys) - 1)
            hit = model.keys[at] == feature
            pairs = np.unique(owner[hit] * np.int64(len(model.keys)) + at[hit])
            logit += np.bincount(pairs // len(model.keys), model.weights[pairs % len(model.keys)], minlength=n)
        parts.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
    return np.concatenate(parts)


def _scored(batches, model: Model, name: str):
    for batch in batches:
        score = pa.array(_score_texts(batch["text"], model), pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, name])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with their score from 0 to 1 in a column `name`."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(lean(partial(_scored, model=model, name=name)), schema)


def held_out(doc_id: str = "doc_id"):
    """The quarter of the documents whose labels are not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_rest(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return train(docs, labels.filter(~held_out()), **options)
