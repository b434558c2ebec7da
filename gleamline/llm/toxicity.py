"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours, and pairs with one or two words between them, each hashed to 32
bits and present or not.  The learner takes a bounded sample of labelled rows (``TRAIN_ROWS``) one after
the other, with a rate for each coordinate; L1 leaves most weights at exactly zero, and what remains is a
sorted array of about a thousand numbers that is broadcast.  Scoring reads every whole text.

Defined cases: a null or empty text has no features; its score is that of the bias.  Identifiers,
languages, sources and labels are no inputs of a score.  Labels that are null are no labels; of several
labels of one identifier the largest counts.  Null identifiers have no label and are never held out.
Rows that repeat are scored each.  Without any label every score is next to 0, so that nothing is called toxic.  An empty
table gives no rows.  Other columns are passed on by ``drop_toxic`` and otherwise ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.llm.common import bounded, column, fresh
from gleamline.session import stage

#: The most labelled rows, about, that are learned from; more are thinned by a hash of their identifier.
TRAIN_ROWS = 16_000
EPOCHS = 4
#: Features of fewer texts of the sample get no weight.
LEAST_TEXTS = 4
#: FTRL-proximal: rate, its smoothing, the two penalties, and the weight of toxic rows.
ALPHA, BETA, L1, L2, TOXIC = 1.0, 1.0, 6.0, 0.1, 2.0

_SEPARATE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def features(text: str | None) -> np.ndarray:
    """The hashes of a text's n-grams and skip-grams, as often as they stand in it."""
    words = (text or "").lower().encode().translate(_SEPARATE).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    parts = [h]
    for gap, odd in enumerate(_ODD, 1):
        if len(h) > gap:
            mixed = (h[:-gap] * odd) ^ (h[gap:] + np.uint32(gap))
            mixed ^= mixed >> np.uint32(15)
            parts.append(mixed * np.uint32(0x2C1B3C6D))
    return np.concatenate(parts)


@dataclass
class Weights:
    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        # Most features have no weight; a bitmap by their low bits tells so at once.
        self.some = np.zeros(1 << 18, bool)
        self.some[self.feature & np.uint32((1 << 18) - 1)] = True

    def score(self, text: str | None) -> float:
        f = features(text)
        f = f[self.some[f & np.uint32((1 << 18) - 1)]]
        total = self.bias
        if len(f) and len(self.feature):
            f = np.unique(f)
            at = np.minimum(np.searchsorted(self.feature, f), len(self.feature) - 1)
            total += float(self.weight[at][self.feature[at] == f].sum())
        return float(1 / (1 + np.exp(-min(max(total, -35.0), 35.0))))


def learn(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """Distinct features and a label per text, in the order they are learned from."""
    if not texts:
        return Weights(np.zeros(0, np.uint32), np.zeros(0), -35.0)
    # Most features are rare: counts by their low bits tell so with little memory, exact ones follow.
    low = np.uint32((1 << 24) - 1)
    buckets = np.zeros(1 << 24, np.uint16)
    for t in texts:
        buckets[t & low] += 1
    texts = [t[buckets[t & low] >= LEAST_TEXTS] for t in texts]
    del buckets
    seen, times = np.unique(np.concatenate(texts), return_counts=True)
    seen = seen[times >= LEAST_TEXTS]
    rows = []
    for t in texts:
        at = np.searchsorted(seen, t)
        inside = at < len(seen)
        at, own = at[inside], t[inside]
        rows.append(at[seen[at] == own])
    z, n = np.zeros(len(seen)), np.zeros(len(seen))
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for at, y in zip(rows, labels):
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0.0)
            b = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y) * (TOXIC if y else 1.0)
            after = ni + g * g
            z[at] = zi + g - (np.sqrt(after) - root) / ALPHA * w
            n[at] = after
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * b
            bias_n += g * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return Weights(seen[w != 0], w[w != 0], -bias_z / ((BETA + bias_n**0.5) / ALPHA))


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: a fifth, by CRC-32 of the identifier as text."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Weights:
    """Weights from the labelled rows of ``docs`` that aren't held out."""
    known = (
        labels.select(column("doc_id").alias("id"), column("toxic").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg((F.max("y") > 0).cast("int").alias("y"))
    )
    known = stage(known.withColumn("h", F.xxhash64("id")))
    count = known.count()
    share = min(1.0, rows / max(count, 1))
    # A hash below this share of its range: about ``rows`` rows, the bound of what is broadcast.
    sample = known.filter(F.col("h").cast("double") / float(1 << 63) < 2 * share - 1) if share < 1 else known
    texts = docs.select(column("doc_id").alias("id"), column("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(sample), "id").select("h", "y", "text")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 2, 4 << 20):
            rows = [np.unique(features(t)).view(np.int32) for t in part.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
            check = pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), check, lists], names=["h", "y", "c", "f"])

    def learned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, given = [], []
        for batch in batches:
            given += batch.column(1).to_pylist()
            lists = batch.column(3)
            flat, at = np.asarray(lists.flatten()).view(np.uint32), np.asarray(lists.offsets)
            texts += [flat[a:b].copy() for a, b in zip(at - at[0], at[1:] - at[0])]
        w = learn(texts, np.array(given, float))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*w.feature.tolist(), -1], pa.int64()), pa.array([*w.weight.tolist(), w.bias], pa.float64())],
            names=["feature", "weight"],
        )

    # One learner takes the sample in the order of a hash, so that a repeated task learns the same.
    prepared = labelled.mapInArrow(hashed, "h long, y int, c long, f array<int>")
    ordered = prepared.repartition(1).sortWithinPartitions("h", "c")
    found = ordered.mapInArrow(learned, "feature long, weight double").toPandas().sort_values("feature")
    if not len(found):
        return Weights(np.zeros(0, np.uint32), np.zeros(0), -35.0)
    bias, found = float(found["weight"].iloc[0]), found.iloc[1:]
    return Weights(found["feature"].to_numpy().astype(np.uint32), found["weight"].to_numpy(), bias)


def scores(docs: DataFrame, weights: Weights) -> DataFrame:
    """``docs`` with a column ``score``, named anew if there is one."""
    (name,) = fresh(docs, "score")
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    given = docs.withColumn("text", column("text").cast("string"))
    at = given.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for part in bounded(batches, at, 4 << 20):
            found = pa.array([score(t) for t in part.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return given.mapInArrow(run, T.StructType([*given.schema, T.StructField(name, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = scores(docs.select(column("doc_id"), column("text")), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with the columns of ``docs``."""
    (name,) = fresh(docs, "score")
    return scores(docs, train(docs, labels)).filter(column(name) < 0.5).select(*map(column, docs.columns))
