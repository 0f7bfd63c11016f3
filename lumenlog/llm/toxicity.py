"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed words and byte grams. The model of a category
also reads the probabilities of the categories before it. In training these are out-of-fold predictions, so a later model
sees earlier probabilities as good as it will get them. The chain is fitted on the driver from a bounded sample of
labelled documents (`per_class` toxic and as many others, in hash order); scoring is one narrow scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import logistic, presence, sigmoid
from ._runtime import slices
from .quality import sample_ids

BITS = 20
FEATURES = 1500
#: Bound of the training sample: labelled documents of either class.
PER_CLASS = 4000
FOLDS = 5
CATEGORIES = ("toxic", "severe", "toxic_spam")


def _select(parts: list[np.ndarray], y: np.ndarray, count: int) -> np.ndarray:
    """The features that tell the class best: z score times log odds, among those seen in four positives or more."""
    size = 1 << BITS
    seen = np.zeros((2, size), dtype=np.int32)
    for own, label in zip(parts, y.tolist(), strict=True):
        seen[label, own] += 1  # a document has each feature once
    b, a = seen
    p, n = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    u, v = (a + 0.5) / (p + 1), (b + 0.5) / (n + 1)
    gain = (u - v) / np.sqrt(u * (1 - u) / p + v * (1 - v) / n) * np.log(u / v)
    gain[a < 4] = 0
    order = np.lexsort((np.arange(size), -gain))[:count]
    return order[gain[order] > 0]


def _chain(x: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights of each category's model: features, then the probabilities of the categories before."""
    models, earlier = [], np.empty((len(x), 0), dtype=np.float32)
    for k in range(targets.shape[1]):
        inputs = np.hstack([x, earlier])
        models.append(logistic(inputs, targets[:, k]))
        out_of_fold = np.zeros(len(x), dtype=np.float32)
        for fold in np.unique(folds):
            held = folds == fold
            rest = logistic(inputs[~held], targets[~held, k]) if (~held).any() else np.zeros(inputs.shape[1] + 1)
            out_of_fold[held] = sigmoid(inputs[held] @ rest[:-1] + rest[-1])
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return models


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> dict | None:
    """A chain over CATEGORIES from labels (id, toxic, quality); rows without a toxic label are left out.

    severe: toxic, with at least as many of the strongest features as the median toxic document. toxic_spam: toxic and of low
    quality. None if either class has no documents.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"), F.coalesce(F.col("quality").cast("int"), F.lit(1)).alias("quality"))
    known = known.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(counts) < {0, 1}:
        return None
    chosen = F.broadcast(sample_ids(known, "id", "toxic", [0, 1], per_class))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, feature = presence(batch.column("text"), BITS)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), batch.column("quality"), pa.array(packed, pa.binary())], names=["id", "toxic", "quality", "x"])

    held = sorted(docs.mapInArrow(features, "id long, toxic int, quality int, x binary").collect())
    y = np.array([r.toxic for r in held], dtype=np.int64)
    if not held or y.min() == y.max():
        return None
    parts = [np.frombuffer(r.x, dtype=np.int32) for r in held]
    best = _select(parts, y, FEATURES)
    slots = np.full(1 << BITS, -1, dtype=np.int32)
    slots[best] = np.arange(len(best))
    x = np.zeros((len(held), len(best)), dtype=np.float32)
    for row, own in zip(x, parts, strict=True):
        found = slots[own]
        row[found[found >= 0]] = 1
    ids, low = [r.id for r in held], np.array([r.quality for r in held]) == 0
    del parts, held
    strong = x[:, :100].sum(axis=1)
    severe = (y == 1) & (strong >= max(1.0, np.median(strong[y == 1])))
    spam = (y == 1) & low
    targets = np.stack([y, severe, spam], axis=1).astype(float)
    folds = np.array([(i * 2654435761 >> 7) % FOLDS for i in ids])
    models = _chain(x, targets, folds)
    # The sample has more toxic documents than the labels: the first model's constant gets the labels' odds back.
    models[0][-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return {"slots": slots, "models": models, "features": len(best)}


def predict(model: dict, texts: pa.Array) -> np.ndarray:
    """Probabilities of the categories, row by row."""
    rows, slots = presence(texts, BITS, slots=model["slots"])
    out = np.empty((len(texts), 0))
    for w in model["models"]:
        n = model["features"]
        score = np.bincount(rows, weights=w[slots], minlength=len(texts)) + w[-1]
        score = score + out @ w[n : n + out.shape[1]]
        out = np.hstack([out, sigmoid(score)[:, None]])
    return out


def classify(documents: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, a probability p_<category> for each category, and is_toxic (p_toxic reaches threshold); one row for each input row.

    Null text counts as empty. Without a model (a class without labelled documents) probabilities are null and nothing is toxic.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"p_{c}" for c in CATEGORIES), "is_toxic"]
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return docs.select(F.col("id").alias(id_col), *(F.lit(None).cast("double").alias(n) for n in names[1:-1]), F.lit(False).alias("is_toxic"))
    held = documents.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = predict(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, 0] >= threshold)], names=names)

    return docs.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} double" for n in names[1:-1]) + ", is_toxic boolean")
