"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed text shapes is shared by all grades; ordered thresholds cut the line into grades:
P(grade <= k) = sigmoid(threshold_k - w . x). The model gives each document an expected grade and the probability
of each tail P(grade > k), by which documents are selected. It is fitted on the driver from a bounded sample of rated
documents (`per_grade` of each grade, in hash order); scoring is one narrow scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import adam, shape_features, sigmoid
from ._runtime import slices

DIMS = 1024
#: Bound of the training sample: rated documents of each grade.
PER_GRADE = 3000


def sample_ids(rated: DataFrame, id_col: str, grade_col: str, grades: list[int], per_grade: int) -> DataFrame:
    """At most per_grade rows of each grade, the first by a hash of the id: len(grades) * per_grade rows at most."""
    out = None
    for grade in grades:
        part = rated.where(F.col(grade_col) == grade).orderBy(F.xxhash64(id_col), id_col).limit(per_grade)
        out = part if out is None else out.unionByName(part)
    return out


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int, l2: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by maximum likelihood. Thresholds are a first one and exponentials of steps."""
    n, d = x.shape
    cuts = grades - 1

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))

    def gradient(p: np.ndarray) -> np.ndarray:
        t = np.concatenate([[-np.inf], thresholds(p), [np.inf]])
        score = x @ p[:d]
        upper, lower = sigmoid(t[y + 1] - score), sigmoid(t[y] - score)
        upper[y == cuts], lower[y == 0] = 1.0, 0.0
        mass = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / mass * weight, lower * (1 - lower) / mass * weight
        out = np.empty_like(p)
        out[:d] = x.T @ (du - dl) / n + l2 * p[:d] / n
        by_cut = np.array([-du[y == k].sum() + dl[y == k + 1].sum() for k in range(cuts)]) / n
        tails = np.cumsum(by_cut[::-1])[::-1]
        out[d] = tails[0]
        out[d + 1 :] = tails[1:] * np.exp(p[d + 1 :])
        return out

    start = np.zeros(d + cuts)
    start[d] = -1.0
    p = adam(gradient, start, steps=400)
    return p[:d], thresholds(p)


def train(documents: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", per_grade: int = PER_GRADE) -> dict | None:
    """A model from rated (id, grade) rows; grades are small integers, null ones are left out. None if there is no rated text."""
    rated = rated.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).dropna().groupBy("id").agg(F.min("grade").alias("grade"))
    counts = {r.grade: r["count"] for r in rated.groupBy("grade").count().collect()}
    grades = sorted(counts)
    if not grades:
        return None
    chosen = F.broadcast(sample_ids(rated, "id", "grade", grades, per_grade))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = shape_features(batch.column("text"), DIMS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["id", "grade", "x"])

    rows = sorted(docs.mapInArrow(features, "id long, grade int, x binary").collect())
    if not rows:
        return None
    x = np.vstack([np.frombuffer(r.x, dtype=np.float16) for r in rows]).astype(np.float32)
    scale = np.maximum(x.std(axis=0), 1e-3)
    y = np.array([grades.index(r.grade) for r in rows])
    # The sample holds up to per_grade rows of each grade; weights give grades their share among all ratings back.
    held = np.bincount(y, minlength=len(grades))
    share = np.array([counts[g] for g in grades]) / sum(counts.values())
    weight = (share / np.maximum(held / len(y), 1e-9))[y]
    if len(grades) == 1:
        return {"grades": grades, "w": np.zeros(DIMS), "cuts": np.empty(0)}
    w, cuts = fit_ordinal(x / scale, y, weight, len(grades))
    return {"grades": grades, "w": w / scale, "cuts": cuts}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """P(grade > k) for each cut k, row by row."""
    return sigmoid((x @ model["w"])[:, None] - model["cuts"][None, :])


def score(documents: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", above: int = 0, threshold: float = 0.5) -> DataFrame:
    """id_col, expected_grade, tail_probability (of a grade above `above`) and kept (that reaches threshold).

    One row for each input row; other columns are left out. Null text counts as empty; empty texts are scored like others.
    Without a model (no ratings) expected_grade and tail_probability are null and all rows are kept.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return docs.select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            expected, tail = grade(model, batch.column("text"), above)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(expected), pa.array(tail), pa.array(tail >= threshold)], names=[id_col, "expected_grade", "tail_probability", "kept"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, tail_probability double, kept boolean")


def grade(model: dict, texts: pa.Array, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and the probability of a grade above `above`."""
    tails = probabilities(model, shape_features(texts, DIMS))
    grades = np.array(model["grades"], dtype=float)
    expected = grades[0] + tails @ np.diff(grades)
    over = int(np.searchsorted(grades, above, side="right"))  # the first grade above
    tail = np.ones(len(tails)) if over == 0 else tails[:, over - 1] if over < len(grades) else np.zeros(len(tails))
    return expected, tail


def keep(documents: DataFrame, model: dict | None, text_col: str = "text", above: int = 0, threshold: float = 0.5) -> DataFrame:
    """The rows of documents whose tail probability reaches threshold, with all their columns, in one narrow scan."""
    if model is None:
        return documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            _, tail = grade(model, batch.column(batch.schema.get_field_index(text_col)), above)
            yield batch.filter(pa.array(tail >= threshold))

    return documents.mapInArrow(run, documents.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 low quality, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
