"""Ordinal cumulative-link regression on graded ratings.

Grades 0 .. G-1 share one vector of hashed-text weights f and ordered thresholds t:
P(grade <= k) = sigmoid(t[k] - f(text)). Expected grade and tail probabilities P(grade >= k) select documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, sliced
from .hashed_text import Sample, Sparse, fit_relaxed, fitted, labelled, score, sigmoid

GRADES = 3
#: A document is kept if it reaches this grade with this probability.
KEEP_GRADE, KEEP_AT_LEAST = 2, 0.7
L1 = 8e-3
#: Least distance of neighbouring thresholds.
GAP = 1e-3


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray
    slope: float = 1.0

    def tails(self, value: float) -> np.ndarray:
        """P(grade >= k) for k = 1 .. G-1."""
        return 1 - sigmoid(self.thresholds - self.slope * value)

    def of(self, text: bytes) -> np.ndarray:
        return self.tails(score(self.weights, text) if len(self.weights) else 0.0)


def _ordered(t: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(t - GAP * np.arange(len(t))) + GAP * np.arange(len(t))


def _limits(t: np.ndarray, y: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= y) and P(grade < y) for each row."""
    padded = np.concatenate([[-np.inf], t, [np.inf]])
    return sigmoid(padded[y + 1] - value), sigmoid(padded[y] - value)


def _threshold_slopes(t: np.ndarray, y: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    share = np.maximum(upper - lower, 1e-9)
    up, down = upper * (1 - upper) / share, lower * (1 - lower) / share
    return np.bincount(y, -up, len(t) + 1)[: len(t)] + np.bincount(y, down, len(t) + 1)[1:]


def _start(y: np.ndarray, grades: int) -> np.ndarray:
    share = np.cumsum(np.bincount(y, minlength=grades) + 1.0)[:-1] / (len(y) + grades)
    return _ordered(np.log(share / (1 - share)))


def fit(sample: Sample, grades: int = GRADES, l1: float = L1) -> CumulativeLink:
    """Weights and thresholds from four fifths of the sample; slope and thresholds are then set anew on the last fifth.

    A sample without two grades gives the smoothed shares of its grades for every text.
    """
    y = sample.labels.astype(np.int64)
    train = sample.fold != 0
    if len(np.unique(y[train])) < 2:
        return CumulativeLink(np.zeros(0), _start(y, grades))
    x, target = Sparse(sample, train), y[train]
    t = [_start(target, grades)]

    def loss(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upper, lower = _limits(t[0], target, value)
        t[0] = _ordered(t[0] - np.clip(_threshold_slopes(t[0], target, upper, lower) / x.rows, -0.5, 0.5))
        return (1 - upper - lower) / x.rows, (upper * (1 - upper) + lower * (1 - lower)) / x.rows

    weights = fit_relaxed(x, loss, 0.5, l1)
    value = sample.scores(weights)
    return CumulativeLink(weights, *_calibrated(t[0], value[~train], y[~train]))


def _calibrated(t: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    slope, n = 1.0, len(y)
    if n < 20 or len(np.unique(y)) < 2:
        return t, slope
    spread = max(1.0, float((value**2).mean()))
    for _ in range(rounds):
        upper, lower = _limits(t, y, slope * value)
        t = _ordered(t - np.clip(_threshold_slopes(t, y, upper, lower) / n, -0.2, 0.2))
        slope = max(0.1, slope - float(((1 - upper - lower) * value).mean() + 0.01 * (slope - 1)) / spread)
    return t, slope


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grades: int = GRADES) -> CumulativeLink:
    """Fit on ``ratings`` (id, y): grades 0 .. grades - 1, one row for each id. The fit is on a bounded sample of them.

    Without any rated text every grade is equally likely.
    """
    return fitted(docs, ratings, id_col, text_col, lambda sample: fit(sample, grades))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Graded ratings (id, y) from quality and toxicity: 0 toxic, 1 poor, 2 good. Of repeated labels the lowest counts; nulls count as good and not toxic."""
    good, toxic = F.coalesce(F.col("quality"), F.lit(1)), F.coalesce(F.col("toxic"), F.lit(0))
    return labelled(labels, "doc_id", F.when(toxic == 1, 0).when(good == 0, 1).otherwise(2))


def graded(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text", keep_grade: int = KEEP_GRADE, keep_at_least: float = KEEP_AT_LEAST) -> DataFrame:
    """doc_id, expected_grade, p_ge_1 .. p_ge_(G-1) and kept for every row. Null texts count as empty; ids may be null or repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tails = [f"p_ge_{k}" for k in range(1, len(model.thresholds) + 1)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([shared.value.of(t) for t in bytes_of(batch.column(1))]).reshape(batch.num_rows, len(tails))
            kept = found[:, keep_grade - 1] >= keep_at_least
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.sum(1)), *(pa.array(np.ascontiguousarray(c)) for c in found.T), pa.array(kept)], ["doc_id", "expected_grade", *tails, "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over, "doc_id long, expected_grade double, " + ", ".join(f"{c} double" for c in tails) + ", kept boolean")
