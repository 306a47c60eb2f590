"""Quality rules: fixed base rules, and calibrated logistic regression over hashed words and characters.

Two regressions are fitted on a bounded sample of labelled rows, one for good quality and one for toxic language. Four
fifths of the sample fit weights, the last fifth calibrates probabilities. Texts are scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, sliced, texts_of
from .hashed_text import Sample, Sparse, features, fit_relaxed, fitted, labelled, sigmoid

MIN_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
GOOD_AT_LEAST, TOXIC_BELOW = 0.5, 0.5
L1 = 8e-3
NO_WEIGHTS = np.zeros(0)


# base rules --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur more than once in the text. Exact: windows are numbered by doubling."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        _, ids = np.unique(ids[: len(ids) - step] * n + ids[step:], return_inverse=True)
        size += step
    found = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def base_rules(text: str) -> Base:
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)] if "\n" in text else []
    return Base(len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


# regression --------------------------------------------------------------------------------------


@dataclass
class Regression:
    """Probability from a score: a fitted line through the calibration rows."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, score: float) -> float:
        return float(sigmoid(np.float64(self.slope * score + self.offset)))


def _line(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one score, with smoothed targets; Newton steps. The slope stays at or above 0."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * score + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * score).sum() + 1e-2 * (a - 1), g.sum()
        haa, hab, hbb = (h * score * score).sum() + 1e-2, (h * score).sum(), h.sum()
        det = max(haa * hbb - hab * hab, 1e-9)
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -1, 1)
    return max(float(a), 0.0), float(b)


def fit(sample: Sample, y: np.ndarray, l1: float = L1) -> Regression:
    """A calibrated regression for the labels ``y`` (0 or 1) of the sample's rows.

    With labels of one kind, or too few rows, it is the smoothed share of that label for every text.
    """
    train = sample.fold != 0
    if min(y.sum(), len(y) - y.sum()) < 2 or train.all() or len(np.unique(y[train])) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Regression(NO_WEIGHTS, 0.0, float(np.log(share / (1 - share))))
    x, target = Sparse(sample, train), y[train].astype(float)
    start = float(np.log((target.mean() + 1e-9) / (1 - target.mean() + 1e-9)))
    intercept = [start]

    def loss(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(score + intercept[0])
        intercept[0] -= float((p - target).mean() / max(1e-2, (p * (1 - p)).mean()))
        return (p - target) / x.rows, p * (1 - p) / x.rows

    weights = fit_relaxed(x, loss, 0.25, l1)
    all_scores = sample.scores(weights)
    a, b = _line(all_scores[~train], y[~train])
    return Regression(weights, a, b)


@dataclass
class Rules:
    good: Regression
    toxic: Regression

    def verdict(self, text: bytes) -> tuple[float, float]:
        columns, values = features(text)
        score = lambda r: float(r.weights[columns] @ values) if len(r.weights) else 0.0
        return self.good.probability(score(self.good)), self.toxic.probability(score(self.toxic))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Rules:
    """Fit both regressions on the labels (doc_id, quality, toxic) of the documents.

    Repeated labels of one document count once: lowest quality, highest toxicity. Null labels count as good and as not toxic; without any
    labelled text the rules pass every text that the base rules pass.
    """
    y = 2 * F.coalesce(F.col("quality"), F.lit(1)) + (1 - F.coalesce(F.col("toxic"), F.lit(0)))
    known = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return fitted(docs, labelled(known, "id", y.cast("int")), id_col, text_col, rules_of)


def rules_of(sample: Sample) -> Rules:
    if not len(sample):
        return Rules(Regression(NO_WEIGHTS, 0.0, 10.0), Regression(NO_WEIGHTS, 0.0, -10.0))
    return Rules(fit(sample, sample.labels // 2), fit(sample, 1 - sample.labels % 2))


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, p_toxic double, kept boolean"
_NAMES = [c.split()[0] for c in SCORED.split(", ")]
_KINDS = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in SCORED.split(", ")]


def scored(df: DataFrame, rules: Rules, carried: list[str], text_col: str = "text") -> DataFrame:
    """The ``carried`` columns of every row with the columns of SCORED. A null text counts as empty, and fails."""
    shared = df.sparkSession.sparkContext.broadcast(rules)
    n = len(carried)
    at = carried.index(text_col) if text_col in carried else n

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in texts_of(batch.column(at)):
                base = base_rules(text)
                good, toxic = shared.value.verdict(text.encode())
                kept = not base.failed and good >= GOOD_AT_LEAST and toxic < TOXIC_BELOW
                rows.append((base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words, base.failed, good, toxic, kept))
            made = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [f"_c{i}" for i in range(n)] + _NAMES)

    inner = df.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)), *([F.col(text_col).cast("string").alias("_text")] if at == n else []))
    kinds = ", ".join(f"_c{i} {t}" for i, t in enumerate(t for _, t in inner.dtypes[:n]))
    out = inner.mapInArrow(over, f"{kinds}, {SCORED}")
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carried)})


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of SCORED for every row; ids may be null or repeat, other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, train(rows, labels), ["doc_id"])


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    Null, empty and very short texts go; ids may be null or repeat, and equal texts share a verdict; an empty table stays empty; other columns, whatever their names, go with their rows.
    """
    columns = docs.columns
    plain = docs.toDF(*(f"_d{i}" for i in range(len(columns))))
    at = {c: f"_d{i}" for i, c in enumerate(columns)}
    rules = train(docs, labels, id_col, text_col)
    return scored(plain, rules, plain.columns, at[text_col]).where("kept").select(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(columns)))
