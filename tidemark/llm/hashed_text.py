"""Hashed features of texts, a bounded sample of labelled rows, and sparse fitting. Shared by the two text classifiers.

A text has the hashes of its words and word pairs (present or not), and the shares of its hashed
byte triples and of the word pairs that repeat a word.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, written

WORD_BITS, TRIPLE_BITS = 18, 13
#: Labelled rows to fit on: about so many, chosen by a hash of their id; the only bound, and it bounds the fit alone.
SAMPLE = 8192
#: A word or pair needs so many texts of the sample.
MIN_TEXTS = 4
#: What a share counts, against the presence of a word.
SHARE_SCALE = 20.0
#: Columns that enter the working set of a sparse fit at once.
WORKED = 256
#: Rows of the sample that are multiplied at once.
BLOCK_ROWS = 2048

_WORDS = 1 << WORD_BITS
_TRIPLES = 1 << TRIPLE_BITS
#: Columns: words, pairs, triples, repeated pairs.
REPEATS = 2 * _WORDS + _TRIPLES
WIDTH = REPEATS + 1

#: Lower case; ASCII that is neither letter nor digit becomes a space.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a UTF-8 text; none for an empty one."""
    words = text.translate(_PLAIN).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:]
    single = np.unique(h & np.uint64(_WORDS - 1)).astype(np.int64)
    double = np.unique((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)).astype(np.int64) + _WORDS
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    triple = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIPLE_BITS)
    kinds, counts = np.unique(triple, return_counts=True)
    shares = counts * (SHARE_SCALE / max(1, len(triple)))
    columns = [single, double, kinds.astype(np.int64) + 2 * _WORDS]
    values = [np.ones(len(single) + len(double)), shares]
    if len(h) > 1:
        columns.append(np.array([REPEATS]))
        values.append(np.array([SHARE_SCALE * float((h[1:] == h[:-1]).mean())]))
    return np.concatenate(columns), np.concatenate(values)


def _row_sums(entries: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the entries of each row; rows begin at ``starts``, the last of which is the end."""
    return np.add.reduceat(np.append(entries, 0.0), starts[:-1] - starts[0]) * (np.diff(starts) > 0)


@dataclass
class Sample:
    """Features of the sampled rows, and their labels, as compressed rows."""

    labels: np.ndarray
    fold: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.labels)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of each row, a block of rows at a time."""
        out = np.zeros(len(self))
        for at in range(0, len(self), BLOCK_ROWS):
            some = self.starts[at : at + BLOCK_ROWS + 1]
            entries = slice(int(some[0]), int(some[-1]))
            out[at : at + len(some) - 1] = _row_sums(weights[self.columns[entries]] * self.values[entries], some)
        return out


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, size: int = SAMPLE) -> DataFrame:
    """Features of about ``size`` labelled texts, a row for each. ``labels`` has the columns id and y, one row for each id.

    Rows are chosen by a threshold on a hash of the id, so the same rows come again in any order of reading. Columns that fewer than
    MIN_TEXTS of the texts have can't enter a fit; they are counted and left out on the executors.
    """
    there = labels.count()
    if there > size:
        labels = labels.where(F.xxhash64(F.lit("sample"), "id") < F.lit(int((2 * size / there - 1) * 2**63)))
    bounded = F.broadcast(labels.select(F.col("id").alias("_id"), F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)).cast("int").alias("fold")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(bounded, "_id").select("_id", "y", "fold", "text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in bytes_of(batch.column(3))]
            columns = pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32()))
            values = pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), columns, values], ["id", "y", "fold", "columns", "vals"])

    kind = dict(rows.dtypes)["_id"]
    schema = f"id {kind}, y int, fold int, columns array<int>, vals array<float>"
    found = written(rows.mapInArrow(over, schema), "sample")
    common = found.select(F.explode("columns").alias("c")).groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS).select("c").toArrow()["c"].to_numpy()
    mask = np.zeros(WIDTH, bool)
    mask[common.astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(shared.value, count=WIDTH).astype(bool)
        for batch in batches:
            lists = [(c.values.to_numpy(), v.values.to_numpy()) for c, v in zip(batch.column(3), batch.column(4))]
            held = [used[c] for c, _ in lists]
            columns = pa.array([c[h] for (c, _), h in zip(lists, held)], pa.list_(pa.int32()))
            values = pa.array([v[h] for (_, v), h in zip(lists, held)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], columns, values], ["id", "y", "fold", "columns", "vals"])

    return found.mapInArrow(thinned, schema)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Sample:
    """Rows of sampled() in one place; what they come in is let go as it is read."""
    labels, folds, sizes, columns, values = [], [], [], [], []
    for batch in batches:
        labels.append(np.array(batch.column(1)))
        folds.append(np.array(batch.column(2)))
        sizes.append(np.array(batch.column(3).value_lengths()))
        columns.append(np.array(batch.column(3).flatten(), np.int32))
        values.append(np.array(batch.column(4).flatten(), np.float32))
    whole = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if len(parts) > 1 else parts[0].astype(kind, copy=False) if parts else np.zeros(0, kind)
    starts = np.concatenate([np.zeros(1, np.int64), whole(sizes, np.int64)]).cumsum()
    return Sample(whole(labels, np.int32), whole(folds, np.int32), starts, whole(columns, np.int32), whole(values, np.float32))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit: Callable[[Sample], Any], size: int = SAMPLE) -> Any:
    """What ``fit`` makes of the sample. One task gathers it, which the size bounds, and fits; the driver gets the model alone."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = _gathered(part for batch in batches for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], ["model"])

    rows = sampled(docs, labels, id_col, text_col, size).repartition(1).sortWithinPartitions("id", "y", "fold")
    found = rows.mapInArrow(over, "model binary").first()
    return pickle.loads(found.model) if found else fit(_gathered([]))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, size: int = SAMPLE) -> Sample:
    """The sample on the driver, to look at."""
    return _gathered(sampled(docs, labels, id_col, text_col, size).orderBy("id", "y", "fold").toArrow().to_batches())


#: First and second derivatives of the mean loss by each row's score.
Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class Sparse:
    """The sampled rows as a matrix over the columns that enough texts have; the sample's own arrays, a block of rows at a time."""

    def __init__(self, sample: Sample, rows: np.ndarray) -> None:
        self.wanted, self.rows, self.starts, self.value = rows, int(rows.sum()), sample.starts, sample.values
        texts = np.zeros(WIDTH, np.int64)
        for at, end, entries in self._blocks():
            held = np.repeat(rows[at:end], np.diff(self.starts[at : end + 1]))
            texts += np.bincount(sample.columns[entries][held], minlength=WIDTH)
        self.used = np.flatnonzero(texts >= MIN_TEXTS)
        place = np.full(WIDTH, len(self.used), np.int32)  # one more, of weight 0, for all others
        place[self.used] = np.arange(len(self.used))
        self.column = place[sample.columns]

    def _blocks(self) -> Iterator[tuple[int, int, slice]]:
        """First and last row of each block, and the places of its entries."""
        for at in range(0, len(self.wanted), BLOCK_ROWS):
            end = min(at + BLOCK_ROWS, len(self.wanted))
            yield at, end, slice(int(self.starts[at]), int(self.starts[end]))

    def back(self, g: np.ndarray) -> np.ndarray:
        out, whole = np.zeros(len(self.used) + 1), np.zeros(len(self.wanted))
        whole[self.wanted] = g
        for at, end, entries in self._blocks():
            share = np.repeat(whole[at:end], np.diff(self.starts[at : end + 1]))
            share *= self.value[entries]
            out += np.bincount(self.column[entries], share, len(out))
        return out[:-1]

    def table(self, columns: np.ndarray) -> np.ndarray:
        """Some of the columns in full; a row for each text."""
        place = np.append(np.where(columns, np.cumsum(columns) - 1, -1), -1)
        out = np.zeros((len(self.wanted), int(columns.sum())))
        for at, end, entries in self._blocks():
            column = place[self.column[entries]]
            some = np.flatnonzero(column >= 0)
            out[np.repeat(np.arange(at, end), np.diff(self.starts[at : end + 1]))[some], column[some]] = self.value[entries][some]
        return out[self.wanted]


def _steepest(table: np.ndarray) -> float:
    """About the largest eigenvalue of X'X."""
    v, size = np.ones(table.shape[1]), 1.0
    for _ in range(12):
        v = table.T @ (table @ v)
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    return size


def fit_sparse(x: Sparse, loss: Loss, curve: float, l1: float, rounds: int = 150) -> np.ndarray:
    """Weights with few entries, the minimum of the mean loss plus ``l1`` times their sum.

    ``curve`` bounds the second derivatives of a row's loss. Columns enter a working set while their slope exceeds the penalty, the steepest first; proximal
    gradient steps with momentum go over that set alone. It ends when no column outside could lower the sum, so all columns count, though few are worked on.
    """
    w, working = np.zeros(len(x.used)), np.zeros(len(x.used), bool)
    slopes = np.abs(x.back(loss(np.zeros(x.rows))[0]))
    while len(fresh := np.flatnonzero((slopes > l1 * (1 + 1e-3)) & ~working)):
        working[fresh[np.argsort(-slopes[fresh], kind="stable")[:WORKED]]] = True
        table = x.table(working)
        step, now = x.rows / (curve * _steepest(table) * 1.05), w[working]
        ahead, t = now, 1.0
        for _ in range(rounds):
            moved = ahead - step * (table.T @ loss(table @ ahead)[0])
            after = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            ahead, now = after + (was - 1) / t * (after - now), after
        w[working] = now
        slopes = np.abs(x.back(loss(table @ now)[0]))
    return w


def fit_relaxed(x: Sparse, loss: Loss, curve: float, l1: float, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights over all columns: a strong penalty chooses few columns, then Newton steps set their weights, free of its shrinkage."""
    out = np.zeros(WIDTH)
    w = fit_sparse(x, loss, curve, l1)
    chosen = w != 0
    if chosen.any():
        table, v = x.table(chosen), w[chosen]
        for _ in range(rounds):
            g, h = loss(table @ v)
            step = np.linalg.solve(table.T @ (h[:, None] * table) + ridge / x.rows * np.eye(len(v)), table.T @ g + ridge / x.rows * v)
            v = v - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        out[x.used[chosen]] = v
    return out


def score(weights: np.ndarray, text: bytes) -> float:
    columns, values = features(text)
    return float(weights[columns] @ values)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z)))


def labelled(labels: DataFrame, id_col: str, y: Column) -> DataFrame:
    """One row for each id with a grade; of repeated ids the lowest grade counts. Null ids and grades fall away."""
    return labels.select(F.col(id_col).alias("id"), y.alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.min("y").alias("y"))
