"""A hidden Markov language model over words.

Symbols are the commonest words, the end of a text, and classes of all other words by their last characters. A hidden state
emits a symbol; a class symbol is then spelled out as one of its words by their counts, or as a word
that training never saw. So a text has an exact probability: the forward recursion over its symbols, times
the shares of its rarer words in their classes. Baum-Welch passes run over every training text: tasks return expected counts, which
are summed and make the next parameters.

Counts cover every training text. Only the commonest HOT words go to all executors; the others are
joined with their counts by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, sliced, written
from .wordtable import counted, heaviest

#: Words with counts that go to every executor, and those of them that are symbols: bounds, not tuned to data.
HOT, SYMBOLS = 131_072, 16_384
#: A symbol of its own needs so many occurrences; rarer words leave their counts to classes, so that these say how often such words come.
SYMBOL_COUNT = 3
CLASSES, SUFFIX = 1024, 3
STATES, PASSES = 8, 5
#: Weight, in tokens, of the corpus distribution in each state's emissions.
PRIOR = 50.0
#: Tokens whose forward and backward vectors are held at once.
BATCH_TOKENS = 300_000


@dataclass(frozen=True)
class Layout:
    """Numbers of the symbols: common words first, then the end, then the classes."""

    words: int
    classes: int = CLASSES

    @property
    def end(self) -> int:
        return self.words

    @property
    def size(self) -> int:
        return self.words + 1 + self.classes

    def of_class(self, word: bytes) -> int:
        return self.words + 1 + zlib.crc32(word.decode("utf-8", "replace")[-SUFFIX:].encode()) % self.classes


@dataclass
class Parameters:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row for each symbol

    @cached_property
    def padded(self) -> np.ndarray:
        """Emissions with a last row of zeros, for the places behind the end of a text, which hold -1."""
        return np.concatenate([self.emit, np.zeros((1, len(self.start)))])


def is_held_out(doc_id: Column) -> Column:
    """The fold that training never sees: crc32 of the id as text, mod 5, is 1. A null id is training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# vocabulary --------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """What the training texts hold. counts has (word, n) for every distinct word; hot is bounded by HOT."""

    counts: DataFrame
    layout: Layout
    hot: dict[bytes, int]
    hot_symbol: np.ndarray
    hot_base: np.ndarray
    hot_share: np.ndarray
    end_known: bool
    end_base: float
    class_total: np.ndarray
    tokens: int
    base_divisor: float
    symbol_counts: np.ndarray


def build_vocabulary(training: DataFrame) -> Vocabulary:
    """Counts over the only column, text, of ``training``."""
    counts = written(counted(training, lambda t: t.lower().split()), "word-counts")
    texts = training.count()
    words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = words[0] + texts, words[1] + (texts > 0)
    divisor = tokens + 0.5 * (distinct + 1)

    hot = sorted(((r.word.encode(), r.n) for r in heaviest(counts, HOT).collect()), key=lambda x: (-x[1], x[0]))
    layout = Layout(min(SYMBOLS, sum(n >= SYMBOL_COUNT for _, n in hot)))
    first_class = layout.words + 1
    kinds, sums = np.zeros(layout.classes), np.zeros(layout.classes)
    suffix = F.crc32(F.right(F.col("word"), F.lit(SUFFIX)).cast("binary")) % layout.classes
    for r in counts.groupBy(suffix.cast("int").alias("c")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect():
        kinds[r.c], sums[r.c] = r.kinds, r.n
    for word, n in hot[: layout.words]:  # these are symbols of their own
        c = layout.of_class(word) - first_class
        kinds[c] -= 1
        sums[c] -= n
    total = sums + 0.5 * (kinds + 1)
    number = np.array([n for _, n in hot], float)
    symbol = np.array([i if i < layout.words else layout.of_class(w) for i, (w, _) in enumerate(hot)], np.int64)
    share = np.zeros(len(hot))
    share[layout.words :] = np.log10((number[layout.words :] + 0.5) / total[symbol[layout.words :] - first_class])
    return Vocabulary(
        counts=counts,
        layout=layout,
        hot={w: i for i, (w, _) in enumerate(hot)},
        hot_symbol=symbol,
        hot_base=np.log10((number + 0.5) / divisor),
        hot_share=share,
        end_known=texts > 0,
        end_base=float(np.log10(((texts if texts else 0) + 0.5) / divisor)),
        class_total=total,
        tokens=tokens,
        base_divisor=divisor,
        symbol_counts=np.concatenate([number[: layout.words], [texts], sums]),
    )


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, symbols array<int>, rare array<struct<word:string,n:int>>"

_ENCODED_TYPES = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("share", pa.float64()),
        ("symbols", pa.list_(pa.int32())),
        ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))),
    ]
)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as symbols, with the sums over hot words and the counted rarer words of each; written once to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.hot, vocabulary.hot_symbol, vocabulary.hot_base, vocabulary.hot_share))
    layout, end_known, end_base = vocabulary.layout, vocabulary.end_known, vocabulary.end_base

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_symbol, hot_base, hot_share = shared.value
        hot_symbol, hot_base, hot_share = np.append(hot_symbol, -1), np.append(hot_base, 0.0), np.append(hot_share, 0.0)
        none = len(hot)
        for batch in sliced(batches):
            rows: list[tuple] = []
            others: list[Counter[bytes]] = []
            for text in bytes_of(batch.column(3)):
                words = text.lower().split()
                at = np.fromiter((hot.get(w, none) for w in words), np.int64, len(words))
                symbols = np.append(hot_symbol[at], layout.end).astype(np.int32)
                places = np.flatnonzero(at == none)
                rare = [words[i] for i in places.tolist()]
                symbols[places] = [layout.of_class(w) for w in rare]
                others.append(Counter(rare))
                known = len(words) - len(rare) + end_known
                rows.append((len(words) + 1, known, float(hot_base[at].sum()) + end_base, float(hot_share[at].sum()), symbols))
            columns = list(zip(*rows))
            ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends([len(x) for x in columns[4]]), pa.array(np.concatenate(columns[4])))
            word = pa.array([w for c in others for w in c], pa.binary()).cast(pa.string())
            times = pa.array([n for c in others for n in c.values()], pa.int32())
            pairs = pa.ListArray.from_arrays(ends([len(c) for c in others]), pa.StructArray.from_arrays([word, times], ["word", "n"]))
            made = [pa.array(c, t) for c, t in zip(columns[:4], _ENCODED_TYPES.types[3:7])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made, lists, pairs], _ENCODED_TYPES.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return written(rows.mapInArrow(over, ENCODED), "symbols")


# training ----------------------------------------------------------------------------------------


def _grouped(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of texts of like length: their rows, longest first, and their symbols as a matrix padded with -1."""
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, int(lengths[order[at]]))
        rows = order[at : at + max(1, BATCH_TOKENS // longest)]
        matrix = np.full((longest, len(rows)), -1, np.int64)
        for j, r in enumerate(rows):
            matrix[: lengths[r], j] = flat[offsets[r] : offsets[r + 1]]
        yield rows, matrix
        at += len(rows)


def _ahead(p: Parameters, symbols: np.ndarray, alive: list[int], state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of the scaled recursion on from ``state``, or from the start: emissions and vectors (0 where a text has ended) and scales of all of them."""
    emissions, ones = p.padded[symbols], np.ones(len(p.start))
    vectors, scales = np.zeros_like(emissions), np.ones(symbols.shape)
    for t, n in enumerate(alive):
        now, scale = vectors[t, :n], scales[t, :n]
        if state is None:
            np.multiply(p.start, emissions[t, :n], out=now)
        else:
            np.matmul(state[:n], p.move, out=now)
            now *= emissions[t, :n]
        np.matmul(now, ones, out=scale)
        now /= scale[:, None]
        state = now
    return emissions, vectors, scales


def _blocks(symbols: np.ndarray, tokens: int) -> tuple[list[int], list[tuple[int, int]]]:
    """How many texts go on at each step, and first and last steps of blocks of about so many tokens.

    Columns go from long to short, so that those that go on are the first ones.
    """
    steps, texts = symbols.shape
    size = max(1, tokens // max(1, texts))
    return (symbols >= 0).sum(1).tolist(), [(i, min(steps, i + size)) for i in range(0, steps, size)]


def forward(p: Parameters, symbols: np.ndarray, tokens: int = BATCH_TOKENS) -> np.ndarray:
    """Log10 likelihoods of columns of symbols, padded with -1, by the scaled forward recursion; vectors of so many ``tokens`` are held at once."""
    alive, blocks = _blocks(symbols, tokens)
    total, state = np.zeros(symbols.shape[1]), None
    for first, last in blocks:
        _, vectors, scales = _ahead(p, symbols[first:last], alive[first:last], state)
        total += np.log10(scales).sum(0)
        state = vectors[-1].copy()
    return total


def expected(p: Parameters, symbols: np.ndarray, tokens: int = BATCH_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions for columns of symbols.

    Vectors of so many ``tokens`` are held at once; those of a longer text are made again, from the state at the start of their block, on the way back.
    """
    alive, blocks = _blocks(symbols, tokens)
    states, texts = len(p.start), symbols.shape[1]
    held: list[np.ndarray | None] = [None]
    for first, last in blocks:
        made = _ahead(p, symbols[first:last], alive[first:last], held[-1])
        held.append(made[1][-1].copy())
    move, emit = np.zeros_like(p.move), np.zeros((len(p.emit), states))
    after, later, turned = np.ones((texts, states)), 0, np.ascontiguousarray(p.move.T)
    for k in range(len(blocks) - 1, -1, -1):
        first, last = blocks[k]
        emissions, vectors, scales = made if last == len(alive) else _ahead(p, symbols[first:last], alive[first:last], held[k])
        emissions /= scales[:, :, None]
        back = np.ones_like(vectors)
        for t in range(last - first - 1, -1, -1):
            # ``after``: what the step that follows passes back, for the texts that have one
            if later:
                if t + 1 == last - first:  # it lies in the block behind this one
                    move += vectors[t, :later].T @ after[:later]
                np.matmul(after[:later], turned, out=back[t, :later])
            later = alive[first + t]
            np.multiply(emissions[t, :later], back[t, :later], out=after[:later])
        emissions *= back
        move += vectors[:-1].reshape(-1, states).T @ emissions[1:].reshape(-1, states) if last - first > 1 else 0
        vectors *= back
        if not first:
            start = vectors[0].sum(0)
        which = symbols[first:last].ravel()
        seen = np.flatnonzero(which >= 0)
        weight = np.ascontiguousarray(vectors.reshape(-1, states)[seen].T)
        emit += np.stack([np.bincount(which[seen], w, len(p.emit)) for w in weight], 1)
    return start, move * p.move, emit


def initial(vocabulary: Vocabulary, states: int, seed: int = 7) -> Parameters:
    """States that stay, with the corpus distribution under a fixed disturbance each."""
    share = vocabulary.symbol_counts + 0.5
    emit = share[:, None] * np.exp(np.random.default_rng(seed).normal(0, 0.5, (len(share), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(0))


def baum_welch(encoded: DataFrame, vocabulary: Vocabulary, states: int = STATES, passes: int = PASSES) -> Parameters:
    """Parameters after so many passes over all training texts."""
    p = initial(vocabulary, states)
    size = vocabulary.layout.size
    corpus = (vocabulary.symbol_counts + 0.5) / (vocabulary.symbol_counts + 0.5).sum()
    names = [f"k{k}" for k in range(states)]
    schema = "item int, " + ", ".join(f"{n} double" for n in names)
    for _ in range(passes):
        now = p

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
            for batch in batches:
                for _, symbols in _grouped(batch.column(0)):
                    for into, found in zip((start, move, emit), expected(now, symbols)):
                        into += found
            items = np.concatenate([emit, move, start[None, :]])
            some = np.flatnonzero(items.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(items[some, k]) for k in range(states))], ["item", *names])

        sums = np.zeros((size + states + 1, states))
        for r in encoded.where(~F.col("held_out")).select("symbols").mapInArrow(over, schema).groupBy("item").agg(*(F.sum(n).alias(n) for n in names)).collect():
            sums[r[0]] = r[1:]  # size + states + 1 rows at most
        emit = sums[:size] + PRIOR * corpus[:, None]
        move, start = sums[size : size + states] + 1e-3, sums[-1] + 1e-3
        p = Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return p


# scoring -----------------------------------------------------------------------------------------


def likelihoods(encoded: DataFrame, p: Parameters) -> DataFrame:
    """The encoded rows without their arrays, and the log10 likelihood of their symbols."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for rows, symbols in _grouped(batch.column(7)):
                found[rows] = forward(p, symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(found)], [*batch.schema.names[:7], "symbols"])

    return encoded.select(*_ENCODED_TYPES.names[:8]).mapInArrow(over, ENCODED[: ENCODED.index("symbols")] + "symbols double")


def rarer(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row, the sums over the words that aren't hot: joined with their counts by word."""
    layout = vocabulary.layout
    each = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    n = F.coalesce(F.col("n"), F.lit(0))
    suffix = (F.crc32(F.right(F.col("word"), F.lit(SUFFIX)).cast("binary")) % layout.classes).cast("int")
    total = F.get(F.lit(vocabulary.class_total.tolist()), suffix)
    found = each.join(vocabulary.counts, "word", "left").select(
        "row",
        F.when(n > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10((n + 0.5) / vocabulary.base_divisor)).alias("base"),
        (F.col("times") * F.log10((n + 0.5) / total)).alias("share"),
    )
    return found.groupBy("row").agg(F.sum("known").alias("rare_known"), F.sum("base").alias("rare_base"), F.sum("share").alias("rare_share"))


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES) -> DataFrame:
    """Train on the texts outside the held-out fold and score every text.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of ``df``. A null or empty text
    is the end token alone. A null id is training. Without training texts all tokens are unseen. Repeated rows
    count as often as they come. An empty table gives an empty result. Other columns are ignored. Texts of any length are scored whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("held_out", is_held_out(F.col("doc_id")))
    vocabulary = build_vocabulary(docs.where(~F.col("held_out")).select("text"))
    encoded = encode(docs, vocabulary)
    p = baum_welch(encoded, vocabulary, states, passes)
    rows = likelihoods(encoded, p).join(rarer(encoded, vocabulary), "row", "left")
    rare = lambda name: F.coalesce(F.col(name), F.lit(0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + rare("rare_known")).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare("rare_base")).alias("base_score"),
        (F.col("symbols") + F.col("share") + rare("rare_share")).alias("score"),
    )
