"""Counted tables of distinct words, and the bounded part of them that may go to every executor."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, sliced

#: Words that a task counts before it passes them on.
FLUSH = 250_000


def counted(df: DataFrame, words_of: Callable[[bytes], Iterable[bytes]]) -> DataFrame:
    """(word, n): how often each word occurs in the texts of the only column of ``df``.

    Tasks count before the shuffle, and pass their counts on when they hold FLUSH words; so a very common word
    comes to the shuffle once a task, and memory stays bounded.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in sliced(batches):
            for text in bytes_of(batch.column(0)):
                if text:
                    counts.update(words_of(text))
                    if len(counts) > FLUSH:
                        yield batch_of()
                        counts.clear()
        if counts:
            yield batch_of()

    return df.mapInArrow(over, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def heaviest(counts: DataFrame, most: int) -> DataFrame:
    """The commonest words, at most ``most`` of them: those over a threshold that a histogram of bounded size gives. No sort."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    taken, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        taken += row.words
        if taken > most:
            break
        least = row.level
    return counts.where(level >= least) if least is not None else counts.where(F.lit(False))
