"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else, as ``bytes.lower`` does."""
    return F.translate(text, _UPPER, _UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's own where it is set.

    Where neither is, a session on one machine gets a folder of its own; on a cluster that is refused, as executors couldn't see one another's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return where or "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there, so that a lost executor costs no recomputation.

    checkpoint() is used where the context has a folder (spark.checkpoint.dir names it); a
    session that has none, as in small tests, gets one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: columns compressed, unlike checkpoint()."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` don't lie above a value; in two steps, so that not all of them are looked at for each row."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= value))
    block = below(F.lit(cuts[step - 1 :: step])) * step
    return (block + below(F.slice(F.lit(cuts), block + 1, F.lit(step)))).cast("int")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(over, schema)


def release() -> None:
    """Give the system back what earlier tasks of this Python worker, which Spark keeps for others, have freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null becomes the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, without decoding them; null becomes the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t if t is not None else b"" for t in column.cast(kind).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows at most, so that lists of their texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_hashes(text: bytes, shingle_words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of so many words of a UTF-8 text, repeats included, in lower case and joined by a space, a block at a time.

    A text with fewer words is one run; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    del words
    starts, last = np.concatenate([[0], ends[:-1] + 1]), ends[min(shingle_words, len(ends)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(last), 65_536):
        some = last[i : i + 65_536]
        yield np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[i : i + 65_536].tolist(), some.tolist())), np.uint64, len(some))
