"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_partitions

#: Edges that a file of the checkpointed table holds at least.
FILE_EDGES = 100_000


def contract(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside one block, as a forest: every node of the edges but the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, before[a], low)
        np.minimum.at(least, before[b], low)
        least = least[least]
        if np.array_equal(least, before):
            break
    member = least != np.arange(len(nodes))
    return nodes[member], nodes[least[member]]


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` that is not the least of its component; root is that least node.

    Alternating large-star and small-star steps over the edge table. A step groups by node with a
    minimum, which is partly computed before the shuffle, and joins that minimum back, which
    adaptive execution splits for a node with very many edges; no step gathers a node's neighbours.
    The edge table is checkpointed after each round. A table that fits one file, of FILE_EDGES edges at most, is contracted by the task that reads it, which
    ends the rounds before the first. An empty edge table gives an empty result.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    stars = cut(edges.select(high.alias("node"), low.alias("root")).where("node <> root").distinct())
    seen = _digest(stars)
    files = 1 + seen[0] // FILE_EDGES
    if files == 1 and stars.schema["node"].dataType == T.LongType():
        return cut(stars.coalesce(1).mapInArrow(_forest, "node long, root long"))
    if files < shuffle_partitions(edges.sparkSession):  # a small table in few files, whatever the number of partitions
        few = lambda df: df.coalesce(files)
    else:
        few = lambda df: df
    while True:
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        lower = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(lower, "node")
        stars = cut(few(small.where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root")).unionByName(small.select("node", F.col("least").alias("root"))).distinct()))
        now = _digest(stars)
        if now == seen:
            return stars
        seen = now


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a whole table, as a forest."""
    held = [(np.array(batch.column(0)), np.array(batch.column(1))) for batch in batches if batch.num_rows]
    if held:
        nodes, roots = contract(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])


def _digest(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return tuple(row)
