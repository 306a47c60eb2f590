"""Change logs: folding to the last image per key, and applying what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import _joined

DELETE, INSERT, BEFORE, AFTER = 1, 2, 3, 4
BUDGET_ROWS, BUDGET_BYTES = 1_000_000, 512 * 1024 * 1024


def with_key_changes(log: DataFrame, key: Sequence[str], old_key: Sequence[str]) -> DataFrame:
    """A log whose updates of the key are a delete of the old key and an upsert of the new one.

    ``old_key`` names columns that hold the key before the change (null: unchanged). Of one change the delete goes first.
    """
    moved = F.lit(False)
    for k, o in zip(key, old_key):
        moved = moved | (F.col(o).isNotNull() & ~F.col(o).eqNullSafe(F.col(k)))
    kept = [c for c in log.columns if c not in old_key]
    upserts = log.select(*kept, F.lit(1).alias("_step"))
    gone = log.where((F.col("op") == AFTER) & moved).select(*(F.coalesce(F.col(old_key[list(key).index(c)]), F.col(c)).alias(c) if c in key else F.lit(DELETE).cast(log.schema["op"].dataType).alias("op") if c == "op" else F.col(c) for c in kept), F.lit(0).alias("_step"))
    return gone.unionByName(upserts)


def fold(log: DataFrame, key: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The last image of each key, by the total order ``order``; before-images don't count. ``within`` folds transactions separately."""
    last = Window.partitionBy(*within, *key).orderBy(*(F.col(c).desc() for c in order))
    return log.where(F.col("op") != BEFORE).withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def fold_aggregated(log: DataFrame, key: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """fold() as a maximum: images are combined before the shuffle, so a key with very many changes brings one row from each task."""
    values = [c for c in log.columns if c not in key and c not in within]
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return log.where(F.col("op") != BEFORE).groupBy(*within, *key).agg(newest.alias("_row")).select(*within, *key, "_row.*")


def apply_changes(target: DataFrame, folded: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target after folded changes: rows with a change leave, those of upserts come back in their last image."""
    columns = [c for c in target.columns if c in folded.columns]
    upserts = folded.where(F.col("op") != DELETE).select(*columns)
    return _joined(target, folded, key, "left_anti").unionByName(upserts, allowMissingColumns=True)


def row_bytes(schema: T.StructType) -> Column:
    """Estimated size of a buffered row: two bytes a character, bytes as they are, 32 for other values, 16 for the row."""
    total = F.lit(16)
    for f in schema:
        c = F.col(f"`{f.name}`")
        size = 2 * F.length(c) if isinstance(f.dataType, T.StringType) else F.octet_length(c) if isinstance(f.dataType, T.BinaryType) else F.lit(32)
        total = total + F.coalesce(size, F.lit(0))
    return total


def over_budget(log: DataFrame, transaction: str, rows: int = BUDGET_ROWS, size: int = BUDGET_BYTES) -> DataFrame:
    """Transactions that are too large to buffer: (transaction, rows, bytes)."""
    values = T.StructType([f for f in log.schema if f.name != transaction])
    return log.groupBy(transaction).agg(F.count("*").alias("rows"), F.sum(row_bytes(values)).alias("bytes")).where((F.col("rows") > rows) | (F.col("bytes") > size))


def lsn_key(text: Column) -> Column:
    """A log position as a sortable number: hexadecimal ``X/Y``, or hexadecimal with or without 0x; null where it is neither."""
    hexed = lambda c: F.conv(c, 16, 10).cast("decimal(38,0)")
    halves = F.split(text, "/")
    plain = F.regexp_replace(text, "^0[xX]", "")
    wide = F.lpad(plain, 32, "0")
    return F.when(text.rlike("^[0-9a-fA-F]{1,8}/[0-9a-fA-F]{1,8}$"), hexed(halves[0]) * F.lit(2**32).cast("decimal(20,0)") + hexed(halves[1])).when(
        plain.rlike("^[0-9a-fA-F]{1,31}$"), hexed(F.left(wide, F.lit(16))).cast("decimal(18,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") + hexed(F.right(wide, F.lit(16)))
    )


def binlog_key(file: Column, position: Column) -> Column:
    """(number of the file, position), sortable."""
    return F.struct(F.regexp_extract(file, r"(\d+)$", 1).cast("long").alias("file"), position.cast("long").alias("position"))


def lsn_window(log: DataFrame, low: str | None, high: str, column: str = "lsn") -> DataFrame:
    """Changes in (low, high]. A low position beyond the high one is a log that was recreated: everything up to high counts."""
    at = lsn_key(F.col(column))
    up_to = log.where(at <= lsn_key(F.lit(high)))
    return up_to if low is None else up_to.where((at > lsn_key(F.lit(low))) | (lsn_key(F.lit(low)) > lsn_key(F.lit(high))))
