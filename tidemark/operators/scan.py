"""Scans, pages, ranges and previews."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rendering import preview_binary, preview_text

MAX_PARALLEL = 8
PREVIEW_ROWS = 100


def after_key(key: Sequence[str], last: Sequence[Any]) -> Column:
    """Rows beyond ``last`` in key order: a conjunction of equalities for each prefix, with the next part greater."""
    arms = [reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(key[:i], last[:i])] + [F.col(key[i]) > F.lit(last[i])]) for i in range(len(key))]
    return reduce(lambda a, b: a | b, arms)


def up_to_key(key: Sequence[str], upper: Sequence[Any]) -> Column:
    """Rows up to ``upper`` in key order, the bound included."""
    return ~after_key(key, upper)


def keyset_page(df: DataFrame, key: Sequence[str], size: int, last: Sequence[Any] | None = None, upper: Sequence[Any] | None = None, bound: Column | None = None) -> DataFrame:
    """The next ``size`` rows in key order."""
    for condition in (after_key(key, last) if last is not None else None, up_to_key(key, upper) if upper is not None else None, bound):
        if condition is not None:
            df = df.where(condition)
    return df.orderBy(*key).limit(size)


def key_page(df: DataFrame, key: Sequence[str], size: int, last: Sequence[Any] | None = None) -> DataFrame:
    """As keyset_page(), with the key columns alone."""
    return keyset_page(df.select(*key), key, size, last)


def offset_page(df: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of a table without a key, in the order of all columns that have one."""
    return df.orderBy(*orderable(df)).offset(offset).limit(size)


def orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def fetch_by_keys(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is among ``keys``. Spark picks the join by the size of the keys."""
    return df.join(keys.select(*key).distinct(), list(key), "left_semi")


def range_count(df: DataFrame, column: str, lower: Any, upper: Any) -> DataFrame:
    """Rows in (lower, upper]; None leaves a side open."""
    if lower is not None:
        df = df.where(F.col(column) > F.lit(lower))
    if upper is not None:
        df = df.where(F.col(column) <= F.lit(upper))
    return df.agg(F.count("*").alias("rows"))


def split_ranges(low: int, high: int, parts: int) -> list[tuple[int, int]] | None:
    """(lo, hi] ranges of equal width over [low, high]; the first one starts below ``low``. None where 64 bits don't hold the span."""
    if high < low or parts < 1:
        return []
    span = high - low + 1
    if span >= 2**63 or low - 1 < -(2**63):
        return None
    width = -(-span // parts)
    return [(low - 1 + i * width, min(high, low - 1 + (i + 1) * width)) for i in range(-(-span // width))]


def range_number(column: str, low: Column, high: Column, parts: int) -> Column:
    """The number of the range of split_ranges() that a value falls into, without listing the ranges."""
    width = F.ceil((high - low + 1) / F.lit(parts)).cast("long")
    return F.floor((F.col(column) - low) / width).cast("long")


def sampled_boundaries(df: DataFrame, key: Sequence[str], parts: int) -> DataFrame:
    """The first key of each of ``parts`` equal buckets in key order: ``bucket`` and the key columns.

    NTILE without partitions would bring every key to one task. Keys are sorted by range partitions instead: the partitions' counts
    say in which of them, and at which place, each bucket begins.
    """
    spark = df.sparkSession
    keys = df.select(*key)
    total = keys.count()
    if not total:
        return keys.withColumn("bucket", F.lit(1)).limit(0).select("bucket", *key)
    small, extra = divmod(total, parts)
    starts = [i * small + min(i, extra) for i in range(min(parts, total))]  # ranks, from 0, at which buckets begin
    # A global sort gives rows numbers that rise with the key: partition << 33 | place. One shuffle, written once, so that what is
    # counted and what is numbered are the same partitions even after an executor is lost.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    ordered = keys.orderBy(*key).withColumn("_number", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_number", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).agg(F.count("*")).collect()}  # a row for each partition
    at, numbers = 0, {}  # row number of each start
    for p in sorted(sizes):
        while len(numbers) < len(starts) and starts[len(numbers)] < at + sizes[p]:
            i = len(numbers)
            numbers[i + 1] = (p << 33) + starts[i] - at
        at += sizes[p]
    wanted = spark.createDataFrame([(b, n) for b, n in numbers.items()], "bucket int, _wanted long")  # ``parts`` rows
    return ordered.join(F.broadcast(wanted), F.col("_number") == F.col("_wanted")).select("bucket", *key)


def boundary_ranges(boundaries: Sequence[Any]) -> list[tuple[Any, Any]]:
    """Open-ended ranges from first keys b0..bn-1: (-, b1], (b1, b2], ... (bn-1, +). Fewer than two boundaries: one range."""
    if len(boundaries) < 2:
        return [(None, None)]
    inner = list(boundaries[1:])
    return list(zip([None, *inner], [*inner, None]))


def boundary_text(values: Sequence[Any]) -> str:
    """Key values as JSON for a checkpoint; moments, decimals and bytes carry a mark, so that they come back as they were."""

    def marked(v: Any) -> Any:
        if isinstance(v, datetime):
            return {"moment": v.isoformat()}
        if isinstance(v, Decimal):
            return {"decimal": str(v)}
        return {"bytes": v.hex()} if isinstance(v, (bytes, bytearray)) else v

    return json.dumps([marked(v) for v in values])


def boundary_values(text: str) -> list[Any]:
    """What boundary_text() wrote."""
    back = {"moment": datetime.fromisoformat, "decimal": Decimal, "bytes": bytes.fromhex}
    return [back[next(iter(v))](next(iter(v.values()))) if isinstance(v, dict) else v for v in json.loads(text)]


@dataclass(frozen=True)
class Route:
    kind: str  # KEYSET_NUMERIC, KEYSET_COMPOSITE or STREAMING_FALLBACK
    parallelism: int


def load_route(schema: T.StructType, key: Sequence[str], workers: int) -> Route:
    """How a full load divides a table: by number ranges of a single integral key, by sampled key ranges, or not at all."""
    if not key:
        return Route("STREAMING_FALLBACK", 1)
    wide = max(1, min(workers, MAX_PARALLEL))
    kind = schema[key[0]].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 18
    return Route("KEYSET_NUMERIC" if len(key) == 1 and whole else "KEYSET_COMPOSITE", wide)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> tuple[DataFrame, bool]:
    """Rows for display and whether there are more: long text cut, binary values named by their size."""
    shown = [preview_binary(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else preview_text(F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema]
    head = df.limit(rows + 1)
    return head.limit(rows).select(*shown), head.count() > rows


def row_count_pair(source: DataFrame, target: DataFrame | None, table: str) -> DataFrame:
    """(table_name, source_rows, target_rows, status) with MISSING_TABLE where there is no target."""
    one = source.agg(F.count("*").alias("source_rows"))
    two = target.agg(F.count("*").alias("target_rows")) if target is not None else source.sparkSession.range(1).select(F.lit(None).cast("long").alias("target_rows"))
    status = F.when(F.col("target_rows").isNull(), "MISSING_TABLE").otherwise("OK")
    return one.crossJoin(two).select(F.lit(table).alias("table_name"), "source_rows", "target_rows", status.alias("status"))  # one row each


def counted_pair(spark: SparkSession, source: Callable[[], DataFrame], target: Callable[[], DataFrame], table: str, seconds: float = 60.0) -> tuple[str, int | None, int | None, str]:
    """(table, source rows, target rows, status) of two tables that may fail: OK, MISSING_TABLE, ERROR, or TIMEOUT for a count that is cancelled after so long."""
    context = spark.sparkContext

    def count(make: Callable[[], DataFrame]) -> tuple[int | None, str]:
        tag = f"count-{uuid.uuid4().hex}"
        late = threading.Event()

        def cancel() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, cancel)
        timer.daemon = True
        timer.start()
        context.addJobTag(tag)
        try:
            return make().count(), "OK"
        except Exception as e:
            if late.is_set():
                return None, "TIMEOUT"
            return None, "MISSING_TABLE" if re.search(r"TABLE_OR_VIEW_NOT_FOUND|PATH_NOT_FOUND", str(e)) else "ERROR"
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    (a, x), (b, y) = count(source), count(target)
    return table, a, b, next((s for s in ("ERROR", "TIMEOUT", "MISSING_TABLE") if s in (x, y)), "OK")
