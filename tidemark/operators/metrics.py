"""Operational metrics: series, buckets, shares and estimates."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 24
ROWS_PER_SECOND = 1_000
TOP = 10


def _slots(spark, start: Column, end: Column, step: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(start, end, F.expr(f"INTERVAL {step}"))).alias("slot"))


def hourly_series(log: DataFrame, end: Column, when: str = "occurred_at", rows: str = "affected_rows", slots: int = SLOTS) -> DataFrame:
    """(slot, changes, rows) for the last ``slots`` hours up to the one of ``end``, empty hours as zero."""
    last = F.date_trunc("hour", end)
    wanted = _slots(log.sparkSession, last - F.expr(f"INTERVAL {slots - 1} HOURS"), last, "1 HOUR")
    found = log.groupBy(F.date_trunc("hour", F.col(when)).alias("slot")).agg(F.count("*").alias("changes"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows"))
    return wanted.join(found, "slot", "left").select("slot", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def minute_changes(log: DataFrame, when: str = "occurred_at", kind: str = "change_type") -> DataFrame:
    return log.groupBy(F.date_trunc("minute", F.col(when)).alias("minute"), F.col(kind).alias("change_type")).agg(F.count("*").alias("changes"))


def top_objects(log: DataFrame, name: str = "object_name", rows: str = "affected_rows", most: int = TOP) -> DataFrame:
    """The objects with most changed rows; equal ones by name."""
    return log.groupBy(F.col(name).alias("object_name")).agg(F.sum(rows).alias("rows")).orderBy(F.desc("rows"), "object_name").limit(most)


def change_share(log: DataFrame, kind: str = "change_type", rows: str = "affected_rows") -> DataFrame:
    return log.groupBy(F.col(kind).alias("change_type")).agg(F.coalesce(F.sum(rows), F.lit(0)).alias("rows"))


def rows_in_window(log: DataFrame, start: Column, end: Column, project: str = "project", when: str = "occurred_at", rows: str = "affected_rows") -> DataFrame:
    """Changed rows per project in [start, end)."""
    return log.where((F.col(when) >= start) & (F.col(when) < end)).groupBy(project).agg(F.coalesce(F.sum(rows), F.lit(0)).alias("rows"))


def buckets(samples: DataFrame, start: Column, end: Column, step: str, when: str = "ts", value: str = "value") -> DataFrame:
    """(slot, average, total, largest) of each bucket of [start, end): buckets begin at ``start``, and the last one may be cut short.

    A sample on a border belongs to the bucket that begins there; one before ``start``, at ``end`` or after it to none. Nulls are left out, a bucket of
    nulls alone gives null, and an empty one is kept. A span or a step of nothing has no buckets.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
    width = micros(zero + F.expr(f"INTERVAL {step}")) - micros(zero)
    span = micros(end) - micros(start)
    count = F.when((span > 0) & (width > 0), F.ceil(span / width)).otherwise(0).cast("int")
    kind = samples.schema[when].dataType
    numbers = samples.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), count)).alias("number")).where(F.col("number") < count)
    wanted = numbers.select("number", F.timestamp_micros(micros(start) + F.col("number") * width).cast(kind).alias("slot"))
    inside = samples.where((F.col(when) >= start.cast(kind)) & (F.col(when) < end.cast(kind)))
    number = F.floor((micros(F.col(when)) - micros(start)) / width).cast("int")
    found = inside.groupBy(number.alias("number")).agg(F.avg(value).alias("average"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return wanted.join(found, "number", "left").select("slot", "average", "total", "largest")


def uptime(samples: DataFrame, ok: str = "ok") -> DataFrame:
    """Share of good samples in percent; null without samples."""
    return samples.agg((F.count_if(F.col(ok)) * 100 / F.when(F.count("*") > 0, F.count("*"))).alias("uptime"))


def newest(samples: DataFrame, key: str, when: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Per key the newest value, and the newest one that is known."""
    at = F.struct(when, tie) if tie else F.col(when)
    return samples.groupBy(key).agg(F.max_by(value, at).alias("newest"), F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("newest_known"))


def heap_percent(used: Column, most: Column) -> Column:
    return F.when(most > 0, used * 100 / most)


def gauge(value: Column) -> Column:
    """A scraped value: not-a-number while it is unknown."""
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def exposition(samples: DataFrame, name: str, value: str, labels: Sequence[str] = ()) -> DataFrame:
    """(line): samples in the text format that scrapers read; values that aren't known are NaN, and label values are escaped."""
    quoted = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    tags = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), quoted(c), F.lit('"')) for c in labels))
    head = F.concat(F.lit(name + "{"), tags, F.lit("}")) if labels else F.lit(name)
    return samples.select(F.concat(head, F.lit(" "), gauge(F.col(value)).cast("string")).alias("line"))


def throughput(rows: Column, read_ms: Column, write_ms: Column, commit_ms: Column, wall_ms: Column) -> list[Column]:
    """rows_per_second, and the shares of reading, writing and committing in percent."""
    spent = read_ms + write_ms + commit_ms
    share = lambda c, name: F.when(spent > 0, F.round(c * 100 / spent)).otherwise(0).cast("int").alias(name)
    return [F.when(wall_ms > 0, F.floor(rows * 1000 / wall_ms)).otherwise(0).alias("rows_per_second"), share(read_ms, "read_percent"), share(write_ms, "write_percent"), share(commit_ms, "commit_percent")]


def is_heavy(rows: int, interval_ms: int) -> bool:
    """Whether comparing so many rows takes over half of the polling interval."""
    return rows > 0 and interval_ms > 0 and rows / ROWS_PER_SECOND > 0.5 * interval_ms / 1000


def recommended_interval_ms(rows: int) -> int:
    return max(5_000, 2_000 * max(1, ceil(rows / ROWS_PER_SECOND)))


def older_than(df: DataFrame, when: str, days: int, now: Column) -> DataFrame:
    """What retention removes."""
    return df.where(F.col(when) < now - F.expr(f"INTERVAL {days} DAYS"))
