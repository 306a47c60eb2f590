"""Rows as keys and values of a cache."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import plain_number

VALUE_BYTES = 1 << 20


def text_of(c: Column, kind: T.DataType) -> Column:
    """A value's text in keys and hash fields."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.DecimalType):
        return plain_number(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, "1").when(~c, "0")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.cast("string")


def key_of(df: DataFrame, prefix: str, table: str, key: Sequence[str]) -> Column:
    """``prefix:table:k1:k2``; percent signs and colons inside parts are escaped; null where any part is null."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))
    parts = [escaped(text_of(F.col(f"`{k}`"), df.schema[k].dataType)) for k in key]
    lead = [F.lit(p) for p in (prefix, table) if p]
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws(":", *lead, *parts))


def _shown(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    left_out = {e.lower() for e in excluded}
    return [c for c in df.columns if c.lower() not in left_out]


def _json_value(c: Column, kind: T.DataType) -> Column:
    """Decimals as text, so that readers lose no digit; numbers that JSON can't write as null."""
    if isinstance(kind, T.DecimalType):
        return plain_number(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    return c if isinstance(kind, (T.NumericType, T.BooleanType)) else text_of(c, kind)


def as_json(df: DataFrame, prefix: str, table: str, key: Sequence[str], excluded: Iterable[str] = (), most: int = VALUE_BYTES) -> DataFrame:
    """(key, value): rows as JSON with nulls kept. Rows with a null key part, or a value over ``most`` bytes, are left out; see skipped()."""
    fields = [_json_value(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in _shown(df, excluded)]
    out = df.select(key_of(df, prefix, table, key).alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    return out.where(F.col("key").isNotNull() & (F.octet_length("value") <= most))


def as_hash(df: DataFrame, prefix: str, table: str, key: Sequence[str], excluded: Iterable[str] = ()) -> DataFrame:
    """(key, fields, removed): non-null fields to set, and the names of null ones to delete."""
    shown = _shown(df, excluded)
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), text_of(F.col(f"`{c}`"), df.schema[c].dataType).alias("v")) for c in shown))
    return df.select(
        key_of(df, prefix, table, key).alias("key"),
        F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("fields"),
        F.transform(F.filter(pairs, lambda p: p["v"].isNull()), lambda p: p["k"]).alias("removed"),
    ).where(F.col("key").isNotNull())


def skipped(df: DataFrame, prefix: str, table: str, key: Sequence[str], excluded: Iterable[str] = (), most: int = VALUE_BYTES) -> DataFrame:
    """(null_keys, oversized) of rows that as_json() leaves out."""
    fields = [_json_value(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in _shown(df, excluded)]
    k, v = key_of(df, prefix, table, key), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.agg(F.count_if(k.isNull()).alias("null_keys"), F.count_if(k.isNotNull() & (F.octet_length(v) > most)).alias("oversized"))


def commands(folded: DataFrame, prefix: str, table: str, key: Sequence[str], excluded: Iterable[str] = ()) -> DataFrame:
    """(command, key, value) for folded changes: SET with JSON, or DEL."""
    gone = folded.where("op = 1").select(F.lit("DEL").alias("command"), key_of(folded, prefix, table, key).alias("key"), F.lit(None).cast("string").alias("value"))
    kept = as_json(folded.where("op <> 1"), prefix, table, key, {*excluded, "op"}).select(F.lit("SET").alias("command"), "key", "value")
    return kept.unionByName(gone.where("key IS NOT NULL"))


def layout_drift(before: Sequence[str], now: Sequence[str]) -> list[str]:
    """Columns that vanished: hash fields of theirs would stay for ever, so the projection is refused."""
    return [c for c in before if c.lower() not in {n.lower() for n in now}]


def stale_keys(cache: DataFrame, fresh: DataFrame, prefix: str, table: str) -> DataFrame:
    """Keys of a table's prefix that a rebuild doesn't write: to be swept."""
    return cache.where(F.col("key").startswith(f"{prefix}:{table}:")).join(fresh.select("key"), "key", "left_anti")
