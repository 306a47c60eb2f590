"""One text for one value, whatever type or driver it came through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WALL_CLOCK = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"


def plain_number(c: Column) -> Column:
    """A decimal's text without trailing zeros."""
    text = c.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def canonical(c: Column, kind: T.DataType) -> Column:
    """Comparable text of a value: booleans as 1 and 0, numbers without trailing zeros, moments in microseconds, wall-clock text as a moment,
    other text without trailing spaces, bytes as hex. Null stays null."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "1").when(~c, "0")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(plain_number(c.try_cast("decimal(38,10)")), c.cast("string"))
    if isinstance(kind, T.DecimalType):
        return plain_number(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    text = c.cast("string")
    moment = F.when(F.trim(text).rlike(_WALL_CLOCK), F.unix_micros(F.try_to_timestamp(F.translate(F.trim(text), "T", " "))))
    return F.coalesce(moment.cast("string"), F.rtrim(text))


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality."""
    return ~left.eqNullSafe(right)


def any_differs(left: DataFrame, right: DataFrame, columns: list[str], canonically: bool = False) -> Column:
    """Whether any of the columns differs between two joined sides."""
    kinds = {f.name: f.dataType for f in left.schema}, {f.name: f.dataType for f in right.schema}
    own = lambda df, k, c: canonical(df[c], kinds[k][c]) if canonically else df[c]
    return reduce(lambda a, b: a | b, (differs(own(left, 0, c), own(right, 1, c)) for c in columns), F.lit(False))
