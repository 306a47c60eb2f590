"""Cursors of incremental loads: which column to follow, windows, watermarks and lags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of names that mark columns of last change, and of creation.
CHANGED_HINTS = (
    "UPDATE_TIME", "UPDATED_AT", "UPDATETIME", "UPDATED_TIME", "LAST_MODIFIED", "LASTMODIFIED", "LAST_UPDATE", "LAST_UPDATED",
    "MODIFY_TIME", "MODIFIED_AT", "MODIFIED_TIME", "GMT_MODIFIED", "ROW_VERSION", "ROWVERSION", "SYS_UPDATE_TIME", "DATA_CHANGE_TIME",
)
CREATED_HINTS = ("CREATE_TIME", "CREATED_AT", "CREATETIME", "CREATED_TIME", "GMT_CREATE", "INSERT_TIME", "ADD_TIME")

FULL_COMPARE_ROWS = 20_000
SAFETY_LAG_MS = 1_000


@dataclass(frozen=True)
class Cursor:
    """kind: TIMESTAMP, IDENTITY, ROW_SCN, FULL_COMPARE or NONE."""

    kind: str
    column: str | None = None
    why: str = ""

    @property
    def sees_updates(self) -> bool:
        return self.kind in ("TIMESTAMP", "ROW_SCN", "FULL_COMPARE")

    @property
    def is_pseudo(self) -> bool:
        return self.kind == "ROW_SCN"


@dataclass(frozen=True)
class TableShape:
    """What a cursor is chosen from."""

    name: str
    schema: T.StructType
    key: Sequence[str] = ()
    rows: int | None = None
    row_level_scn: bool = False
    row_versions: frozenset[str] = field(default_factory=frozenset)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(kind, T.DecimalType) and kind.scale == 0


def _hinted(shape: TableShape, hints: Sequence[str]) -> str | None:
    for hint in hints:
        for f in shape.schema:
            if hint in f.name.upper().replace("-", "_") and (is_temporal(f.dataType) or f.name in shape.row_versions):
                return f.name
    return None


def choose_cursor(shape: TableShape, configured: str | None = None, full_compare: bool = False, most: int = FULL_COMPARE_ROWS) -> Cursor:
    """The first that fits: the user's column, a column of last change, the row SCN, a column of creation, a single integral key, comparing all of a small table."""
    if full_compare:
        return Cursor("FULL_COMPARE", why="chosen by the user")
    if configured and configured.strip():
        known = {f.name.lower(): f for f in shape.schema}
        f = known.get(configured.strip().lower())
        if f is not None and (is_temporal(f.dataType) or f.name in shape.row_versions):
            return Cursor("TIMESTAMP", f.name, "configured")
        if f is not None and is_integral(f.dataType):
            return Cursor("IDENTITY", f.name, "configured; inserts only")
    if name := _hinted(shape, CHANGED_HINTS):
        return Cursor("TIMESTAMP", name, "column of last change")
    if shape.row_level_scn:
        return Cursor("ROW_SCN", "ORA_ROWSCN", "row-level change number")
    if name := _hinted(shape, CREATED_HINTS):
        return Cursor("IDENTITY", name, "column of creation; inserts only")
    if len(shape.key) == 1 and is_integral(shape.schema[shape.key[0]].dataType):
        return Cursor("IDENTITY", shape.key[0], "integral key; inserts only")
    if shape.rows is not None and shape.rows <= most:
        return Cursor("FULL_COMPARE", why=f"{shape.rows} rows")
    return Cursor("NONE", why="no usable column, and too many rows to compare")


def window(column: str, last: Any, high: Any, keyed: bool, pseudo: bool = False) -> Column:
    """(last, high], and for keyed tables rows without a cursor value too: they come again each cycle, harmless to an upsert."""
    inside = (F.col(column) > F.lit(last)) & (F.col(column) <= F.lit(high))
    return inside | F.col(column).isNull() if keyed and not pseudo else inside


def initial_bound(column: str, high: Any) -> Column:
    return (F.col(column) <= F.lit(high)) | F.col(column).isNull()


def high_watermark(df: DataFrame, column: str) -> Any:
    """The largest cursor value now; read before the scan that it bounds."""
    return df.agg(F.max(column)).first()[0]


def lagged(high: Any, keyed: bool, lag_ms: int = SAFETY_LAG_MS) -> Any:
    """What to store as the cursor: moments of keyed tables step back, so that late commits are read again. Others stay as they are."""
    if not keyed:
        return high
    if isinstance(high, datetime):
        return high - timedelta(milliseconds=lag_ms)
    if isinstance(high, str):
        try:
            return str(datetime.fromisoformat(high.strip()) - timedelta(milliseconds=lag_ms))
        except ValueError:
            return high
    return high


def null_cursor_rows(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("null_rows"))


def truncated_to_scale(moment: datetime, digits: int) -> datetime:
    """A bound cut to the fraction digits that the other side keeps; otherwise its rows would look missing."""
    step = 10 ** max(0, 6 - digits)
    return moment.replace(microsecond=moment.microsecond // step * step)
