"""Vendor column types in Spark's, and DDL for Spark tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import types as T

# Vendor type names, without what stands in parentheses.
_TEXT = "CHAR CHARACTER VARCHAR VARCHAR2 NCHAR NVARCHAR NVARCHAR2 LONGVARCHAR BPCHAR TEXT TINYTEXT MEDIUMTEXT LONGTEXT NTEXT CLOB NCLOB LONG ENUM SET UNIQUEIDENTIFIER UUID ROWID UROWID XML XMLTYPE SQL_VARIANT JSON JSONB INTERVAL STRING INET CIDR NAME CITEXT SHORTTEXT ALPHANUM".split()
_WHOLE = {"TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT2": T.ShortType(), "SMALLSERIAL": T.ShortType(), "YEAR": T.ShortType(), "MEDIUMINT": T.IntegerType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT4": T.IntegerType(), "SERIAL": T.IntegerType(), "BIGINT": T.LongType(), "INT8": T.LongType(), "BIGSERIAL": T.LongType()}
_WIDER = {"TINYINT": T.ShortType(), "SMALLINT": T.IntegerType(), "MEDIUMINT": T.IntegerType(), "INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.DecimalType(20, 0)}
_REAL = {"REAL": T.FloatType(), "FLOAT4": T.FloatType(), "BINARY_FLOAT": T.FloatType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT8": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "BINARY_DOUBLE": T.DoubleType()}
_DECIMAL = {"NUMERIC": (38, 10), "DECIMAL": (38, 10), "NUMBER": (38, 10), "DEC": (38, 10), "DECFLOAT": (38, 10), "SMALLDECIMAL": (38, 10), "MONEY": (19, 4), "SMALLMONEY": (10, 4)}
_ZONED = {"TIMESTAMPTZ", "DATETIMEOFFSET", "TIMESTAMP WITH TIME ZONE"}
_MOMENT = {"TIMESTAMP", "DATETIME", "DATETIME2", "SMALLDATETIME", "SECONDDATE", "LONGDATE", "TIMESTAMPLTZ", "TIMESTAMP WITH LOCAL TIME ZONE", "TIMESTAMP WITHOUT TIME ZONE"}
_BINARY = "BINARY VARBINARY LONGVARBINARY RAW BLOB TINYBLOB MEDIUMBLOB LONGBLOB BYTEA IMAGE GEOMETRY GEOGRAPHY BFILE ROWVERSION".split()


def spark_type(vendor: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """Spark's type for a vendor type such as ``NUMBER(12,2)``, ``INT UNSIGNED`` or ``TIMESTAMP(6) WITH TIME ZONE``.

    Unknown names are binary if they look so, else text.
    """
    digits = re.search(r"\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\)", vendor)
    if digits:
        precision, scale = int(digits[1]), int(digits[2]) if digits[2] else scale
    name = " ".join(re.sub(r"\([^)]*\)", " ", vendor).upper().split())
    unsigned = "UNSIGNED" in name
    name = " ".join(w for w in name.split() if w not in ("UNSIGNED", "ZEROFILL", "IDENTITY"))
    if name in _WHOLE:
        return _WIDER.get(name, _WHOLE[name]) if unsigned else _WHOLE[name]
    if name in ("BOOLEAN", "BOOL"):
        return T.BooleanType()
    if name in ("BIT", "VARBIT", "BIT VARYING"):
        n = precision or 1
        return T.BooleanType() if n == 1 else T.ShortType() if n <= 8 else T.IntegerType() if n <= 16 else T.LongType() if n <= 63 else T.DecimalType(20, 0)
    if name in _REAL:
        return _REAL[name]
    if name in _DECIMAL:
        p, s = _DECIMAL[name]
        if precision:
            p, s = min(precision, 38), scale or 0
        return T.DecimalType(max(p, s) if s <= 38 else 38, max(0, min(s, 38)))
    if name in _TEXT or name.startswith("INTERVAL"):
        return T.StringType()
    if name == "DATE":
        return T.DateType()
    if name.startswith("TIME") and not name.startswith("TIMESTAMP"):
        return T.StringType()
    if name in _ZONED:
        return T.TimestampType()
    if name in _MOMENT:
        return T.TimestampNTZType()
    if name in _BINARY or re.search(r"BIN|BLOB|BYTE|IMAGE|RAW", name):
        return T.BinaryType()
    return T.StringType()


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def create_table(table: str, schema: T.StructType, comment: str | None = None, source: str = "parquet") -> str:
    """DDL for a Spark table; field metadata may hold remarks."""
    columns = ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}{_comment((f.metadata or {}).get('remarks'))}" for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {source}{_comment(comment)}"


def _comment(text: str | None) -> str:
    escaped = (text or "").replace("\\", "\\\\").replace("'", "\\'")
    return f" COMMENT '{escaped}'" if text else ""


def add_columns(table: str, fields: Sequence[T.StructField]) -> str:
    return f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'{quote(f.name)} {f.dataType.simpleString()}' for f in fields)})"


def drop_table(table: str, allowed: bool) -> str | None:
    return f"DROP TABLE IF EXISTS {table}" if allowed else None


def reseed(dialect: str, table: str, column: str, largest: int) -> str | None:
    """A statement after which generated keys go on behind the largest one that was loaded; None where a dialect needs none."""
    following = largest + 1
    return {
        "mysql": f"ALTER TABLE {table} AUTO_INCREMENT = {following}",
        "postgres": f"SELECT setval(pg_get_serial_sequence('{table}', '{column}'), {largest})",
        "sqlserver": f"DBCC CHECKIDENT ('{table}', RESEED, {largest})",
        "oracle": f"ALTER TABLE {table} MODIFY {column} GENERATED BY DEFAULT AS IDENTITY (START WITH {following})",
        "db2": f"ALTER TABLE {table} ALTER COLUMN {column} RESTART WITH {following}",
        "derby": f"ALTER TABLE {table} ALTER COLUMN {column} RESTART WITH {following}",
    }.get(dialect)


def truncate(table: str) -> str:
    return f"TRUNCATE TABLE {table}"


def default_literal(value: str | None, kind: T.DataType) -> str | None:
    """A column default as a Spark literal; None where the type takes none or the value is an expression of its own dialect."""
    if value is None or isinstance(kind, (T.BinaryType, T.ArrayType, T.MapType)):
        return None
    text = value.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    if re.fullmatch(r"(?i)null", text):
        return "NULL"
    if re.fullmatch(r"(?i)(current_timestamp|now|getdate|sysdate|systimestamp)(\(\d*\))?", text):
        return "current_timestamp()"
    bare = text[1:-1].replace("''", "'") if re.fullmatch(r"'.*'", text, re.S) else text
    if isinstance(kind, T.NumericType):
        return bare if re.fullmatch(r"[+-]?\d+(\.\d+)?", bare) else None
    if isinstance(kind, T.BooleanType):
        return {"1": "true", "0": "false", "TRUE": "true", "FALSE": "false", "B'1'": "true", "B'0'": "false"}.get(bare.upper())
    return "'" + bare.replace("\\", "\\\\").replace("'", "\\'") + "'" if text != bare or re.fullmatch(r"[\w .:-]*", bare) else None


def too_long(names: Sequence[str], most: int) -> list[str]:
    """Identifiers over a target's limit of bytes."""
    return [n for n in names if len(n.encode()) > most]
