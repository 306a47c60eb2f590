"""Comparing table structures as DataFrames of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEC = "table_name string, column_name string, ordinal int, type_name string, size int, digits int, nullable boolean, default_value string, auto_increment boolean, family int"

# Order in which kinds of changes are applied.
PRIORITY = {"TABLE": 10, "COLUMN": 20, "INDEX": 30, "VIEW": 40, "PROCEDURE": 50, "FUNCTION": 50, "DATA": 60}


def family(kind: T.DataType) -> int:
    """Text 1, numeric 2, temporal 3, binary 4, boolean 5, others 100 and more."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return 1
    if isinstance(kind, T.NumericType):
        return 2
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return 3
    if isinstance(kind, T.BinaryType):
        return 4
    return 5 if isinstance(kind, T.BooleanType) else 100


def spec_of(spark: SparkSession, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """A row for each column of each table. Field metadata may hold typeName, size, digits, default and autoIncrement."""
    rows = []
    for table, schema in schemas.items():
        for i, f in enumerate(schema):
            m, k = f.metadata or {}, f.dataType
            size = m.get("size", k.precision if isinstance(k, T.DecimalType) else None)
            digits = m.get("digits", k.scale if isinstance(k, T.DecimalType) else None)
            rows.append((table, f.name, i, m.get("typeName", k.typeName()), size, digits, f.nullable, m.get("default"), bool(m.get("autoIncrement", False)), family(k)))
    return spark.createDataFrame(rows, SPEC)


def signature(alias: str | None = None) -> Column:
    """Name, type and properties of a column as one text, names and types in upper case."""
    c = lambda n: F.col(f"{alias}.{n}" if alias else n)
    parts = [F.upper(c("column_name")), F.upper(c("type_name")), c("size"), c("digits"), c("nullable"), c("default_value"), c("auto_increment")]
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def changes(before: DataFrame, after: DataFrame, unreadable: Sequence[str] = (), complete: bool = True) -> DataFrame:
    """(object_type, change_type, table_name, column_name, priority) from one snapshot to the next.

    Tables and columns pair by upper-cased name. Drops aren't inferred for unreadable tables, nor at all from a listing that is
    empty or not known to be complete: what wasn't read isn't gone.
    """
    spared = [u.upper() for u in unreadable]
    key = lambda n: F.upper(n)
    tables = lambda df: df.select(key("table_name").alias("t"), "table_name").groupBy("t").agg(F.first("table_name").alias("table_name"))
    may_drop = F.lit(complete and not after.isEmpty())
    spare = F.col("t").isin(spared) if spared else F.lit(False)
    b, a = tables(before).withColumnRenamed("table_name", "was"), tables(after).withColumnRenamed("table_name", "now")
    both = b.join(a, "t", "full_outer")
    whole = both.where(F.col("was").isNull() | (F.col("now").isNull() & may_drop & ~spare)).select(
        F.lit("TABLE").alias("object_type"), F.when(F.col("was").isNull(), "CREATE").otherwise("DROP").alias("change_type"), F.coalesce("now", "was").alias("table_name"), F.lit(None).cast("string").alias("column_name")
    )
    kept = both.where("was IS NOT NULL AND now IS NOT NULL").select("t")
    columns = lambda df, tag: df.select(key("table_name").alias("t"), key("column_name").alias("c"), F.col("table_name").alias(f"table_{tag}"), F.col("column_name").alias(f"column_{tag}"), signature().alias(f"sig_{tag}"))
    pairs = columns(before, "b").join(kept, "t").join(columns(after, "a").join(kept, "t"), ["t", "c"], "full_outer")
    kind = F.when(F.col("sig_b").isNull(), "CREATE").when(F.col("sig_a").isNull(), "DROP").when(F.col("sig_a") != F.col("sig_b"), "ALTER")
    inner = pairs.withColumn("change_type", kind).where("change_type IS NOT NULL").where(~((F.col("change_type") == "DROP") & (spare | ~F.lit(complete))))
    cols = inner.select(F.lit("COLUMN").alias("object_type"), "change_type", F.coalesce("table_a", "table_b").alias("table_name"), F.coalesce("column_a", "column_b").alias("column_name"))
    priority = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[F.col("object_type")]
    return whole.unionByName(cols).withColumn("priority", priority)


def against_target(source: DataFrame, target: DataFrame) -> DataFrame:
    """(column_name, status) of one table: MISSING in the target, INCOMPATIBLE family, UNFED (not null, no default, not in the source), else OK or EXTRA."""
    s = source.select(F.upper("column_name").alias("c"), F.col("column_name").alias("s_name"), F.col("family").alias("s_family"))
    t = target.select(F.upper("column_name").alias("c"), F.col("column_name").alias("t_name"), F.col("family").alias("t_family"), "nullable", "default_value", "auto_increment")
    status = (
        F.when(F.col("t_name").isNull(), "MISSING")
        .when(F.col("s_name").isNull(), F.when(~F.col("nullable") & F.col("default_value").isNull() & ~F.col("auto_increment"), "UNFED").otherwise("EXTRA"))
        .when(F.col("s_family") != F.col("t_family"), "INCOMPATIBLE")
        .otherwise("OK")
    )
    return s.join(t, "c", "full_outer").select(F.coalesce("s_name", "t_name").alias("column_name"), status.alias("status"))
