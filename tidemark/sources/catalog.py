"""Tables of Spark's catalogue and of file folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def describe_all(spark: SparkSession, database: str | None = None) -> dict[str, StructType]:
    prefix = f"{database}." if database else ""
    return {t: spark.table(prefix + t).schema for t in list_tables(spark, database)}


def estimated_rows(spark: SparkSession, table: str) -> int | None:
    """Rows by catalogue statistics; None where the table was never analysed."""
    told = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'").select("data_type").first()
    rows = re.search(r"(\d+) rows", told[0]) if told else None
    return int(rows[1]) if rows else None


def estimated_bytes(spark: SparkSession, table: str) -> int | None:
    """Bytes by catalogue statistics; None where there are none."""
    told = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'").select("data_type").first()
    size = re.search(r"(\d+) bytes", told[0]) if told else None
    return int(size[1]) if size else None


def analyse(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")


def read_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON documents, one a line."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_plan(df: DataFrame, path: str) -> None:
    """A plan as CSV with a header, in one file: plans have a row for each table."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
