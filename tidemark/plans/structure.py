"""Bringing the structure of Spark tables after a schema diff."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..dialect.types import add_columns, create_table, drop_table, quote
from ..etl.runner import replace_table

#: Marks a change that is made by writing the table anew.
REWRITE = "REWRITE"


def statements(changes: Iterable[tuple[str, str, str, str | None]], schemas: Mapping[str, T.StructType], allow_drop: bool = False) -> list[tuple[str, str | None]]:
    """(what, statement) for changes (object, change, table, column) in their order; None where a change is left out: drops that
    aren't allowed, and indexes, which file tables don't have. A change or a drop of a column is a rewrite: the table is read with the column in its
    new type, or without it, and put in its place; text that the new type can't hold makes it fail."""
    out: list[tuple[str, str | None]] = []
    folded = {k.lower(): v for k, v in schemas.items()}
    for kind, change, table, column in changes:
        what = f"{change} {kind} {table}{'.' + column if column else ''}"
        sql = None
        schema = folded.get(table.lower())
        if (kind, change) == ("TABLE", "CREATE") and schema is not None:
            sql = create_table(table, schema)
        elif (kind, change) == ("TABLE", "DROP"):
            sql = drop_table(table, allow_drop)
        elif (kind, change) == ("COLUMN", "CREATE") and schema is not None:
            sql = add_columns(table, [f for f in schema if f.name.lower() == (column or "").lower()])
        elif (kind, change) == ("COLUMN", "ALTER") and schema is not None:
            own = next((f for f in schema if f.name.lower() == (column or "").lower()), None)
            sql = f"{REWRITE} {column} {own.dataType.simpleString()}" if own is not None else None
        elif (kind, change) == ("COLUMN", "DROP") and allow_drop:
            sql = f"{REWRITE} {column}"
        out.append((what, sql))
    return out


def apply(spark: SparkSession, changes: Iterable[tuple[str, str, str, str | None]], schemas: Mapping[str, T.StructType], allow_drop: bool = False) -> list[tuple[str, str]]:
    """Run the statements; (what, APPLIED, SKIPPED or FAILED with its reason). A table that is there already gets the columns that it lacks; one failure doesn't stop the rest."""
    out = []
    for what, sql in statements(changes, schemas, allow_drop):
        if sql is None:
            out.append((what, "SKIPPED"))
            continue
        try:
            table = what.split()[2].split(".")[0]
            if what.startswith("CREATE TABLE") and spark.catalog.tableExists(table):
                held = {c.lower() for c in spark.table(table).columns}
                lacking = [f for f in {k.lower(): v for k, v in schemas.items()}[table.lower()] if f.name.lower() not in held]
                if lacking:
                    spark.sql(add_columns(table, lacking))
            elif sql.startswith(REWRITE):
                column, _, kind = sql.removeprefix(REWRITE).strip().partition(" ")
                held = spark.table(table)
                kept = held.selectExpr(rewritten_columns(held.columns, column, kind)) if kind else held.drop(column)
                replace_table(spark, kept, table)
            else:
                spark.sql(sql)
            out.append((what, "APPLIED"))
        except Exception as e:  # noted, and the others go on
            out.append((what, f"FAILED: {str(e).splitlines()[0]}"))
    return out


def rewritten_columns(columns: Iterable[str], column: str, kind: str) -> list[str]:
    """Expressions that read a table with one column in another type."""
    return [f"CAST({quote(c)} AS {kind}) AS {quote(c)}" if c.lower() == column.lower() else quote(c) for c in columns]
