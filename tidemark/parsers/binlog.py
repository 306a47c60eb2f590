"""Row events of a binary log, and a mined redo log, as changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fold import AFTER, DELETE, INSERT, binlog_key

#: Events as a JSON source brings them; rows hold the images of each changed row.
EVENTS = "file string, position long, kind string, table_id long, table_name string, sql string, rows array<struct<before:map<string,string>,after:map<string,string>>>"
_OPS = {"WRITE_ROWS": INSERT, "UPDATE_ROWS": AFTER, "DELETE_ROWS": DELETE}


def row_changes(events: DataFrame) -> DataFrame:
    """(file, position, row, table_name, op, key_image, image) for every row of every row event, in any order.

    A row event names its table by a number that the last table map before it explains; one whose number nothing explains has a null table_name. Of an update,
    key_image is the row before; of a delete, image is the row that went. Other events give nothing.
    """
    at = binlog_key(F.col("file"), F.col("position"))
    before = Window.partitionBy("table_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = events.where("kind IN ('TABLE_MAP', 'WRITE_ROWS', 'UPDATE_ROWS', 'DELETE_ROWS')").withColumn("at", at)
    named = named.withColumn("named", F.last(F.when(F.col("kind") == "TABLE_MAP", F.col("table_name")), ignorenulls=True).over(before))
    op = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in _OPS.items()))
    each = named.where("kind <> 'TABLE_MAP'").select("file", "position", "named", op.alias("op"), F.posexplode("rows").alias("row", "r"))
    image = F.when(F.col("op") == DELETE, F.col("r.before")).otherwise(F.col("r.after"))
    return each.select("file", "position", "row", F.col("named").alias("table_name"), "op", F.coalesce("r.before", "r.after").alias("key_image"), image.alias("image"))


def structure_changes(events: DataFrame) -> DataFrame:
    """(file, position, sql) of the statements in the log that change tables or indexes."""
    return events.where("kind = 'QUERY'").where(F.col("sql").rlike(r"(?is)^\s*(/\*.*?\*/\s*)*(create|alter|drop|truncate|rename)\s+(unique\s+|temporary\s+)*(table|index|view)\b")).select("file", "position", "sql")


#: Rows of a mined redo log: operations 1 insert, 2 delete, 3 update, 5 structure.
MINED = "scn long, commit_scn long, rs_id long, container int, table_name string, operation int, sql string"


def drained(mined: DataFrame, tables: Sequence[str], container: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, tasks) of the wanted tables, and of one container where it is given.

    changes has (transaction, place, table_name, operation, sql): a transaction is what shares a commit number, and place is the order inside it. tasks has
    (commit_scn, table_name, sql): structure changes, which go to a list of tasks and not to the target. Rows that were never committed have neither.
    """
    wanted = mined.where(F.lower("table_name").isin([t.lower() for t in tables]) & F.col("commit_scn").isNotNull())
    if container is not None:
        wanted = wanted.where(F.col("container") == container)
    inside = Window.partitionBy("commit_scn").orderBy("scn", "rs_id")
    rows = wanted.where(F.col("operation").isin(1, 2, 3))
    changes = rows.select(F.col("commit_scn").alias("transaction"), F.row_number().over(inside).alias("place"), "table_name", "operation", "sql")
    return changes, wanted.where("operation = 5").select("commit_scn", "table_name", "sql")
