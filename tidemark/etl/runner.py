"""ETL tasks: SQL in, a table out, in one of four write modes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect.text import statements
from ..operators.merge import last_per_key, prune_to, range_overwrite, require_keys, resolve_keys, upsert_by
from ..sources.state import Lease, StateStore
from .variables import built_in, definitions, substitute

MODES = ("OVERWRITE", "APPEND", "RANGE_OVERWRITE", "UPSERT")
RESUMABLE = ("APPEND", "RANGE_OVERWRITE")
KEY_LENGTH = 512
#: A column of staged rows: their place in the query's result.
ROW = "__row"


class EtlError(ValueError):
    pass


@dataclass(frozen=True)
class EtlTask:
    name: str
    source_sql: str
    target: str
    mode: str = "OVERWRITE"
    variables: str = ""
    pre_sql: str = ""
    post_sql: str = ""
    range_condition: str = ""
    resume_key: str = ""
    upsert_keys: Sequence[str] = ()
    order: Sequence[str] = ()
    runs: int = 0
    enabled: bool = True


@dataclass
class EtlResult:
    task: str
    status: str  # SUCCESS, FAILED or SKIPPED
    rows: int = 0
    dropped_columns: list[str] = field(default_factory=list)
    error: str | None = None


def validate(task: EtlTask) -> None:
    if task.mode not in MODES:
        raise EtlError(f"unknown write mode {task.mode}")
    if task.mode == "RANGE_OVERWRITE" and not task.range_condition.strip():
        raise EtlError("a range overwrite needs a condition")
    if task.mode == "UPSERT" and not task.upsert_keys:
        raise EtlError("an upsert needs keys")
    if task.resume_key and task.mode not in RESUMABLE:
        raise EtlError(f"{task.mode} can't resume")


def resolved(task: EtlTask, now: datetime) -> EtlTask:
    """The task with its variables replaced. A condition that the mode doesn't use isn't looked at."""
    values = built_in(now, task.name, task.target, task.runs) | definitions(task.variables)
    put = lambda sql: substitute(sql, values) or ""
    condition = put(task.range_condition) if task.mode == "RANGE_OVERWRITE" else task.range_condition
    return replace(task, source_sql=put(task.source_sql), pre_sql=put(task.pre_sql), post_sql=put(task.post_sql), range_condition=condition)


def run_script(spark: SparkSession, script: str, dialect: str = "spark") -> None:
    for statement in statements(script, dialect):
        spark.sql(statement)


def source_of(spark: SparkSession, script: str) -> DataFrame:
    """The rows of a script's last statement; the ones before it are run."""
    found = statements(script)
    if not found:
        raise EtlError("no statement")
    for statement in found[:-1]:
        spark.sql(statement)
    df = spark.sql(found[-1])
    if not df.columns:
        raise EtlError("the last statement returns no rows")
    return df


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of a resume key that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def resume_problem(df: DataFrame, key: str) -> str | None:
    """Why a column can't be resumed by: a null, repeated or over-long value. One pass, and one row for each value that repeats."""
    row = df.agg(F.count_if(F.col(key).isNull()).alias("nulls"), F.count_if(F.length(F.col(key).cast("string")) > KEY_LENGTH).alias("long")).first()
    if row.nulls:
        return "null"
    if row.long:
        return "too long"
    return None if duplicate_keys(df, key).isEmpty() else "repeated"


def boundary_is_unique(df: DataFrame, key: str, last: Any) -> bool:
    """Whether the value that a resumed run starts after occurs once at most: otherwise rows of equal keys could be lost."""
    return df.where(F.col(key) == F.lit(last)).limit(2).count() <= 1


def resumed(df: DataFrame, key: str, last: Any) -> DataFrame:
    """Rows beyond the last value that was committed."""
    return df if last is None else df.where(F.col(key) > F.lit(last))


def combined(task: EtlTask, target: DataFrame | None, source: DataFrame) -> DataFrame:
    """The target's rows after the write. Without a target the source is all of it."""
    if target is None or task.mode == "OVERWRITE":
        return require_keys(source, resolve_keys(source.columns, task.upsert_keys)) if task.mode == "UPSERT" and target is None and task.upsert_keys else source
    if task.mode == "APPEND":
        return target.unionByName(source, allowMissingColumns=True)
    if task.mode == "RANGE_OVERWRITE":
        return range_overwrite(target, source, task.range_condition)
    return upsert_by(target, source, task.upsert_keys, task.order or source.columns)


def recover(spark: SparkSession, table: str) -> None:
    """Finish, or take back, a replacement that a crash left half done; nothing to do otherwise."""
    draft, old = f"{table}__next", f"{table}__old"
    if not spark.catalog.tableExists(old):
        return
    if not spark.catalog.tableExists(table):
        # the old table steps aside only when the draft is complete
        spark.sql(f"ALTER TABLE {draft if spark.catalog.tableExists(draft) else old} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def replace_table(spark: SparkSession, df: DataFrame, table: str) -> None:
    """Write a table that the rows themselves are read from: first beside it, then in its place. At any moment one of the two is there, whole; see recover()."""
    draft, old = f"{table}__next", f"{table}__old"
    spark.sql(f"DROP TABLE IF EXISTS {draft}")
    df.write.saveAsTable(draft)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {draft} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def run(spark: SparkSession, task: EtlTask, now: datetime, state: StateStore | None = None, lease: Lease | None = None) -> EtlResult:
    """Run a task against Spark's catalogue: variables, leading SQL, query, pruning, write, trailing SQL, checkpoint.

    The query's rows are read once for the write; their number and the last resume key are taken on the way, from the rows that were written. A resumed
    run adds rows and deletes none, as the first run deleted what its rows replace. Without an order the last of the query's rows with a key wins.
    Under a lease, nothing is written once another holder has it.
    """
    validate(task)
    task = resolved(task, now)
    mark = f"etl-{task.name}"
    last = (state.read(mark) or {}).get("last") if state and task.resume_key else None
    recover(spark, task.target)
    if last is None and task.pre_sql:
        run_script(spark, task.pre_sql)
    source = source_of(spark, task.source_sql)
    if task.resume_key:
        if problem := resume_problem(source, task.resume_key):
            raise EtlError(f"resume key {task.resume_key}: {problem}")
        if last is not None and not boundary_is_unique(source, task.resume_key, last):
            raise EtlError(f"resume key {task.resume_key}: {last} occurs more than once")
        source = resumed(source, task.resume_key, last)
    there = spark.catalog.tableExists(task.target)
    target = spark.table(task.target) if there else None
    columns = prune_to(source, target.columns, task.upsert_keys).columns if there else source.columns
    if not columns:
        raise EtlError("the target has none of the columns")
    if lease is not None:
        lease.require()
    last_read = None
    if task.mode == "UPSERT":  # its rows are looked at twice, against the target and to be written: staged
        staged = f"{task.target}__rows"
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        extra = [c for c in task.order if c.lower() not in {k.lower() for k in columns}]
        source.select(*(F.col(f"`{c}`") for c in [*columns, *extra]), F.monotonically_increasing_id().alias(ROW)).write.saveAsTable(staged)
        given, order = spark.table(staged), task.order or [ROW]
        rows = given.count()
        if there:
            merged = upsert_by(target, given, task.upsert_keys, order)
        else:
            keys = resolve_keys(columns, task.upsert_keys)
            merged = last_per_key(require_keys(given, keys), keys, order).select(*columns)
        replace_table(spark, merged, task.target)
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
    else:
        read = Observation(f"etl {task.name}")
        key = F.max(task.resume_key).cast("string") if task.resume_key else F.lit(None).cast("string")
        kept = source.observe(read, F.count(F.lit(1)).alias("rows"), key.alias("last")).select(*(F.col(f"`{c}`") for c in columns))
        if there and (task.mode == "APPEND" or last is not None):
            target.limit(0).unionByName(kept, allowMissingColumns=True).write.mode("append").insertInto(task.target)
        else:
            replace_table(spark, combined(task, target, kept), task.target)
        rows, last_read = read.get["rows"], read.get["last"]
    if state and task.resume_key and rows:
        if lease is not None:
            lease.require()
        state.write(mark, {"last": _typed(last_read, source.schema[task.resume_key].dataType)})
    if task.post_sql:
        run_script(spark, task.post_sql)
    return EtlResult(task.name, "SUCCESS", rows, [c for c in source.columns if c not in columns])


def _typed(text: str, kind: T.DataType) -> Any:
    """A key as the state document holds it: whole numbers as numbers, all else as text that compares with the column."""
    return int(text) if isinstance(kind, T.IntegralType) else text


def run_batch(tasks: Iterable[tuple[int, EtlTask]], execute: Callable[[EtlTask], EtlResult], running: Iterable[str] = ()) -> list[EtlResult]:
    """Tasks in the order of their ids: one that is running is skipped, and one that fails doesn't stop the others."""
    busy, out = set(running), []
    for _, task in sorted(tasks, key=lambda t: t[0]):
        if task.name in busy or not task.enabled:
            out.append(EtlResult(task.name, "SKIPPED"))
            continue
        try:
            out.append(execute(task))
        except Exception as e:  # the result tells, and the batch goes on
            out.append(EtlResult(task.name, "FAILED", error=str(e)))
    return out


def precheck(spark: SparkSession, task: EtlTask, now: datetime) -> list[tuple[str, str, str]]:
    """(code, object, level) of what a run would meet; nothing is read but schemas."""
    out: list[tuple[str, str, str]] = []
    try:
        validate(task)
        task = resolved(task, now)
        columns = spark.sql(statements(task.source_sql)[-1]).schema
    except Exception as e:
        return [("SOURCE", str(e).splitlines()[0], "ERROR")]
    names = {f.name.lower() for f in columns}
    out += [("UPSERT_KEY_NOT_IN_RESULT", k, "ERROR") for k in task.upsert_keys if k.lower() not in names]
    if not spark.catalog.tableExists(task.target):
        return [*out, ("TARGET_WILL_BE_CREATED", task.target, "INFO")]
    held = spark.table(task.target).schema
    target = {f.name.lower() for f in held}
    out += [("UPSERT_KEY_NOT_IN_TARGET", k, "ERROR") for k in task.upsert_keys if k.lower() not in target]
    extra = [f.name for f in columns if f.name.lower() not in target]
    out += [("COLUMN_SKIPPED", c, "WARNING") for c in extra] if len(extra) < len(columns) else [("NO_COLUMN_IN_TARGET", task.target, "ERROR")]
    out += [("NOT_NULL_UNFED", f.name, "WARNING") for f in held if not f.nullable and f.name.lower() not in names]
    if task.mode == "RANGE_OVERWRITE":
        try:
            spark.table(task.target).where(task.range_condition).schema
        except Exception as e:
            out.append(("RANGE_CONDITION", str(e).splitlines()[0], "ERROR"))
    return out
