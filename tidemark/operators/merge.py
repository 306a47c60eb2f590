"""Set-based merges: upsert, guard against needless writes, delete detection, missing rows, range overwrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import differs

DELETE_COMPARE_ROWS = 20_000
REPAIR_ROWS = 1_000


class MergeRefused(ValueError):
    """A merge that could lose or double rows."""


def _joined(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """A join on typed, null-safe keys: a null key equals a null key and nothing else."""
    a, b = left.alias("l"), right.alias("r")
    on = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in key]
    return a.join(b, on, how)


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys, the last by ``order`` (nulls first), which has to be total. A maximum, combined before the shuffle, so that a hot key brings one row from each task."""
    names = {c: f"_v{i}" for i, c in enumerate(rows.columns)}
    inner = rows.toDF(*names.values())
    known = {c.lower(): n for c, n in names.items()}
    held = [known[k.lower()] for k in key]
    newest = F.max_by(F.struct(*names.values()), F.struct(*(known[o.lower()] for o in order)))
    return inner.groupBy(*held).agg(newest.alias("_row")).select("_row.*").toDF(*rows.columns)


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target after every source row was updated or inserted by key. Keys of ``source`` must be unique, see last_per_key().

    Columns pair in any case of letters. Those that the source lacks become null in its rows; those that the target lacks are dropped.
    """
    named = {c.lower(): c for c in source.columns}
    given = source.select(*(F.col(f"`{named[c.lower()]}`").alias(c) for c in target.columns if c.lower() in named))
    return _joined(target, given, resolve_keys(target.columns, key), "left_anti").unionByName(given, allowMissingColumns=True)


def insert_missing(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert for a table whose columns are all key: rows that are there stay."""
    return target.unionByName(_joined(source.select(*target.columns).distinct(), target, key, "left_anti"))


def changed_rows(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows that an upsert would really write: new ones, and those with any difference outside the key."""
    values = [c for c in source.columns if c in target.columns and c not in key]
    held = target.select(*key, *(F.col(f"`{c}`").alias(f"_was_{c}") for c in values), F.lit(True).alias("_held"))
    both = _joined(source, held, key, "left")
    changed = F.col("_held").isNull()
    for c in values:
        changed = changed | differs(F.col(f"l.`{c}`"), F.col(f"r.`_was_{c}`"))
    return both.where(changed).select("l.*")


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).isEmpty()


def initial_load(target: DataFrame, source: DataFrame, key: Sequence[str], other_unique_index: bool = False) -> DataFrame:
    """First copy: plain append into an empty target, upsert otherwise; refused for rows without a key into a table that has some."""
    if is_empty(target):
        return upsert(target, source, key) if key and other_unique_index else target.unionByName(source.select(*target.columns))
    if not key:
        raise MergeRefused("a table without a key is only loaded while it is empty")
    return upsert(target, source, key)


def require_keys(source: DataFrame, key: Sequence[str]) -> DataFrame:
    """``source``, failing at run time on the first row with a null key."""
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(f"`{k}`").isNull()
    return source.where(F.when(missing, F.raise_error(F.lit("null in an upsert key")).cast("boolean")).otherwise(F.lit(True)))


def resolve_keys(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Columns as they are spelled, for names in any case."""
    known = {c.lower(): c for c in columns}
    absent = [w for w in wanted if w.lower() not in known]
    if absent:
        raise MergeRefused(f"no such key column: {', '.join(absent)}")
    return [known[w.lower()] for w in wanted]


def upsert_by(target: DataFrame, source: DataFrame, wanted: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert by keys that the user names: null keys fail, and of rows with equal keys the last wins."""
    key = resolve_keys(source.columns, wanted)
    return upsert(target, last_per_key(require_keys(source, key), key, order), key)


def surplus_keys(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of the target that the source no longer has."""
    return _joined(target.select(*key), source.select(*key), key, "left_anti")


def delete_surplus(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target without rows that the source no longer has."""
    if not key:
        raise MergeRefused("deletes need a key")
    return _joined(target, source.select(*key), key, "left_semi")


def may_compare_deletes(key: Sequence[str], estimate: int | None, most: int = DELETE_COMPARE_ROWS) -> str | None:
    """Why an in-memory comparison would be refused; None where it may run. Joins have no such bound, but callers can keep the rule."""
    if not key:
        return "no primary key"
    if estimate is None:
        return "row count unknown"
    return f"more than {most} rows" if estimate > most else None


def missing_rows(target: DataFrame, source: DataFrame, key: Sequence[str], bound: Column | None = None) -> DataFrame:
    """Source rows, up to the bound, that the target lacks."""
    return _joined(source.where(bound) if bound is not None else source, target.select(*key), key, "left_anti")


def repair_missing(target: DataFrame, source: DataFrame, key: Sequence[str], bound: Column | None = None, most: int = REPAIR_ROWS) -> tuple[DataFrame, int | None]:
    """The target with missing rows copied again, and their number; None, and the target as it is, where they are more than ``most``.

    The caller then clears the cursor, so that the next cycle loads the table anew.
    """
    absent = missing_rows(target, source, key, bound)
    found = absent.limit(most + 1).count()
    return (target, None) if found > most else (target.unionByName(absent.select(*target.columns)), found)


def range_overwrite(target: DataFrame, source: DataFrame, condition: str) -> DataFrame:
    """Rows that meet the SQL condition give way to the source's. Rows for which it is null stay, as under DELETE."""
    return target.where(~F.coalesce(F.expr(condition), F.lit(False))).unionByName(source.select(*(c for c in target.columns if c in source.columns)), allowMissingColumns=True)


def prune_to(source: DataFrame, target_columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """``source`` without columns that the target lacks, in any case of letters; as it is where a key column is among them, so that the write fails."""
    known = {c.lower() for c in target_columns}
    if any(k.lower() not in known for k in key):
        return source
    return source.select(*(f"`{c}`" for c in source.columns if c.lower() in known))
