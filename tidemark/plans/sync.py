"""One polling cycle of a table: plan, bounded scan, cleansing, merge, audits, cursor."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleanse import Rule, cleanse, cleansed_keys, hashed_columns
from ..operators.audit import content_audit, row_count_audit
from ..operators.capture import Strategy, probe
from ..operators.cursor import Cursor, TableShape, choose_cursor, high_watermark, initial_bound, lagged, window
from ..operators.merge import changed_rows, delete_surplus, last_per_key, repair_missing, upsert
from ..sources.state import StateStore
from ..streaming.cdc import VersionedTable


@dataclass(frozen=True)
class TablePlan:
    name: str
    key: Sequence[str] = ()
    cursor_column: str | None = None
    full_compare: bool = False
    rules: Sequence[Rule] = ()
    deletes: bool = False
    lag_ms: int = 1_000
    #: Rows whose content is compared after a cycle; 0: none.
    content_sample: int = 0


@dataclass
class Cycle:
    """What a cycle did."""

    table: str
    cursor: Cursor
    rows_read: int = 0
    rows_changed: int = 0
    repaired: int | None = 0
    missing: int = 0
    surplus: int = 0
    mismatched: int = 0
    notes: list[str] = field(default_factory=list)


def _moment(value: Any) -> Any:
    """A cursor value as the state document can hold it, and back."""
    if isinstance(value, datetime):
        return {"moment": value.isoformat()}
    return datetime.fromisoformat(value["moment"]) if isinstance(value, dict) else value


def run_cycle(spark: SparkSession, plan: TablePlan, source: DataFrame, target: VersionedTable, state: StateStore) -> Cycle:
    """Bring the target up to date. The watermark is read before the scan, bounds it, and is stored after the write."""
    shape = TableShape(plan.name, source.schema, plan.key, None if not plan.full_compare and plan.cursor_column else source.count())
    cursor = choose_cursor(shape, plan.cursor_column, plan.full_compare)
    out = Cycle(plan.name, cursor)
    mark = f"cursor-{plan.name}"
    held = state.read(mark) or {}
    before = target.current()
    high = high_watermark(source, cursor.column) if cursor.column else None
    bound = initial_bound(cursor.column, high) if cursor.column and high is not None else None
    if before is None:
        scan = source.where(bound) if bound is not None else source
    elif cursor.kind == "NONE" or cursor.kind == "FULL_COMPARE" and not plan.key:
        out.notes.append("loaded once")
        return out
    elif cursor.column and held.get("last") is not None:
        scan = source.where(window(cursor.column, _moment(held["last"]), high, bool(plan.key)))
    else:
        scan = source.where(bound) if bound is not None else source
    rows = cleanse(scan, plan.name, plan.rules)
    out.rows_read = rows.count()
    if before is None:
        target.replace(rows)
        out.rows_changed = out.rows_read
    elif plan.key:
        fresh = changed_rows(before, last_per_key(rows, plan.key, [c for c in rows.columns]), plan.key)
        out.rows_changed = fresh.count()
        after = upsert(before, fresh, plan.key) if out.rows_changed else before
        if plan.deletes and not cleansed_keys(plan.name, plan.key, plan.rules):
            after = delete_surplus(after, source, plan.key)
        if out.rows_changed or plan.deletes:
            target.replace(after)
    else:
        target.replace(before.unionByName(rows))
        out.rows_changed = out.rows_read
    if plan.key and bound is not None:
        audit = row_count_audit(source, target.current(), bound).first()
        out.missing, out.surplus = audit.missing, audit.surplus
        if audit.missing:
            mended, out.repaired = repair_missing(target.current(), cleanse(source, plan.name, plan.rules), plan.key, bound)
            if out.repaired is None:
                state.delete(mark)
                out.notes.append("too many rows are missing: the next cycle loads the table again")
                return out
            target.replace(mended)
    if plan.key and plan.content_sample and not cleansed_keys(plan.name, plan.key, plan.rules):
        held = cleanse(source.where(bound) if bound is not None else source, plan.name, plan.rules)
        seen = content_audit(held, target.current(), plan.key, plan.content_sample, hashed=hashed_columns(plan.name, plan.rules)).first()
        out.mismatched = seen.mismatched
        if seen.mismatched:
            out.notes.append(f"{seen.mismatched} of {seen.sampled} sampled rows differ")
    if cursor.column and high is not None:
        state.write(mark, {"last": _moment(lagged(high, bool(plan.key), plan.lag_ms)), "column": cursor.column, "kind": cursor.kind})
    elif cursor.kind == "FULL_COMPARE":
        state.write(mark, {"last": f"fc:{out.rows_read}", "kind": cursor.kind})
    return out


def precheck(
    pairs: DataFrame, shapes: Sequence[TableShape], configured: dict[str, str], targets: dict[str, T.StructType] | None = None, strategy: Strategy = Strategy.POLLING, source: str = "", settings: dict[str, str] | None = None
) -> list[tuple[str, str, str]]:
    """(code, object, level) of what a project would meet: two sources for one target, tables without a cursor, cursors that miss updates; targets that are
    missing, lack columns or need some that nothing feeds, where ``targets`` are given; and what the source's settings lack for a log strategy, which needs no cursor but a key."""
    from ..operators.objects import mapping_conflicts

    out = [("MAPPING_CONFLICT", r.target, "ERROR") for r in mapping_conflicts(pairs).collect()]
    out += [("CAPTURE", reason, "ERROR") for reason in probe(strategy, source, settings or {})]
    for shape in shapes:
        if targets is not None:
            out += _against(shape, {k.lower(): v for k, v in targets.items()}.get(shape.name.lower()))
        if strategy.follows_log:
            out += [] if shape.key else [("NO_KEY", shape.name, "ERROR")]
            continue
        cursor = choose_cursor(shape, configured.get(shape.name))
        if cursor.kind == "NONE":
            out.append(("NO_CURSOR", shape.name, "WARNING"))
        elif not cursor.sees_updates:
            out.append(("MISSES_UPDATES", shape.name, "WARNING"))
    return out


def _against(shape: TableShape, target: T.StructType | None) -> list[tuple[str, str, str]]:
    if target is None:
        return [("TARGET_MISSING", shape.name, "ERROR")]
    have, need = {f.name.lower() for f in shape.schema}, {f.name.lower() for f in target}
    out = [("COLUMN_SKIPPED", f"{shape.name}.{f.name}", "WARNING") for f in shape.schema if f.name.lower() not in need]
    return out + [("NOT_NULL_UNFED", f"{shape.name}.{f.name}", "WARNING") for f in target if not f.nullable and f.name.lower() not in have]


def chunked_load(spark: SparkSession, source: DataFrame, key: str, ranges: Sequence[tuple[Any, Any]], folder: str, state: StateStore, name: str, workers: int = 4) -> int:
    """A load in ranges that can be resumed, ``workers`` of them at once: each range is written as a folder of its own and noted when it is complete, a range that
    was cut short is written anew. Gives the ranges that were still open. The first failure is raised when the ranges that run have ended."""
    done = set((state.read(f"chunks-{name}") or {}).get("done", []))
    open_ranges = [(i, r) for i, r in enumerate(ranges) if i not in done]
    noting = threading.Lock()

    def load(i: int, low: Any, high: Any) -> None:
        part = source
        if low is not None:
            part = part.where(F.col(key) > F.lit(low))
        if high is not None:
            part = part.where(F.col(key) <= F.lit(high))
        part.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/range={i}")
        with noting:
            done.add(i)
            state.write(f"chunks-{name}", {"done": sorted(done)})

    with ThreadPoolExecutor(max(1, workers)) as pool:
        for running in [pool.submit(load, i, low, high) for i, (low, high) in open_ranges]:
            running.result()
    return len(open_ranges)
