"""Choosing, naming and ordering tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(tables: Iterable[str], wanted: Sequence[str], explicit: bool = False) -> list[str]:
    """Tables that a selection names, in any case; an empty selection means all unless it is explicit."""
    names = {w.lower() for w in wanted}
    return [t for t in tables if t.lower() in names] if names or explicit else list(tables)


def mapped(table: str, mapping: dict[str, str]) -> str:
    """The target name of a table; names match in any case."""
    return {k.lower(): v for k, v in mapping.items()}.get(table.lower(), table)


def mapping_conflicts(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Targets, in any case of letters, that more than one source maps to."""
    return pairs.groupBy(F.upper(target).alias("target")).agg(F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("names")).where("sources > 1")


def glob_regex(glob: str) -> str:
    """A pattern for one glob: ``*`` any run, ``?`` any character, everything else itself."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def glob_list(text: str) -> list[str]:
    """Globs separated by commas or line ends."""
    return [g.strip() for g in re.split(r"[,\r\n]", text) if g.strip()]


def matches(name: Column, globs: str) -> Column:
    """Whether a name matches any of the globs."""
    patterns = "|".join(glob_regex(g) for g in glob_list(globs))
    return name.rlike(patterns) if patterns else F.lit(False)


def is_system_index(name: Column) -> Column:
    return name.startswith(".")


@dataclass(frozen=True)
class Item:
    """A table to place; rows None where its size is unknown."""

    name: str
    rows: int | None


def pack(items: Sequence[Item], bins: int) -> list[list[Item]]:
    """Largest first, each into the lightest bin. Empty tables weigh 1, unknown ones the median of the known; ties go by name and by bin number."""
    if not items:
        return []
    known = sorted(i.rows for i in items if i.rows is not None)
    mid = len(known) // 2
    median = max(1, known[mid] if len(known) % 2 else (known[mid - 1] + known[mid]) // 2) if known else 1
    weight = {i: median if i.rows is None else max(1, i.rows) for i in items}
    out: list[list[Item]] = [[] for _ in range(max(1, min(bins, len(items))))]
    totals = [0] * len(out)
    for item in sorted(items, key=lambda i: (-weight[i], i.name)):
        lightest = totals.index(min(totals))
        out[lightest].append(item)
        totals[lightest] += weight[item]
    return out


def plan_rows(packed: Sequence[Sequence[Item]]) -> list[tuple[int, str, int | None]]:
    """(bin, table, rows) of a packing, for a CSV file."""
    return [(b, i.name, i.rows) for b, items in enumerate(packed) for i in items]


def by_dependencies(tables: Sequence[str], foreign_keys: dict[str, Sequence[str]]) -> list[str]:
    """Tables by the number of their foreign keys; equal ones keep their order."""
    return sorted(tables, key=lambda t: len(foreign_keys.get(t, ())))
