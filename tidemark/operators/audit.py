"""Audits of a target against its source."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical
from .merge import _joined
from .scan import sampled_boundaries

SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 50, 2, 200


def row_count_audit(source: DataFrame, target: DataFrame, bound: Column | None = None) -> DataFrame:
    """(source_rows, target_rows, missing, surplus) up to the bound."""
    count = lambda df, name: (df.where(bound) if bound is not None else df).agg(F.count("*").alias(name))
    gap = F.col("source_rows") - F.col("target_rows")
    return count(source, "source_rows").crossJoin(count(target, "target_rows")).select("source_rows", "target_rows", F.greatest(gap, F.lit(0)).alias("missing"), F.greatest(-gap, F.lit(0)).alias("surplus"))


def comparable(schema: T.StructType, key: Sequence[str], hashed: Iterable[str] = ()) -> list[str]:
    """Columns whose values can be held against each other: no keys, nested values, bytes or hashed columns."""
    left_out = {k.lower() for k in key} | {h.lower() for h in hashed}
    return [f.name for f in schema if f.name.lower() not in left_out and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]


def content_audit(source: DataFrame, target: DataFrame, key: Sequence[str], sample: int = SAMPLE, bound: Column | None = None, hashed: Iterable[str] = ()) -> DataFrame:
    """(sampled, missing, mismatched, and mismatches by column) for the first key of each of ``sample`` buckets of the source.

    A sampled row that the target lacks counts as missing and mismatched; one that the source has lost meanwhile isn't counted.
    """
    rows = source.where(bound) if bound is not None else source
    keys = sampled_boundaries(rows, key, min(max(sample, LEAST_SAMPLE), MOST_SAMPLE)).select(*key)  # MOST_SAMPLE rows at most
    columns = [c for c in comparable(source.schema, key, hashed) if c in target.columns]
    own = lambda df, tag: _joined(df, F.broadcast(keys), key, "left_semi").select(*key, *(canonical(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"{tag}_{c}") for c in columns), F.lit(True).alias(f"{tag}_there"))
    held = own(target, "t").withColumnsRenamed({k: f"t_key_{i}" for i, k in enumerate(key)})
    found = own(rows, "s")
    both = found.join(held, [found[k].eqNullSafe(held[f"t_key_{i}"]) for i, k in enumerate(key)], "left")
    absent = F.col("t_there").isNull()
    wrong = {c: ~absent & ~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")) for c in columns}
    any_wrong = absent
    for w in wrong.values():
        any_wrong = any_wrong | w
    return both.agg(F.count("*").alias("sampled"), F.count_if(absent).alias("missing"), F.count_if(any_wrong).alias("mismatched"), *(F.count_if(w).alias(f"diff_{c}") for c, w in wrong.items()))


def audit_reaction(missing: int, surplus: int) -> str:
    """What an audit leads to: missing rows are copied again, surplus ones are only reported."""
    return "REPAIR" if missing > 0 else "REPORT" if surplus > 0 else "OK"
