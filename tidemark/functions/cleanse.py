"""Column cleansing: ordered rules on string columns, as column expressions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

log = logging.getLogger(__name__)

# The characters that count as white space; no-break spaces don't.
WHITE = r"[\u0009-\u000D\u001C-\u0020\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"


@dataclass(frozen=True)
class Rule:
    """One rule: table and column match in any case; ``arg`` is a prefix, suffix, pattern or salt."""

    table: str
    column: str
    kind: str
    arg: str | None = None
    replacement: str = ""


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(strip(c)) > 0, c)


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def mask_between(c: Column, head: int, tail: int) -> Column:
    """Stars for all but the first and last characters; for everything where no character would be hidden."""
    n = F.length(c)
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(head)), F.repeat(F.lit("*"), n - head - tail), F.right(c, F.lit(tail))))


def mask_bank_card(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(4))))


def mask_name(c: Column) -> Column:
    n = F.length(c)
    return F.when(n == 0, c).when(n == 1, F.lit("*")).otherwise(F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("*"), n - 1)))


def mask_email(c: Column) -> Column:
    at = F.locate("@", c)
    return F.when(at <= 1, mask_name(c)).otherwise(F.concat(F.left(c, F.lit(1)), F.lit("***"), F.substring(c, at, F.length(c))))


def hash_sha256(c: Column, salt: str | None = None) -> Column:
    """Lower-case hex of the value in UTF-8, after ``salt:`` where there is a salt."""
    lead = (salt or "").strip()
    return F.sha2((F.concat(F.lit(lead + ":"), c) if lead else c).cast("binary"), 256)


def _regex(c: Column, r: Rule) -> Column:
    return F.regexp_replace(c, r.arg or "", r.replacement)


#: Kind -> expression. Kinds in NEEDS_ARG are skipped without an argument.
KINDS: dict[str, Callable[[Column, Rule], Column]] = {
    "TRIM": lambda c, r: strip(c),
    "UPPER": lambda c, r: F.upper(c),
    "LOWER": lambda c, r: F.lower(c),
    "BLANK_TO_NULL": lambda c, r: blank_to_null(c),
    "STRIP_PREFIX": lambda c, r: strip_prefix(c, r.arg or ""),
    "STRIP_SUFFIX": lambda c, r: strip_suffix(c, r.arg or ""),
    "REGEX_REPLACE": _regex,
    "MASK_PHONE": lambda c, r: mask_between(c, 3, 4),
    "MASK_ID_CARD": lambda c, r: mask_between(c, 6, 4),
    "MASK_BANK_CARD": lambda c, r: mask_bank_card(c),
    "MASK_NAME": lambda c, r: mask_name(c),
    "MASK_EMAIL": lambda c, r: mask_email(c),
    "HASH_SHA256": lambda c, r: hash_sha256(c, r.arg),
}
NEEDS_ARG = frozenset({"STRIP_PREFIX", "STRIP_SUFFIX", "REGEX_REPLACE"})


def usable_pattern(df: DataFrame, pattern: str, replacement: str) -> bool:
    """Whether Java's engine takes the pattern and the replacement's group references."""
    jvm = df.sparkSession.sparkContext._jvm
    try:
        groups = jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except Exception:  # the gateway wraps the pattern error
        return False
    i = 0
    while i < len(replacement):
        if replacement[i] == "\\":
            i += 1
            if i == len(replacement):
                return False
        elif replacement[i] == "$":
            digit = replacement[i + 1 : i + 2]
            if digit != "{" and (not digit.isdigit() or int(digit) > groups):
                return False
        i += 1
    return True


def cleanse(df: DataFrame, table: str, rules: Iterable[Rule]) -> DataFrame:
    """Apply the rules of ``table`` in their order, each on what the one before it made.

    Null passes through. Rules for missing columns or columns that aren't strings, without a needed argument, or with a bad pattern are
    skipped with a warning.
    """
    types = {f.name.lower(): (f.name, f.dataType) for f in df.schema}
    made: dict[str, Column] = {}
    for rule in rules:
        if rule.table.lower() != table.lower() or rule.column.lower() not in types:
            continue
        name, kind = types[rule.column.lower()]
        if not isinstance(kind, StringType):
            continue
        if rule.kind in NEEDS_ARG and not rule.arg or rule.kind == "REGEX_REPLACE" and not usable_pattern(df, rule.arg or "", rule.replacement):
            log.warning("rule %s on %s.%s is skipped", rule.kind, table, name)
            continue
        made[name] = KINDS[rule.kind](made.get(name, F.col(f"`{name}`")), rule)
    return df.withColumns(made) if made else df


def hashed_columns(table: str, rules: Iterable[Rule]) -> set[str]:
    """Lower-cased names of hashed columns: audits leave them out."""
    return {r.column.lower() for r in rules if r.table.lower() == table.lower() and r.kind == "HASH_SHA256"}


def cleansed_keys(table: str, key: Iterable[str], rules: Iterable[Rule]) -> set[str]:
    """Key columns that a rule changes; a table with any can't be compared with its source by raw key."""
    keys = {k.lower() for k in key}
    return {r.column.lower() for r in rules if r.table.lower() == table.lower() and r.column.lower() in keys}
