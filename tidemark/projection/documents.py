"""Documents with a schema of their own: inference, rendering and filters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 200
#: Fields that inference lists on the driver.
FIELDS = 10_000
FILTER_LENGTH, FILTER_DEPTH = 4000, 32
_BLOCKED = frozenset({"$where", "$function", "$accumulator", "$out", "$merge"})

#: Kinds of values, each with its rank among numbers (0: none) and the Spark type of a column of it.
KINDS = {
    "Int32": (1, "int"), "Int64": (2, "bigint"), "Double": (3, "double"), "Decimal128": (4, "decimal(38,10)"),
    "ObjectId": (0, "string"), "String": (0, "string"), "Boolean": (0, "smallint"), "Date": (0, "timestamp"), "Binary": (0, "binary"),
    "Document": (0, "string"), "Array": (0, "string"), "BsonTimestamp": (0, "bigint"), "Null": (0, "string"), "Mixed": (0, "string"),
}
_EXTENDED = {"$oid": "ObjectId", "$date": "Date", "$numberDecimal": "Decimal128", "$numberLong": "Int64", "$numberDouble": "Double", "$numberInt": "Int32", "$binary": "Binary", "$timestamp": "BsonTimestamp"}


class DocumentError(ValueError):
    pass


def kind_of(value: Column) -> Column:
    """The kind of a JSON value given as text (strings with their quotes), extended JSON included."""
    wrapped = F.regexp_extract(value, r'^\{\s*"(\$\w+)"\s*:', 1)
    special = F.create_map(*[F.lit(x) for p in _EXTENDED.items() for x in p])[wrapped]
    number = F.when(value.rlike(r"^-?\d+$"), F.when(value.try_cast("int").isNotNull(), "Int32").when(value.try_cast("bigint").isNotNull(), "Int64").otherwise("Double")).when(value.rlike(r"^-?\d*\.?\d+([eE][+-]?\d+)?$"), "Double")
    return F.when(value.isNull() | (value == "null"), "Null").when(special.isNotNull(), special).when(value.startswith("{"), "Document").when(value.startswith("["), "Array").when(value.startswith('"'), "String").when(value.isin("true", "false"), "Boolean").otherwise(number)


def fields_of(docs: DataFrame, json_col: str) -> DataFrame:
    """(name, value): every field of every document, values as JSON text."""
    return docs.select(F.explode(F.from_json(F.col(json_col), "map<string,variant>")).alias("name", "v")).select("name", F.to_json("v").alias("value"))


def observed_kinds(docs: DataFrame, json_col: str) -> DataFrame:
    """(name, kinds): the kinds of each field without nulls, sorted; combined before the shuffle."""
    found = fields_of(docs, json_col).select("name", kind_of(F.col("value")).alias("kind"))
    return found.groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "Null", F.col("kind")))).alias("kinds"))


def narrowed(kinds: Iterable[str]) -> str:
    """The one kind that a column of these is declared with: numbers widen, a long and a log time stay a long, other mixes are text."""
    found = set(kinds)
    if not found:
        return "Null"
    if len(found) == 1:
        return found.pop()
    if all(KINDS[k][0] for k in found):
        return max(found, key=lambda k: KINDS[k][0])
    return "BsonTimestamp" if found <= {"Int64", "BsonTimestamp"} else "Mixed"


def inferred(docs: DataFrame, json_col: str = "doc", sample: int | None = SAMPLE, most: int = FIELDS) -> list[tuple[str, str, str]]:
    """(name, kind, Spark type) of each field: ``_id`` first, the others by name. A filter belongs on ``docs``, before the sample is taken.

    Names have to be plain, and may not differ in case alone; documents with more than ``most`` fields between them, as where keys are data, are refused.
    """
    found = observed_kinds(docs.limit(sample) if sample else docs, json_col).limit(most + 1).collect()
    if len(found) > most:
        raise DocumentError(f"more than {most} fields")
    rows = {r.name: list(r.kinds) for r in found}
    folded: dict[str, str] = {}
    for name in rows:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", name):
            raise DocumentError(f"field {name!r} can't be a column")
        if folded.setdefault(name.lower(), name) != name:
            raise DocumentError(f"fields {name} and {folded[name.lower()]} differ in case alone")
    return [(n, k, KINDS[k][1]) for n in sorted(rows, key=lambda n: (n != "_id", n)) for k in [narrowed(rows[n])]]


def _parsed(docs: DataFrame, json_col: str, columns: Sequence[tuple[str, str, str]], carried: str | None = None) -> DataFrame:
    """Each document parsed once, into a struct of the wanted fields."""
    fields = T.StructType([T.StructField(name, T.VariantType()) for name, _, _ in columns])
    return docs.select(*([carried] if carried else []), F.from_json(F.col(json_col), fields).alias("m"))


def _value(v: Column, kind: str, spark_type: str) -> Column:
    """A parsed field as a value of its column; null where it can't be one."""
    inside = lambda tag, as_type="string": F.try_variant_get(v, f"$['{tag}']", as_type)
    text = F.try_variant_get(v, "$", "string")
    wrapped = F.coalesce(*(inside(tag) for tag in _EXTENDED if tag not in ("$binary", "$timestamp")))
    match kind:
        case "Boolean":
            return F.try_variant_get(v, "$", "boolean").cast("smallint")
        case "Date":
            moment = F.coalesce(F.try_variant_get(v, "$['$date']['$numberLong']", "string"), inside("$date"), text)
            return F.coalesce(F.try_to_timestamp(moment), F.timestamp_millis(moment.try_cast("bigint")))
        case "Binary":
            return F.unbase64(F.coalesce(F.try_variant_get(v, "$['$binary']['base64']", "string"), inside("$binary")))
        case "BsonTimestamp":
            part = lambda k: F.try_variant_get(v, f"$['$timestamp']['{k}']", "bigint")
            return F.coalesce(part("t") * F.lit(2**32) + part("i"), F.coalesce(inside("$numberLong"), text).try_cast("bigint"))
        case "Document" | "Array":
            return F.when(F.schema_of_variant(v) != "VOID", F.to_json(v)) if kind == "Array" else F.coalesce(wrapped, F.when(~F.is_variant_null(v), F.to_json(v)))
        case "String":
            return F.coalesce(text, wrapped)
        case _:
            return F.coalesce(wrapped, text).try_cast(spark_type)


def rendered(docs: DataFrame, json_col: str, columns: Sequence[tuple[str, str, str]], carried: str | None = None) -> DataFrame:
    """Documents as rows of the inferred columns: ids and text plain, dates as moments, booleans as 1 and 0, nested values as JSON text.

    A value that its column can't hold becomes null; unheld() counts those, so that a caller can refuse to go on.
    """
    return _parsed(docs, json_col, columns, carried).select(*([carried] if carried else []), *(_value(F.col(f"m.`{name}`"), kind, spark_type).alias(name) for name, kind, spark_type in columns))


def unheld(docs: DataFrame, json_col: str, columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(name, documents): for each column how many documents have a value that it can't hold; columns without any are left out."""
    fields = [(name, F.col(f"m.`{name}`"), kind, spark_type) for name, kind, spark_type in columns]
    lost = [F.count_if(v.isNotNull() & ~F.is_variant_null(v) & _value(v, kind, spark_type).isNull()).alias(name) for name, v, kind, spark_type in fields]
    counts = _parsed(docs, json_col, columns).agg(*lost)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"`{name}`").alias("documents")) for name, *_ in fields)))
    return counts.select(each.alias("x")).select("x.*").where("documents > 0")


def require_held(docs: DataFrame, json_col: str, columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rendered(), refused where a value would be lost."""
    lost = {r.name: r.documents for r in unheld(docs, json_col, columns).collect()}  # a row for each column at most
    if lost:
        raise DocumentError("values that their columns can't hold: " + ", ".join(f"{n} in {k} documents" for n, k in sorted(lost.items())))
    return rendered(docs, json_col, columns)


# filters -----------------------------------------------------------------------------------------


def _depth(value: Any) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + max(map(_depth, inner), default=0)


def parse_filter(text: str) -> dict:
    """A JSON filter within its bounds, without operators that run code or write."""
    if len(text) > FILTER_LENGTH:
        raise DocumentError("filter too long")
    try:
        value = json.loads(text or "{}")
    except ValueError as e:
        raise DocumentError(f"filter is no JSON: {e}") from None
    if not isinstance(value, dict) or _depth(value) > FILTER_DEPTH:
        raise DocumentError("filter is no object, or too deep")
    for m in re.finditer(r'"(\$\w+)"\s*:', json.dumps(value)):
        if m[1] in _BLOCKED:
            raise DocumentError(f"{m[1]} isn't allowed")
    return value


def _plain(value: Any) -> Any:
    if isinstance(value, dict) and len(value) == 1 and (tag := next(iter(value))) in _EXTENDED:
        inner = value[tag]
        return int(inner) if tag in ("$numberLong", "$numberInt") else float(inner) if tag in ("$numberDouble", "$numberDecimal") else F.to_timestamp(F.lit(inner)) if tag == "$date" and isinstance(inner, str) else inner
    return value


def _field(name: str, spec: Any) -> Column:
    c = F.col(f"`{name}`")
    if not isinstance(spec, dict) or not any(k.startswith("$") for k in spec) or len(spec) == 1 and next(iter(spec)) in _EXTENDED:
        v = _plain(spec)
        return c.isNull() if v is None else c == v
    out = F.lit(True)
    for op, given in spec.items():
        v = _plain(given)
        match op:
            case "$eq":
                t = c.isNull() if v is None else c == v
            case "$ne":
                t = c.isNotNull() if v is None else ~c.eqNullSafe(F.lit(v))
            case "$gt":
                t = c > v
            case "$gte":
                t = c >= v
            case "$lt":
                t = c < v
            case "$lte":
                t = c <= v
            case "$in" | "$nin":
                known = [_plain(x) for x in v if x is not None]
                inside = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
                inside = inside | c.isNull() if None in v else inside
                t = inside if op == "$in" else ~inside
            case "$exists":
                t = c.isNotNull() if v else c.isNull()
            case "$regex":
                t = c.rlike(("(?i)" if "i" in spec.get("$options", "") else "") + v)
            case "$options":
                continue
            case "$not":
                t = ~F.coalesce(_field(name, v), F.lit(False))
            case "$mod":
                t = c % v[0] == v[1]
            case "$size":
                t = F.size(c) == v
            case _:
                raise DocumentError(f"operator {op}")
        out = out & t
    return F.coalesce(out, F.lit(False))


def condition(spec: dict) -> Column:
    """A filter as a column expression that Spark can push down."""
    out = F.lit(True)
    for name, value in spec.items():
        match name:
            case "$and":
                parts = [condition(v) for v in value]
                t = parts[0]
                for p in parts[1:]:
                    t = t & p
            case "$or" | "$nor":
                parts = [condition(v) for v in value]
                t = parts[0]
                for p in parts[1:]:
                    t = t | p
                t = ~t if name == "$nor" else t
            case _ if name.startswith("$"):
                raise DocumentError(f"operator {name}")
            case _:
                t = _field(name, value)
        out = out & t
    return out


def field_names(spec: Any) -> list[str]:
    """Fields that a filter names, in order."""
    out: list[str] = []
    for name, value in spec.items():
        out += [n for v in value for n in field_names(v)] if name in ("$and", "$or", "$nor") else [name]
    return list(dict.fromkeys(out))


def resume_filter(spec: dict, key: str, last: Any) -> dict:
    """The filter for rows beyond the last committed key."""
    return {"$and": [spec, {key: {"$gt": last}}]} if spec else {key: {"$gt": last}}
