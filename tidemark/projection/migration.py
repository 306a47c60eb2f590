"""Moving whole indexes and collections, and verifying what arrived."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.objects import glob_list, glob_regex
from .documents import condition, field_names, inferred, parse_filter, rendered, require_held

MODES = {"OVERWRITE": "overwrite", "APPEND": "append", "FAIL_IF_EXISTS": "errorifexists"}
#: Settings that belong to one cluster and aren't taken along.
LOCAL_SETTINGS = ("uuid", "version", "creation_date", "provided_name", "history", "routing", "resize", "blocks")


def target_name(name: str, naming: str = "SAME", affix: str = "") -> str:
    return {"SAME": name, "PREFIX": affix + name, "SUFFIX": name + affix}[naming]


def chosen(names: Iterable[str], globs: str) -> list[str]:
    """Names that match any glob; those that start with a dot are a system's own and only go by their full name."""
    import re

    wanted = glob_list(globs)
    patterns = [re.compile(glob_regex(g)) for g in wanted]
    return [n for n in names if n in wanted or not n.startswith(".") and any(p.match(n) for p in patterns)]


def clean_settings(settings: dict) -> dict:
    """Index settings without those of the old cluster."""
    out = copy.deepcopy(settings)
    index = out.get("index", out)
    for name in LOCAL_SETTINGS:
        index.pop(name, None)
    return out


def write_mode(mode: str) -> str:
    return MODES[mode]


def verify_count(written: int, source: int, target: int, mode: str) -> str:
    """FAILED where rows are lacking: appends may find more in the target, other modes need the very number."""
    fine = target >= written if mode == "APPEND" else source == target
    return "OK" if fine else "FAILED"


def verify_sample(source: DataFrame, target: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """(sampled, missing, mismatched) of the documents in ``ids``; content is compared as a whole and null-safe."""
    values = sorted(c for c in source.columns if c != key)
    own = lambda df, tag: df.join(ids.select(key), key, "left_semi").select(key, F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias(tag))
    both = own(source, "a").join(own(target, "b"), key, "left")
    return both.agg(F.count("*").alias("sampled"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("mismatched"))


def move_documents(spark: SparkSession, docs: DataFrame, path: str, mode: str, key: str = "_id", sample: int = 100) -> dict:
    """Copy documents (a column each) as JSON lines and verify: counts decide over success, differences in the sample are only told."""
    docs.write.mode(write_mode(mode)).json(path)
    arrived = spark.read.schema(docs.schema).json(path)
    n = docs.count()
    seen = verify_sample(docs, arrived, key, docs.select(key).orderBy(F.xxhash64(key)).limit(sample)).first()
    return {"written": n, "status": verify_count(n, n, arrived.count(), mode), "sampled": seen.sampled, "differing": seen.missing + seen.mismatched}


def filtered(docs: DataFrame, json_col: str, spec: dict) -> DataFrame:
    """Documents that meet a filter; only the fields that it names are read for it."""
    names = field_names(spec)
    if not names:
        return docs
    columns = [c for c in inferred(docs, json_col, sample=None) if c[0] in names]
    absent = [(n, "Null", "string") for n in names if n not in {c[0] for c in columns}]
    tested = rendered(docs.withColumn("_doc", F.col(json_col)), json_col, [*columns, *absent], carried="_doc").where(condition(spec))
    return tested.select(F.col("_doc").alias(json_col))


def move_collections(spark: SparkSession, collections: Mapping[str, DataFrame], globs: str, folder: str, mode: str, key: str = "_id", naming: str = "SAME", affix: str = "") -> list[dict]:
    """move_documents() for every collection whose name matches; one that fails doesn't stop the others."""
    out = []
    for name in chosen(collections, globs):
        told = {"collection": name, "target": target_name(name, naming, affix)}
        try:
            told |= move_documents(spark, collections[name], f"{folder.rstrip('/')}/{told['target']}", mode, key)
        except Exception as e:
            told |= {"status": "FAILED", "error": str(e).splitlines()[0]}
        out.append(told)
    return out


# Field types of an index, in Spark.
_INDEX_TYPES = {"keyword": "string", "text": "string", "long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint", "double": "double", "float": "float", "half_float": "float", "scaled_float": "double", "boolean": "boolean", "date": "timestamp", "binary": "binary", "ip": "string"}


def schema_of_mapping(mapping: dict) -> T.StructType:
    """The columns that an index mapping declares; objects are structs, nested ones arrays of structs, types that aren't known text."""
    fields = []
    for name, spec in mapping.get("properties", {}).items():
        inner = schema_of_mapping(spec) if "properties" in spec else None
        kind = inner if inner is not None else T.StructType.fromDDL(f"c {_INDEX_TYPES.get(spec.get('type'), 'string')}")["c"].dataType
        fields.append(T.StructField(name, T.ArrayType(kind) if spec.get("type") == "nested" else kind))
    return T.StructType(fields)


def aliases_for(aliases: dict, naming: str = "SAME", affix: str = "") -> dict:
    """Aliases to set on the target index: filters and routing go along, and a renamed index doesn't take over the write of the old one."""
    return {target_name(n, naming, affix): {k: v for k, v in spec.items() if naming == "SAME" or k != "is_write_index"} for n, spec in aliases.items()}


def collection_to_table(spark: SparkSession, docs: DataFrame, table: str, mode: str, json_col: str = "doc", where: str = "{}") -> dict:
    """Infer columns from JSON documents, render them as rows, write a table and verify its count. ``where`` is a filter on the columns."""
    docs = filtered(docs, json_col, parse_filter(where))  # before the sample is taken
    columns = inferred(docs, json_col)
    rows = require_held(docs, json_col, columns)
    before = spark.table(table).count() if mode == "APPEND" and spark.catalog.tableExists(table) else 0
    rows.write.mode(write_mode(mode)).saveAsTable(table)
    n, now = rows.count(), spark.table(table).count()
    return {"columns": [c for c, _, _ in columns], "written": n, "status": verify_count(before + n, n, now, mode)}
