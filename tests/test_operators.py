from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import audit, cursor, fold, merge, metrics, objects, scan

KEYED = "id long, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_treats_null_keys_as_keys(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], KEYED)
    source = spark.createDataFrame([(1, "b"), (2, "c"), (None, "m")], KEYED)
    assert rows(merge.upsert(target, source, ["id"])) == [(1, "b"), (2, "c"), (None, "m")]
    assert rows(merge.changed_rows(target, spark.createDataFrame([(1, "a"), (2, None)], KEYED), ["id"])) == [(2, None)]
    assert rows(merge.surplus_keys(target, spark.createDataFrame([(None, "")], KEYED), ["id"])) == [(1,)]


def test_last_row_of_a_key_wins_and_null_keys_fail(spark):
    target = spark.createDataFrame([(1, "a")], KEYED)
    source = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "ID long, v string, n int")
    assert rows(merge.upsert_by(target, source, ["id"], ["n"]).select("id", "v")) == [(1, "y"), (3, "z")]
    with pytest.raises(Exception, match="null in an upsert key"):
        merge.upsert_by(target, spark.createDataFrame([(None, "x", 1)], source.schema), ["id"], ["n"]).collect()
    with pytest.raises(merge.MergeRefused):
        merge.resolve_keys(["a"], ["b"])


def test_initial_load(spark):
    empty, some = spark.createDataFrame([], KEYED), spark.createDataFrame([(1, "a")], KEYED)
    assert rows(merge.initial_load(empty, some, [])) == [(1, "a")]
    with pytest.raises(merge.MergeRefused):
        merge.initial_load(some, some, [])
    assert merge.may_compare_deletes([], 3) and merge.may_compare_deletes(["k"], None) and merge.may_compare_deletes(["k"], 30_000) and merge.may_compare_deletes(["k"], 5) is None


def test_range_overwrite_keeps_rows_of_null(spark):
    target, source = spark.createDataFrame([(1, "a"), (2, None)], KEYED), spark.createDataFrame([(9, "a")], KEYED)
    assert rows(merge.range_overwrite(target, source, "v = 'a'")) == [(2, None), (9, "a")]


def test_repair_has_a_ceiling(spark):
    source = spark.range(10).select("id", F.lit("x").alias("v"))
    target = source.where("id < 6")
    mended, n = merge.repair_missing(target, source, ["id"])
    assert n == 4 and mended.count() == 10
    same, n = merge.repair_missing(target, source, ["id"], most=3)
    assert n is None and same.count() == 6


def test_pruning_keeps_columns_when_a_key_is_absent(spark):
    df = spark.createDataFrame([(1, "a")], KEYED)
    assert merge.prune_to(df, ["V"], []).columns == ["v"]
    assert merge.prune_to(df, ["v"], ["id"]).columns == ["id", "v"]


EVENT = st.tuples(st.integers(0, 3), st.sampled_from([1, 2, 3, 4]), st.integers(0, 9))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(EVENT, min_size=1, max_size=30), st.sets(st.integers(0, 5), max_size=4))
def test_fold_and_apply_agree_with_a_replay(spark, events, held):
    log = spark.createDataFrame([(i, k, op, v) for i, (k, op, v) in enumerate(events)], "seq int, k int, op int, v int")
    target = spark.createDataFrame([(k, -1) for k in held], "k int, v int")
    state = dict.fromkeys(held, -1)
    for k, op, v in events:
        if op == 1:
            state.pop(k, None)
        elif op != 3:
            state[k] = v
    one, two = fold.fold(log, ["k"], ["seq"]), fold.fold_aggregated(log, ["k"], ["seq"])
    assert rows(one.select("k", "op", "v")) == rows(two.select("k", "op", "v"))
    assert rows(fold.apply_changes(target, two.drop("seq"), ["k"])) == sorted(state.items(), key=repr)


def test_positions(spark):
    df = spark.createDataFrame([("0/16B3748",), ("1/0",), ("0x0000002A000001F80003",), ("zz",)], "p string").select(fold.lsn_key(F.col("p")).alias("n"))
    assert [r.n and int(r.n) for r in df.collect()] == [0x16B3748, 1 << 32, 0x2A000001F80003, None]
    log = spark.createDataFrame([("0x01",), ("0x0A",)], "lsn string")
    assert fold.lsn_window(log, "0xFF", "0x0B").count() == 2
    assert fold.over_budget(spark.createDataFrame([(1, "aaaa"), (1, "b"), (2, "c")], "tx int, v string"), "tx", rows=1).count() == 1


def test_cursor_choice():
    f = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])
    shape = lambda schema, **k: cursor.TableShape("t", schema, **k)
    assert cursor.choose_cursor(shape(f(id=T.LongType(), created_at=T.TimestampType(), updated_at=T.TimestampType()), key=["id"])).column == "updated_at"
    c = cursor.choose_cursor(shape(f(id=T.LongType(), created_at=T.TimestampType()), key=["id"]))
    assert (c.kind, c.column, c.sees_updates) == ("IDENTITY", "created_at", False)
    assert cursor.choose_cursor(shape(f(id=T.LongType(), updated_at=T.StringType()), key=["id"])).column == "id"
    assert cursor.choose_cursor(shape(f(a=T.StringType()), rows=20_000)).kind == "FULL_COMPARE"
    assert cursor.choose_cursor(shape(f(a=T.StringType()), rows=20_001)).kind == "NONE"
    assert cursor.choose_cursor(shape(f(a=T.StringType()), row_level_scn=True)).is_pseudo
    assert cursor.choose_cursor(shape(f(a=T.LongType())), "A").kind == "IDENTITY"
    assert cursor.choose_cursor(shape(f(a=T.StringType())), "a").kind == "NONE"
    now = datetime(2024, 1, 1, 0, 0, 1)
    assert cursor.lagged(now, True) == datetime(2024, 1, 1) and cursor.lagged(now, False) == now and cursor.lagged(7, True) == 7 and cursor.lagged("x", True) == "x"
    assert cursor.lagged("2024-01-01 00:00:01", True) == "2024-01-01 00:00:00"
    assert cursor.truncated_to_scale(datetime(2024, 1, 1, 0, 0, 0, 123456), 3).microsecond == 123000


def test_ranges_cover_every_key_once():
    for low, high, parts in [(1, 10, 3), (-5, 5, 4), (7, 7, 8), (0, 2**40, 7)]:
        ranges = scan.split_ranges(low, high, parts)
        assert ranges[0][0] == low - 1 and ranges[-1][1] == high and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert scan.split_ranges(-(2**63), 2**63 - 1, 2) is None and scan.split_ranges(5, 4, 2) == []
    assert scan.boundary_ranges([1, 5, 9]) == [(None, 5), (5, 9), (9, None)] and scan.boundary_ranges([1]) == [(None, None)]
    k = lambda t: T.StructType([T.StructField("k", t)])
    assert scan.load_route(k(T.LongType()), ["k"], 20) == scan.Route("KEYSET_NUMERIC", 8)
    assert scan.load_route(k(T.DecimalType(20, 0)), ["k"], 2).kind == "KEYSET_COMPOSITE" and scan.load_route(k(T.LongType()), [], 4).parallelism == 1


def test_preview_says_whether_there_is_more(spark):
    df = spark.range(120).select("id", F.lit(b"abc").alias("b"))
    shown, more = scan.preview(df)
    assert shown.count() == 100 and more and shown.first().b == "<binary 3 bytes>"


def test_content_audit_counts_rows_and_columns(spark):
    source = spark.range(100).select("id", (F.col("id") * 2).alias("v"), F.lit("s").alias("h"))
    target = source.where("id <> 0").withColumn("v", F.when(F.col("id") == 50, 7).otherwise(F.col("v")))
    row = audit.content_audit(source, target, ["id"], 100, hashed=["H"]).first().asDict()
    assert row == {"sampled": 100, "missing": 1, "mismatched": 2, "diff_v": 1}
    assert audit.audit_reaction(1, 5) == "REPAIR" and audit.audit_reaction(0, 5) == "REPORT"


def test_packing_and_names():
    items = [objects.Item(n, r) for n, r in [("a", 10), ("b", 10), ("c", None), ("d", 0)]]
    assert [[i.name for i in b] for b in objects.pack(items, 2)] == [["a", "c"], ["b", "d"]]
    assert objects.pack([], 3) == [] and len(objects.pack(items, 0)) == 1 and len(objects.pack(items, 9)) == 4
    assert objects.by_dependencies(["x", "y", "z"], {"x": ["y", "z"], "z": ["y"]}) == ["y", "z", "x"]
    assert objects.selected(["A", "b"], []) == ["A", "b"] and objects.selected(["A", "b"], ["a"]) == ["A"] and objects.selected(["A"], [], True) == []
    assert objects.mapped("Orders", {"ORDERS": "o"}) == "o" and objects.glob_list("a*, b?\n c") == ["a*", "b?", "c"]


def test_estimates():
    assert metrics.is_heavy(3000, 5000) and not metrics.is_heavy(2500, 5000) and not metrics.is_heavy(0, 5000)
    assert metrics.recommended_interval_ms(1) == 5000 and metrics.recommended_interval_ms(10_001) == 22_000
