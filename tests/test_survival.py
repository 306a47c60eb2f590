"""What a crash, a second holder or a late row may not do."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark import queries
from tidemark.etl import runner
from tidemark.etl.runner import EtlTask, run
from tidemark.operators import capture, metrics, scan
from tidemark.parsers import redo
from tidemark.projection import documents, migration
from tidemark.sources.state import LeaseLost, StateStore
from tidemark.streaming.cdc import VersionedTable

NOW = datetime(2024, 3, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents_survive_a_crash(spark, tmp_path, monkeypatch):
    state = StateStore(spark, str(tmp_path))
    for n in range(5):
        state.write("a.b/c", {"n": n})
    assert state.numbered("a.b/c") == (4, {"n": 4}) and state.read("a.b") is None
    assert not state.swap("a.b/c", 2, {"n": "late"}) and not state.swap("a.b/c", 3, {"n": "late"}) and state.read("a.b/c") == {"n": 4}
    (tmp_path / "_half").write_text('{"n": ')  # a draft that a crash left
    assert state.read("a.b/c") == {"n": 4}
    assert len([f for f in tmp_path.iterdir() if f.suffix == ".json"]) == 2
    state.delete("a.b/c")
    assert state.read("a.b/c") is None


def test_two_writers_lose_nothing(spark, tmp_path):
    states = [StateStore(spark, str(tmp_path)) for _ in range(2)]

    def add(state, name):
        for k in range(10):
            while True:
                number, now = state.numbered("list")
                if state.swap("list", number, {"all": [*(now or {"all": []})["all"], f"{name}{k}"]}):
                    break

    running = [threading.Thread(target=add, args=(s, n)) for s, n in zip(states, "xy")]
    for r in running:
        r.start()
    for r in running:
        r.join()
    assert sorted(states[0].read("list")["all"]) == sorted(f"{n}{k}" for n in "xy" for k in range(10))


def test_a_lost_lease_stops_its_holder(spark, tmp_path):
    now = [100.0]
    state, clock = StateStore(spark, str(tmp_path)), lambda: now[0]
    with state.lease("job", 60, clock, renewed=False) as first:
        assert first and first.fence == 1
        with state.lease("job", 60, clock, renewed=False) as other:
            assert not other
        now[0] += 50
        first.require()
        now[0] += 61
        with state.lease("job", 60, clock, renewed=False) as second:
            assert second and second.fence == 2
            with pytest.raises(LeaseLost):
                first.require()
            second.require()
    with state.lease("job", 60, clock, renewed=False) as third:
        assert third and third.fence == 3


def test_versions_without_a_pointer_are_no_empty_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "t")
    assert table.current() is None
    table.replace(spark.range(3))
    table.replace(spark.range(4))
    assert table.current().count() == 4
    table.state.delete("current")
    with pytest.raises(RuntimeError):
        table.current()


def test_a_resumed_range_overwrite_deletes_nothing(spark, tmp_path):
    state, target = StateStore(spark, str(tmp_path)), "etl_range_resumed"
    spark.sql(f"DROP TABLE IF EXISTS {target}")
    spark.createDataFrame([(1, "old"), (2, "old"), (100, "b")], "id int, v string").write.saveAsTable(target)
    task = EtlTask("rr", "SELECT id, 'a' AS v FROM feed_rr", target, "RANGE_OVERWRITE", range_condition="id < 100", resume_key="id")
    for ids in ([1, 2], [1, 2, 3], [1, 2, 3]):
        spark.createDataFrame([(i,) for i in ids], "id int").createOrReplaceTempView("feed_rr")
        run(spark, task, NOW, state)
    assert rows(spark.table(target)) == [(1, "a"), (100, "b"), (2, "a"), (3, "a")] and state.read("etl-rr") == {"last": 3}


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    state, target = StateStore(spark, str(tmp_path)), "etl_counted"
    for mode in ("OVERWRITE", "APPEND"):
        spark.sql(f"DROP TABLE IF EXISTS {target}")
        key = {"resume_key": "id"} if mode == "APPEND" else {}
        done = run(spark, EtlTask(f"c{mode}", "SELECT id FROM range(1000) WHERE rand() < 0.5", target, mode, **key), NOW, state)
        written = spark.table(target)
        assert done.rows == written.count() and (not key or state.read(f"etl-c{mode}")["last"] == written.agg(F.max("id")).first()[0])


@pytest.mark.parametrize("step", ["RENAME TO etl_crash__old", r"RENAME TO etl_crash\Z", "DROP TABLE IF EXISTS etl_crash__old"])
def test_a_replacement_is_finished_by_the_next_run(spark, monkeypatch, step):
    import re

    for t in ("etl_crash", "etl_crash__old", "etl_crash__next"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    run(spark, EtlTask("x", "SELECT 1 AS a", "etl_crash"), NOW)
    real, once = type(spark).sql, []

    def failing(self, text, *a, **k):
        if re.search(step, text) and not once:
            once.append(text)
            raise OSError("power cut")
        return real(self, text, *a, **k)

    monkeypatch.setattr(type(spark), "sql", failing)
    with pytest.raises(OSError):
        run(spark, EtlTask("x", "SELECT 2 AS a", "etl_crash"), NOW)
    runner.recover(spark, "etl_crash")
    assert rows(spark.table("etl_crash")) in ([(1,)], [(2,)])
    run(spark, EtlTask("x", "SELECT a + 10 AS a FROM etl_crash", "etl_crash"), NOW)
    assert rows(spark.table("etl_crash")) in ([(11,)], [(12,)]) and not spark.catalog.tableExists("etl_crash__old")


def test_buckets_begin_at_their_window(spark):
    samples = spark.createDataFrame([(datetime(2024, 1, 1, 1, 30), 1.0), (datetime(2024, 1, 1, 7, 0), 2.0), (datetime(2024, 1, 1, 0, 59), 9.0), (datetime(2024, 1, 1, 14, 0), 9.0)], "ts timestamp_ntz, value double")
    at = lambda h: F.lit(f"2024-01-01 {h}:00:00").cast("timestamp_ntz")
    got = rows(metrics.buckets(samples, at("01"), at("14"), "6 HOURS").select(F.date_format("slot", "HH"), "total"))
    assert got == [("01", 1.0), ("07", 2.0), ("13", None)]
    assert metrics.buckets(samples, at("14"), at("01"), "6 HOURS").count() == 0 and metrics.buckets(samples, at("01"), at("01"), "6 HOURS").count() == 0


@pytest.mark.parametrize("name", ["cdc_fold_transactions", "cdc_fold_lww", "etl_upsert_last_wins", "upsert_merge", "delete_detect", "etl_range_overwrite_resumed"])
def test_no_plan_gathers_all_rows(spark, name):
    found = {**queries.QUERIES}
    if name not in found:
        from tidemark import queries_runs  # noqa: F401

        found = queries.QUERIES
    plan = found[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_ranks_beyond_32_bits(spark):
    """Numbers of a global sort have the partition in their upper half: starts of buckets are found there, not by 32-bit ranks."""
    keys = spark.range(0, 1000, 1, 7).select((F.col("id") * 2**40).alias("k"))
    got = {r.bucket: r.k // 2**40 for r in scan.sampled_boundaries(keys, ["k"], 8).collect()}
    assert got == {i + 1: i * 125 for i in range(8)}


def test_values_that_a_column_cannot_hold_are_told(spark):
    docs = spark.createDataFrame([('{"_id":"a","n":1}',), ('{"_id":"b","n":"one"}',), ('{"_id":"c","n":null}',), ('{"_id":"d"}',)], "doc string")
    columns = documents.inferred(docs.limit(1))
    assert {r.name: r.documents for r in documents.unheld(docs, "doc", columns).collect()} == {"n": 1}
    with pytest.raises(documents.DocumentError):
        documents.require_held(docs, "doc", columns)
    with pytest.raises(documents.DocumentError):
        documents.inferred(docs, most=1)
    kept = migration.filtered(docs, "doc", {"$or": [{"_id": "a"}, {"_id": {"$in": ["d"]}}]})
    assert [r.doc for r in kept.collect()] == ['{"_id":"a","n":1}', '{"_id":"d"}']


def test_a_malformed_statement_is_refused_alone(spark):
    bad = ['update "A"."T" set "X" = where', "insert into", None, 'insert into "A"."T"("ID") values (', 'update "A"."T" set "X" = \'', 'delete from "A"."T" where "ID" = HEXTORAW(\'zz\')']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(bad)] + [(99, 'insert into "A"."T"("ID") values (1)')], "i int, sql string")
    got = {r.i: r for r in redo.parse_statements(df, "sql", "i", ["ID"]).collect()}
    assert got[99].op == "INSERT" and len(got) == 7 and all(got[i].refused for i in range(5))


def test_capture_strategies():
    assert capture.Strategy.of(" binlog_cdc ") is capture.Strategy.BINLOG_CDC and capture.Strategy.of(None) is capture.Strategy.POLLING
    with pytest.raises(ValueError):
        capture.Strategy.of("magic")
    assert capture.sink_of(None) == "JDBC" and capture.sink_of("redis") == "REDIS"
    with pytest.raises(capture.ValueTooLarge):
        capture.read_modes({"id": 1 << 21}, [], ["ID"])
