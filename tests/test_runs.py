import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.etl.runner import EtlError, EtlResult, EtlTask, precheck, run, run_batch
from tidemark.functions.cleanse import Rule
from tidemark.operators.cursor import TableShape
from tidemark.plans.sync import TablePlan, chunked_load, run_cycle
from tidemark.plans.sync import precheck as sync_precheck
from tidemark.projection import documents, migration
from tidemark.sources import catalog, jdbc
from tidemark.sources.state import StateStore
from tidemark.streaming import alerts
from tidemark.streaming.cdc import VersionedTable, follow, merge_batch

NOW = datetime(2024, 3, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_state(spark, tmp_path):
    state = StateStore(spark, str(tmp_path))
    assert state.read("a") is None
    state.write("a", {"x": 1})
    assert state.read("a") == {"x": 1} and state.advance("p", "lsn", 5) and not state.advance("p", "lsn", 4) and state.read("p") == {"lsn": 5}
    with state.lease("job") as first, state.lease("job") as second:
        assert first and not second
    with state.lease("job") as again:
        assert again


@pytest.mark.parametrize("mode, wanted", [("OVERWRITE", [(1, "n"), (3, "n")]), ("APPEND", [(1, "n"), (1, "o"), (2, "o"), (3, "n")]), ("RANGE_OVERWRITE", [(1, "n"), (2, "o"), (3, "n")]), ("UPSERT", [(1, "n"), (2, "o"), (3, "n")])])
def test_write_modes(spark, mode, wanted):
    table = f"etl_{mode.lower()}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.createDataFrame([(1, "o"), (2, "o")], "id int, v string").write.saveAsTable(table)
    task = EtlTask("t", "SET x = 1; SELECT id, '${mark}' AS v, 1 AS extra FROM VALUES (1), (3) AS s(id)", table, mode, "mark = n", range_condition="id = 1 OR id = 3" if mode == "RANGE_OVERWRITE" else "${unused}", upsert_keys=["ID"] if mode == "UPSERT" else ())
    result = run(spark, task, NOW)
    assert result.rows == 2 and result.dropped_columns == ([] if mode == "never" else ["extra"])
    assert rows(spark.table(table)) == wanted


def test_resume_and_refusals(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS etl_resume")
    spark.createDataFrame([(1,), (2,)], "id int").createOrReplaceTempView("feed")
    state, task = StateStore(spark, str(tmp_path)), EtlTask("r", "SELECT id FROM feed", "etl_resume", "APPEND", resume_key="id", pre_sql="CREATE TABLE IF NOT EXISTS etl_resume (id int) USING parquet")
    run(spark, task, NOW, state)
    spark.createDataFrame([(1,), (2,), (3,)], "id int").createOrReplaceTempView("feed")
    assert run(spark, task, NOW, state).rows == 1 and rows(spark.table("etl_resume")) == [(1,), (2,), (3,)]
    spark.createDataFrame([(4,), (4,)], "id int").createOrReplaceTempView("feed")
    with pytest.raises(EtlError, match="repeated"):
        run(spark, task, NOW, state)
    with pytest.raises(EtlError):
        run(spark, EtlTask("r", "SELECT 1 AS id", "etl_resume", "UPSERT", resume_key="id", upsert_keys=["id"]), NOW)
    codes = {c for c, _, _ in precheck(spark, EtlTask("p", "SELECT 1 AS id, 2 AS more", "etl_resume", "UPSERT", upsert_keys=["more"]), NOW)}
    assert codes == {"UPSERT_KEY_NOT_IN_TARGET", "COLUMN_SKIPPED"}
    assert precheck(spark, EtlTask("p", "SELECT nope FROM feed", "etl_resume"), NOW)[0][0] == "SOURCE"


def test_batch_goes_on_after_a_failure():
    def execute(task):
        if task.name == "b":
            raise ValueError("no")
        return EtlResult(task.name, "SUCCESS")

    tasks = [(i, EtlTask(n, "", "")) for i, n in ((3, "c"), (2, "b"), (1, "a"), (4, "d"))]
    assert [(r.task, r.status) for r in run_batch(tasks, execute, ["d"])] == [("a", "SUCCESS"), ("b", "FAILED"), ("c", "SUCCESS"), ("d", "SKIPPED")]


def test_cycles(spark, tmp_path):
    state, target = StateStore(spark, str(tmp_path / "state")), VersionedTable(spark, str(tmp_path), "items")
    plan = TablePlan("items", ["id"], rules=[Rule("ITEMS", "name", "UPPER")], deletes=True)
    make = lambda *r: spark.createDataFrame([(i, n, u and datetime(2024, 1, 1, 0, 0, u)) for i, n, u in r], "id int, name string, updated_at timestamp_ntz")
    first = run_cycle(spark, plan, make((1, "a", 1), (2, "b", 2)), target, state)
    assert first.cursor.column == "updated_at" and first.rows_changed == 2
    second = run_cycle(spark, plan, make((1, "a", 1), (3, "c", 9), (4, "d", None)), target, state)
    assert rows(target.current().select("id", "name")) == [(1, "A"), (3, "C"), (4, "D")] and second.rows_changed == 2 and second.missing == 0
    third = run_cycle(spark, plan, make((1, "a", 1), (3, "c", 9), (4, "d", None), (5, "late", 3)), target, state)
    assert third.missing == 1 and third.repaired == 1 and target.current().count() == 4
    pairs = spark.createDataFrame([("a", "x"), ("b", "X")], "source string, target string")
    assert [c for c, _, _ in sync_precheck(pairs, [TableShape("t", target.current().schema.__class__([])), TableShape("i", make((1, "a", 1)).select("id").schema, ["id"])], {})] == ["MAPPING_CONFLICT", "NO_CURSOR", "MISSES_UPDATES"]


def test_chunked_load_resumes(spark, tmp_path):
    state, source = StateStore(spark, str(tmp_path / "state")), spark.range(1, 11)
    state.write("chunks-t", {"done": [0]})
    assert chunked_load(spark, source, "id", [(None, 5), (5, None)], str(tmp_path / "out"), state, "t") == 1
    assert chunked_load(spark, source, "id", [(None, 5), (5, None)], str(tmp_path / "out"), state, "t") == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_stream_is_folded_and_merged_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    write = lambda n, *r: (log / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "id", "old_id", "op", "v"), x))) for x in r))
    table = VersionedTable(spark, str(tmp_path), "orders")
    apply = merge_batch(table, ["id"], ["seq"], ["old_id"])
    schema = "seq int, id int, old_id int, op int, v string"
    write(1, (1, 1, None, 2, "a"), (2, 2, None, 2, "b"), (3, 2, None, 1, "b"), (4, 3, None, 2, "c"))
    follow(spark, str(log), schema, apply, str(tmp_path / "cp")).awaitTermination()
    assert rows(table.current().select("id", "v")) == [(1, "a"), (3, "c")]
    write(2, (5, 9, 3, 4, "moved"), (6, 1, None, 4, "a2"))
    follow(spark, str(log), schema, apply, str(tmp_path / "cp")).awaitTermination()
    assert rows(table.current().select("id", "v")) == [(1, "a2"), (9, "moved")]
    apply(spark.createDataFrame([(1, 1, None, 1, "x")], schema), 0)
    assert table.current().count() == 2


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:round;create=true"
    try:
        jdbc.write_table(spark.range(1, 101).select(F.col("id").cast("int").alias("ID"), F.lit("x").alias("NAME")), url, "ITEMS", "overwrite")
    except Exception as e:
        pytest.skip(f"no embedded database: {e}")
    bounds = jdbc.key_bounds(spark, url, "ITEMS", "ID")
    df = jdbc.read_table(spark, url, "ITEMS", "ID", bounds, 4)
    assert bounds == (1, 100) and df.count() == 100 and df.rdd.getNumPartitions() == 4 and jdbc.describe(spark, url, "ITEMS").names == ["ID", "NAME"]


def test_catalogue(spark):
    spark.range(7).write.mode("overwrite").saveAsTable("sized")
    catalog.analyse(spark, "sized")
    assert "sized" in catalog.list_tables(spark) and catalog.estimated_rows(spark, "sized") == 7


def test_documents(spark):
    docs = spark.createDataFrame([('{"b":1,"_id":{"$oid":"a1"},"A":{"$numberDecimal":"1.5"},"t":{"$timestamp":{"t":1,"i":2}},"x":[1]}',), ('{"b":null,"A":2,"t":5000000000}',)], "doc string")
    assert documents.inferred(docs) == [("_id", "ObjectId", "string"), ("A", "Decimal128", "decimal(38,10)"), ("b", "Int32", "int"), ("t", "BsonTimestamp", "bigint"), ("x", "Array", "string")]
    got = documents.rendered(docs, "doc", documents.inferred(docs)).collect()
    assert got[0]["_id"] == "a1" and got[0]["t"] == (1 << 32) + 2 and got[1]["t"] == 5_000_000_000 and got[1]["b"] is None and got[0]["x"] == "[1]"
    with pytest.raises(documents.DocumentError):
        documents.inferred(spark.createDataFrame([('{"a":1,"A":2}',)], "doc string"))
    for bad in ('{"$where":"1"}', "[1]", "{", '{"a":' * 40 + "1" + "}" * 40):
        with pytest.raises(documents.DocumentError):
            documents.parse_filter(bad)


def test_migration_rules():
    assert migration.target_name("i", "PREFIX", "n_") == "n_i" and migration.chosen([".sys", "a1", "b1"], "a*,.sys") == [".sys", "a1"]
    assert migration.clean_settings({"index": {"uuid": 1, "number_of_shards": 2}}) == {"index": {"number_of_shards": 2}}
    assert migration.verify_count(5, 5, 9, "APPEND") == "OK" and migration.verify_count(5, 5, 6, "OVERWRITE") == "FAILED"


def test_alert_state_follows(spark):
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    signals = spark.createDataFrame([("DATA_DRIFT", "t", "x"), ("DATA_DRIFT", "t", "y")], "category string, subject string, detail string")
    sent, state = alerts.evaluate(signals, spark.createDataFrame([], alerts.STATE), now, 60)
    assert sent.count() == 1 and state.count() == 1
    quiet, kept = alerts.evaluate(signals, state, now, 60)
    assert quiet.count() == 0 and kept.count() == 1
    over, empty = alerts.evaluate(signals.limit(0), state, now, 60)
    assert over.first().event == "RECOVERED" and empty.count() == 0


def test_documents_move(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a"), ("2", None)], "_id string, v string")
    assert migration.move_documents(spark, docs, str(tmp_path / "out"), "OVERWRITE") == {"written": 2, "status": "OK", "sampled": 2, "differing": 0}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        migration.move_documents(spark, docs, str(tmp_path / "out"), "FAIL_IF_EXISTS")
    spark.sql("DROP TABLE IF EXISTS moved")
    texts = spark.createDataFrame([('{"_id":1,"n":2}',), ('{"_id":2,"n":2.5}',)], "doc string")
    made = migration.collection_to_table(spark, texts, "moved", "APPEND", where='{"n":{"$gt":2}}')
    assert made == {"columns": ["_id", "n"], "written": 1, "status": "OK"} and rows(spark.table("moved")) == [(2, 2.5)]


def test_recovery(spark, tmp_path):
    from itertools import islice

    from tidemark.streaming import recovery

    assert [recovery.failure_class(t) for t in ("binlog has been purged", "Access denied for x", "[TABLE_OR_VIEW_NOT_FOUND] t", "Unknown column 'a'", "reset by peer")] == ["PURGED", "AUTH", "TARGET_TABLE_MISSING", "SCHEMA_DRIFT", "TRANSIENT"]
    assert list(islice(recovery.waits(), 8)) == [1, 2, 4, 8, 16, 32, 60, 60] and not recovery.may_retry("AUTH")
    gate = recovery.RepairGate()

    def fail():
        raise ValueError

    for _ in range(3):
        with pytest.raises(ValueError):
            gate.try_repair("t", fail)
    assert not gate.try_repair("t", fail) and gate.try_repair("u", lambda: None) and gate.attempts == {"t": 3}
    table = VersionedTable(spark, str(tmp_path), "b")
    log = spark.createDataFrame([(3,), (9,)], "seq int")
    assert recovery.baseline(spark.range(4), table, recovery.last_position(log)) == 9 and table.current().count() == 4


def test_structure_follows_a_diff(spark):
    from pyspark.sql import types as T

    from tidemark.plans import structure

    spark.sql("DROP TABLE IF EXISTS shaped")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    spark.sql("CREATE TABLE shaped (a BIGINT) USING parquet")
    spark.sql("INSERT INTO shaped VALUES (1), (2)")
    changes = [("TABLE", "CREATE", "shaped", None), ("COLUMN", "ALTER", "shaped", "a"), ("TABLE", "DROP", "shaped", None), ("COLUMN", "CREATE", "gone", "x"), ("INDEX", "CREATE", "shaped", None), ("COLUMN", "DROP", "shaped", "b")]
    wanted = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    schemas = {"shaped": wanted, "gone": T.StructType([T.StructField("x", T.LongType())])}
    done = structure.apply(spark, changes, schemas)
    assert [d.split(":")[0] for _, d in done] == ["APPLIED", "APPLIED", "SKIPPED", "FAILED", "SKIPPED", "SKIPPED"] and dict(spark.table("shaped").dtypes) == {"a": "string", "b": "string"}
    assert rows(spark.table("shaped")) == [("1", None), ("2", None)]
    assert structure.apply(spark, [("COLUMN", "DROP", "shaped", "B")], schemas, allow_drop=True)[0][1] == "APPLIED" and spark.table("shaped").columns == ["a"]


def test_boundaries_come_back_as_they_were():
    from decimal import Decimal

    from tidemark.operators.scan import boundary_text, boundary_values

    key = [1, "x", datetime(2024, 1, 1, 0, 0, 0, 123456), Decimal("1.50"), b"\x00\xff", None]
    assert boundary_values(boundary_text(key)) == key
