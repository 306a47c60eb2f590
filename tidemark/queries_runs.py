"""Queries that run tasks, loads, cycles, streams and moves end to end, and read back what they leave."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .etl import runner
from .functions import cleanse, rendering
from .operators import capture, cursor, fold, merge, metrics, objects, scan
from .parsers import binlog, redo, test_decoding, transactions
from .plans import structure, sync
from .projection import cache, migration
from .queries import _APPLIED, _LOG, _REPLICA, LOW, change_log, query, read, replica, stamp
from .sources import catalog, jdbc
from .sources.state import StateStore
from .streaming import cdc, recovery

NOW = datetime(2024, 3, 1, 8)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor sees."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/tidemark-runs/{name}-{uuid.uuid4().hex}"


def _fresh(spark: SparkSession, name: str) -> str:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return name


# tables, choice and routing ----------------------------------------------------------------------

_KINDS = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"
_PLAIN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_PLAIN_SQL = ", ".join(f"'{t}'" for t in _PLAIN)


@query(f"SELECT table_name, column_name, ordinal_position::INTEGER AS ordinal, {_KINDS} AS type_name FROM information_schema.columns WHERE table_name IN ({_PLAIN_SQL})")
def table_columns(spark, sf_dir):
    """Tables of a catalogue and their columns."""
    spark.sql("CREATE DATABASE IF NOT EXISTS tidemark_list")
    for t in _PLAIN:
        spark.sql(f"DROP TABLE IF EXISTS tidemark_list.{t}")
        read(spark, sf_dir, t).limit(0).write.saveAsTable(f"tidemark_list.{t}")
    rows = [(t, f.name, i + 1, f.dataType.simpleString()) for t, schema in catalog.describe_all(spark, "tidemark_list").items() for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, type_name string")


@query("SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'part', (SELECT count(*) FROM part) UNION ALL SELECT 'never', NULL")
def row_estimates(spark, sf_dir):
    """Rows by catalogue statistics; none for a table that was never analysed."""
    out = []
    for t in ("customer", "part"):
        name = _fresh(spark, f"tidemark_est_{t}")
        read(spark, sf_dir, t).write.saveAsTable(name)
        catalog.analyse(spark, name)
        out.append((t, catalog.estimated_rows(spark, name)))
    never = _fresh(spark, "tidemark_est_never")
    spark.sql(f"CREATE TABLE {never} (a INT) USING parquet")
    return spark.createDataFrame([*out, ("never", catalog.estimated_rows(spark, never))], "table_name string, rows long")


_KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"], "nation": ["n_name"], "events": [], "part": ["p_partkey"]}


@query("""
    WITH k AS (SELECT * FROM (VALUES ('orders', 'o_orderkey', 1), ('lineitem', 'l_orderkey', 2), ('customer', 'c_custkey', 1), ('nation', 'n_name', 1), ('events', NULL, 0), ('part', 'p_partkey', 1)) t(table_name, first_key, parts))
    SELECT k.table_name, CASE WHEN parts = 0 THEN 'STREAMING_FALLBACK' WHEN parts = 1 AND data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'KEYSET_NUMERIC' ELSE 'KEYSET_COMPOSITE' END AS route,
           CASE WHEN parts = 0 THEN 1 ELSE 6 END AS parallelism
    FROM k LEFT JOIN information_schema.columns c ON c.table_name = k.table_name AND c.column_name = k.first_key
""")
def load_routes(spark, sf_dir):
    found = [(t, *_route(scan.load_route(read(spark, sf_dir, t).schema, key, 6))) for t, key in _KEYS.items()]
    return spark.createDataFrame(found, "table_name string, route string, parallelism int")


def _route(r: scan.Route) -> tuple[str, int]:
    return r.kind, r.parallelism


@query("""
    WITH n AS (SELECT o_orderkey, o_orderdate, ntile(12) OVER (ORDER BY o_orderdate, o_orderkey) AS bucket FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o_orderdate, o_orderkey) AS rn FROM n)
    SELECT bucket::INTEGER AS bucket, o_orderdate AS moment, o_orderkey AS k FROM r WHERE rn = 1
""")
def boundaries_restored(spark, sf_dir):
    """Boundaries of two columns, written to a checkpoint as text and read back."""
    found = scan.sampled_boundaries(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 12).collect()
    texts = [(r.bucket, scan.boundary_text([r.o_orderdate, r.o_orderkey])) for r in found]
    return spark.createDataFrame([(b, *scan.boundary_values(t)) for b, t in texts], "bucket int, moment timestamp_ntz, k long")


@query("""
    WITH RECURSIVE c AS (SELECT * FROM (SELECT 'orders' AS t, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'customer', (SELECT count(*) FROM customer)
            UNION ALL SELECT 'part', (SELECT count(*) FROM part) UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier) UNION ALL SELECT 'events', (SELECT count(*) FROM events) UNION ALL SELECT 'nation', (SELECT count(*) FROM nation))),
        o AS (SELECT *, row_number() OVER (ORDER BY n DESC, t) AS i FROM c),
        p(i, a, b, t, n, bin) AS (
            SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::INTEGER
            UNION ALL SELECT o.i, p.a + CASE WHEN p.a <= p.b THEN o.n ELSE 0 END, p.b + CASE WHEN p.a <= p.b THEN 0 ELSE o.n END, o.t, o.n, CASE WHEN p.a <= p.b THEN 0 ELSE 1 END FROM p JOIN o ON o.i = p.i + 1
        )
    SELECT bin, t AS table_name, n AS rows FROM p WHERE i > 0
""")
def load_plan(spark, sf_dir):
    """Tables packed by their row counts, largest first, written as a plan and read back."""
    tables = ("orders", "lineitem", "customer", "part", "supplier", "events", "nation")
    items = [objects.Item(t, read(spark, sf_dir, t).count()) for t in tables]
    path = _folder(spark, "plan")
    catalog.write_plan(spark.createDataFrame(objects.plan_rows(objects.pack(items, 2)), "bin int, table_name string, rows long"), path)
    return spark.read.option("header", True).schema("bin int, table_name string, rows long").csv(path)


@query("SELECT n_name AS source, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS target, starts_with('.' || n_name, '.') AS system FROM nation WHERE n_nationkey IN (1, 3, 7)")
def object_selection(spark, sf_dir):
    """Tables that a selection names in any case, their target names, and the guard for a system's own."""
    names = {r.n_nationkey: r.n_name for r in read(spark, sf_dir, "nation").collect()}
    wanted = objects.selected(list(names.values()), [names[1].lower(), names[3].upper(), names[7]])
    rows = spark.createDataFrame([(n, objects.mapped(n, {names[3].lower(): "renamed"})) for n in wanted], "source string, target string")
    return rows.withColumn("system", objects.is_system_index(F.concat(F.lit("."), "source")))


@query("""
    WITH k AS (SELECT * FROM (VALUES (0, 'lineitem', NULL), (1, 'orders', 'orderkey'), (2, 'customer', 'custkey'), (3, 'region', 'regionkey'), (4, 'part', 'partkey'), (5, 'nation', 'nationkey')) t(place, table_name, own)),
         f AS (SELECT k.table_name, k.place, count(o.own) AS n FROM k JOIN information_schema.columns c ON c.table_name = k.table_name LEFT JOIN k o ON o.own = split_part(c.column_name, '_', 2) AND o.table_name <> k.table_name GROUP BY 1, 2)
    SELECT (row_number() OVER (ORDER BY n, place) - 1)::INTEGER AS place, table_name FROM f
""")
def by_dependencies(spark, sf_dir):
    """Tables by the number of their foreign keys, found as columns that bear another table's key."""
    keys = {"region": "regionkey", "nation": "nationkey", "customer": "custkey", "part": "partkey", "orders": "orderkey"}
    tables = ["lineitem", "orders", "customer", "region", "part", "nation"]
    columns = {t: {c.split("_", 1)[1] for c in read(spark, sf_dir, t).columns} for t in tables}
    foreign = {t: [k for o, k in keys.items() if o != t and k in columns[t]] for t in tables}
    return spark.createDataFrame(list(enumerate(objects.by_dependencies(tables, foreign))), "place int, table_name string")


@query("SELECT * FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders) OR o_orderdate IS NULL")
def initial_load_bound(spark, sf_dir):
    """The first copy of a table ends at a watermark that was read before."""
    orders = read(spark, sf_dir, "orders")
    high = orders.agg(F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).first()[0]
    return orders.where(cursor.initial_bound("o_orderdate", high))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def pruned_columns(spark, sf_dir):
    """Columns that the target lacks are left out, in any case of letters."""
    return merge.prune_to(read(spark, sf_dir, "orders"), ["O_ORDERKEY", "o_totalprice", "other"], ["o_orderkey"])


@query("SELECT c_custkey, sha256('s:' || c_name) AS c_name, 'c_name' AS hashed, 'c_custkey' AS changed_key FROM customer")
def hashed_columns(spark, sf_dir):
    """Hashed columns are left out of audits, and a key that a rule changes can't be compared."""
    rules = [cleanse.Rule("customer", "c_name", "HASH_SHA256", "s"), cleanse.Rule("CUSTOMER", "C_CUSTKEY", "TRIM"), cleanse.Rule("orders", "o_orderkey", "TRIM")]
    rows = cleanse.cleanse(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "customer", rules[:1])
    changed = cleanse.cleansed_keys("customer", ["c_custkey"], rules)
    return rows.select("c_custkey", "c_name", F.lit(",".join(sorted(cleanse.hashed_columns("customer", rules)))).alias("hashed"), F.lit(",".join(sorted(changed)).lower()).alias("changed_key"))


@query("SELECT 'empty' AS target, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'index', o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'held', o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'held', -1, 0.0 UNION ALL SELECT 'refused', NULL, NULL")
def initial_loads(spark, sf_dir):
    """A first copy goes straight into an empty table, by key into one with rows or with another unique index, and is refused without a key."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    empty = orders.limit(0)
    held = orders.where("o_orderkey < 100").withColumn("o_totalprice", F.lit(0.0)).unionByName(spark.createDataFrame([(-1, 0.0)], "o_orderkey long, o_totalprice double"))
    out = [("empty", merge.initial_load(empty, orders, [])), ("index", merge.initial_load(empty, orders, ["o_orderkey"], True)), ("held", merge.initial_load(held, orders, ["o_orderkey"]))]
    try:
        merge.initial_load(held, orders, [])
    except merge.MergeRefused:
        out.append(("refused", spark.createDataFrame([(None, None)], "o_orderkey long, o_totalprice double")))
    made = [rows.select(F.lit(name).alias("target"), "o_orderkey", "o_totalprice") for name, rows in out]
    result = made[0]
    for m in made[1:]:
        result = result.unionByName(m)
    return result


# cursors and capture -----------------------------------------------------------------------------


@query("""
    SELECT 'orders' AS table_name, 'TIMESTAMP' AS kind, 'o_orderdate' AS column_name, TRUE AS sees_updates UNION ALL SELECT 'lineitem', 'NONE', NULL, FALSE WHERE (SELECT count(*) FROM lineitem) > 20000
    UNION ALL SELECT 'lineitem', 'FULL_COMPARE', NULL, TRUE WHERE (SELECT count(*) FROM lineitem) <= 20000 UNION ALL SELECT 'part', 'IDENTITY', 'p_partkey', FALSE UNION ALL SELECT 'events', 'TIMESTAMP', 'UPDATED_AT', TRUE
    UNION ALL SELECT 'nation', 'FULL_COMPARE', NULL, TRUE UNION ALL SELECT 'region', 'ROW_SCN', 'ORA_ROWSCN', TRUE
""")
def cursor_choice(spark, sf_dir):
    """The cursor of each table: configured, hinted, by change number, by key, or all rows of a small table."""
    shape = lambda t, key=(), df=None, **more: cursor.TableShape(t, (df if df is not None else read(spark, sf_dir, t)).schema, key, (df if df is not None else read(spark, sf_dir, t)).count(), **more)
    events = read(spark, sf_dir, "events").withColumnRenamed("ts", "UPDATED_AT")
    made = {
        "orders": cursor.choose_cursor(shape("orders", ["o_orderkey"]), "O_ORDERDATE"), "lineitem": cursor.choose_cursor(shape("lineitem", ["l_orderkey", "l_linenumber"])), "part": cursor.choose_cursor(shape("part", ["p_partkey"])),
        "events": cursor.choose_cursor(shape("events", ["event_id"], events)), "nation": cursor.choose_cursor(shape("nation")), "region": cursor.choose_cursor(shape("region", ["r_regionkey"], row_level_scn=True)),
    }
    return spark.createDataFrame([(t, c.kind, c.column, c.sees_updates) for t, c in made.items()], "table_name string, kind string, column_name string, sees_updates boolean")


@query("""SELECT * FROM (VALUES ('mysql', 'BINLOG_CDC,FULL_COMPARE,POLLING', 0), ('oracle', 'FULL_COMPARE,POLLING', 1), ('postgres', 'FULL_COMPARE,PG_LOGICAL_CDC,POLLING', 0), ('sqlserver', 'FULL_COMPARE,POLLING,SQLSERVER_CDC', 0), ('yashan', 'FULL_COMPARE,POLLING', 1)) t(source, offered, problems)""")
def capture_strategies(spark, sf_dir):
    """Strategies that each source can be captured with, by its settings, and what its own log strategy lacks."""
    settings = {
        "mysql": {"LOG_BIN": "on", "binlog_format": "ROW", "binlog_row_image": "full"}, "oracle": {"log_mode": "NOARCHIVELOG", "supplemental_log_data_min": "YES"}, "postgres": {"wal_level": "logical", "replication": "on"},
        "sqlserver": {"agent": "Running", "is_cdc_enabled": "1"}, "yashan": {},
    }
    own = {s.value: s for s in capture.Strategy if s.follows_log}
    rows = [(s, ",".join(sorted(x.name for x in capture.offered(s, given))), len(capture.probe(own[s], s, given))) for s, given in settings.items()]
    return spark.createDataFrame(rows, "source string, offered string, problems int")


@query("SELECT 'text' AS column_name, count(*) FILTER (WHERE strlen(text) > 2000) AS rows, max(strlen(text))::INTEGER AS largest FROM documents")
def large_values(spark, sf_dir):
    """Columns that must be read whole, with values over the limit."""
    return capture.over_size(read(spark, sf_dir, "documents"), ["text", "lang"], 2000)


@query("""SELECT * FROM (VALUES ('id', 'INLINE'), ('note', 'STREAMED'), ('body', 'STREAMED'), ('small', 'INLINE'), ('unknown', 'INLINE')) t(column_name, mode)""")
def read_modes(spark, sf_dir):
    modes = capture.read_modes({"id": 40, "note": 9000, "body": 10, "small": 100, "unknown": None}, large=["BODY"], whole=["ID"])
    return spark.createDataFrame(list(modes.items()), "column_name string, mode string")


# runs --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey < 900")
def etl_run_upsert(spark, sf_dir):
    """A whole run: target made, statements before and after, rows merged by key; the last of the query's rows wins."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    target = _fresh(spark, "tidemark_upsert")
    pre = f"CREATE TABLE {target} (o_orderkey BIGINT, o_totalprice DOUBLE) USING parquet; INSERT INTO {target} SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey < 900"
    source = "SELECT o_orderkey, price AS o_totalprice, 'x' AS dropped FROM (SELECT o_orderkey, o_totalprice + 5 AS price, 1 AS place FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 2 FROM orders WHERE o_orderkey % 3 = 0) ORDER BY place"
    runner.run(spark, runner.EtlTask("u", source, target, "UPSERT", pre_sql=pre, post_sql="SELECT 1", upsert_keys=["O_ORDERKEY"]), NOW)
    return spark.table(target)


@query("""
    SELECT o_orderkey, 'new' AS v FROM orders UNION ALL SELECT o_orderkey + 100000000, 'kept' FROM orders WHERE o_orderkey % 50 = 0
""")
def etl_range_overwrite_resumed(spark, sf_dir):
    """A range overwrite that is resumed: the first run deletes the range and writes half of it, the second adds the rest and deletes nothing."""
    orders, target = read(spark, sf_dir, "orders").select("o_orderkey"), _fresh(spark, "tidemark_range")
    half = orders.agg(F.expr("median(o_orderkey)")).first()[0]
    old = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("old").alias("v"))
    old.unionByName(orders.where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), F.lit("kept").alias("v"))).write.saveAsTable(target)
    state = StateStore(spark, _folder(spark, "state"))
    task = runner.EtlTask("r", "SELECT o_orderkey, 'new' AS v FROM feed", target, "RANGE_OVERWRITE", range_condition="o_orderkey < 100000000", resume_key="o_orderkey")
    for seen in (orders.where(F.col("o_orderkey") <= half), orders):
        seen.createOrReplaceTempView("feed")
        with state.lease("r") as lease:
            runner.run(spark, task, NOW, state, lease)
    return spark.table(target)


@query("SELECT event_id, user_id FROM events WHERE event_id <= 400")
def etl_append_resumed(spark, sf_dir):
    """An append that is resumed twice takes each row once."""
    events, target = read(spark, sf_dir, "events").select("event_id", "user_id"), _fresh(spark, "tidemark_append")
    state = StateStore(spark, _folder(spark, "state"))
    task = runner.EtlTask("a", "SELECT event_id, user_id FROM feed", target, "APPEND", resume_key="event_id", pre_sql=f"CREATE TABLE {target} (event_id BIGINT, user_id BIGINT) USING parquet")
    for upto in (150, 150, 400):
        events.where(F.col("event_id") <= upto).createOrReplaceTempView("feed")
        runner.run(spark, task, NOW, state)
    return spark.table(target)


@query("SELECT * FROM (VALUES ('a', 'SUCCESS', 5), ('b', 'FAILED', 0), ('c', 'SKIPPED', 0), ('d', 'SUCCESS', 25)) t(task, status, rows)")
def etl_batch(spark, sf_dir):
    """A batch in the order of its ids: one that fails doesn't stop the others, one that is running is skipped."""
    for t in ("region", "nation"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    tasks = [(4, "d", "SELECT * FROM nation"), (2, "b", "SELECT nothing FROM region"), (1, "a", "SELECT * FROM region"), (3, "c", "SELECT 1 AS x")]
    made = [(i, runner.EtlTask(n, sql, _fresh(spark, f"tidemark_batch_{n}"))) for i, n, sql in tasks]
    done = runner.run_batch(made, lambda t: runner.run(spark, t, NOW), running=["c"])
    return spark.createDataFrame([(r.task, r.status, r.rows) for r in done], "task string, status string, rows int")


@query("SELECT * FROM (VALUES ('COLUMN_SKIPPED', 'n_comment', 'WARNING'), ('UPSERT_KEY_NOT_IN_RESULT', 'id', 'ERROR'), ('UPSERT_KEY_NOT_IN_TARGET', 'id', 'ERROR')) t(code, object, level)")
def etl_precheck(spark, sf_dir):
    """What a run would meet; no row is read."""
    nation = read(spark, sf_dir, "nation")
    nation.select("*", F.lit("").alias("n_comment")).createOrReplaceTempView("nation_c")
    target = _fresh(spark, "tidemark_precheck")
    nation.limit(0).write.saveAsTable(target)
    return spark.createDataFrame(runner.precheck(spark, runner.EtlTask("p", "SELECT * FROM nation_c", target, "UPSERT", upsert_keys=["id"]), NOW), "code string, object string, level string")


@query("SELECT 7 AS last, TRUE AS once, 3 AS other, TRUE AS repeated")
def resume_boundary(spark, sf_dir):
    """A run goes on after a key that occurs once; after one that repeats rows could be lost."""
    events = read(spark, sf_dir, "events")
    return spark.createDataFrame([(7, runner.boundary_is_unique(events, "event_id", 7), 3, not runner.boundary_is_unique(events, "user_id", events.groupBy("user_id").count().where("count > 1").first().user_id))], "last int, once boolean, other int, repeated boolean")


@query("SELECT * FROM orders")
def chunked_load(spark, sf_dir):
    """A load in ranges, several at once: cut short after half of them, then resumed; every row comes once."""
    orders, folder = read(spark, sf_dir, "orders"), _folder(spark, "chunks")
    state = StateStore(spark, f"{folder}-state")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    ranges = scan.split_ranges(low, high, 6)
    sync.chunked_load(spark, orders, "o_orderkey", ranges[:3], folder, state, "orders")
    sync.chunked_load(spark, orders, "o_orderkey", ranges, folder, state, "orders")
    return spark.read.parquet(folder).drop("range")


@query("SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority, o_totalprice, o_orderdate FROM orders")
def polling_cycles(spark, sf_dir):
    """Two polling cycles of a table: the first copies what is older, the second takes what changed since; rows that the source lost go."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    folder = _folder(spark, "cycle")
    state, target = StateStore(spark, f"{folder}/state"), cdc.VersionedTable(spark, folder, "orders")
    plan = sync.TablePlan("orders", ["o_orderkey"], "o_orderdate", rules=[cleanse.Rule("orders", "o_orderpriority", "UPPER")], deletes=True, content_sample=50)
    older = replica(orders).where(F.col("o_orderdate") <= F.lit(LOW)).unionByName(orders.where("o_orderkey = -5"))
    sync.run_cycle(spark, plan, older, target, state)
    state.write("cursor-orders", {"last": {"moment": datetime(1900, 1, 1).isoformat()}, "column": "o_orderdate", "kind": "TIMESTAMP"})
    done = sync.run_cycle(spark, plan, orders, target, state)
    if done.missing or done.surplus or done.mismatched:
        raise ValueError(done)
    return target.current()


@query("SELECT 'part.p_brand' AS object, 'COLUMN_SKIPPED' AS code UNION ALL SELECT 'part.filled', 'NOT_NULL_UNFED' UNION ALL SELECT 'nation', 'TARGET_MISSING' UNION ALL SELECT 'events', 'NO_KEY' UNION ALL SELECT 'wal_level is minimal, logical is needed', 'CAPTURE'")
def log_precheck(spark, sf_dir):
    """What a project that follows a log would meet, at its targets too."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand").schema
    shapes = [cursor.TableShape("part", part, ["p_partkey"]), cursor.TableShape("nation", read(spark, sf_dir, "nation").schema, ["n_nationkey"]), cursor.TableShape("events", read(spark, sf_dir, "events").schema)]
    targets = {"PART": T.StructType([part["p_partkey"], T.StructField("filled", T.LongType(), False)]), "events": read(spark, sf_dir, "events").schema}
    pairs = spark.createDataFrame([("part", "part"), ("nation", "nation")], "source string, target string")
    found = sync.precheck(pairs, shapes, {}, targets, capture.Strategy.PG_LOGICAL_CDC, "postgres", {"wal_level": "minimal", "replication": "on"})
    return spark.createDataFrame([(o, c) for c, o, _ in found], "object string, code string")


@query("SELECT max(o_orderkey) + 1 AS next_key FROM orders")
def identity_reseeded(spark, sf_dir):
    """Generated keys go on behind those that a first copy brought."""
    from .dialect import types

    _drop_derby(spark, "SEED_T")
    jdbc.execute(spark, _URL, "CREATE TABLE SEED_T (ID BIGINT GENERATED BY DEFAULT AS IDENTITY, V INT)", **_DRIVER)
    largest = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    jdbc.execute(spark, _URL, types.reseed("derby", "SEED_T", "ID", largest), "INSERT INTO SEED_T (V) VALUES 1", **_DRIVER)
    return jdbc.read_table(spark, _URL, "SEED_T", **_DRIVER).select(F.col("ID").alias("next_key"))


@query("SELECT * FROM (VALUES ('MAPPING_CONFLICT', 'X', 'ERROR'), ('MISSES_UPDATES', 'part', 'WARNING'), ('NO_CURSOR', 'lineitem', 'WARNING')) t(code, object, level)")
def project_precheck(spark, sf_dir):
    pairs = spark.createDataFrame([("a", "x"), ("b", "X"), ("c", "y")], "source string, target string")
    shapes = [cursor.TableShape("part", read(spark, sf_dir, "part").schema, ["p_partkey"], 10**6), cursor.TableShape("lineitem", read(spark, sf_dir, "lineitem").schema, (), 10**6)]
    return spark.createDataFrame(sync.precheck(pairs, shapes, {}), "code string, object string, level string")


# change streams ----------------------------------------------------------------------------------

_STREAMED = "seq long, user_id long, op int, event_type string, value double, ddl string, note string"


@query(_APPLIED)
def cdc_baseline_then_replay(spark, sf_dir):
    """A copy of a table, then its log from a position that was taken before the copy: what both have comes out once."""
    log = change_log(read(spark, sf_dir, "events")).withColumn("seq", F.struct("ts", "event_id"))
    key, order = ["user_id"], ["ts", "event_id"]
    folder = _folder(spark, "replay")
    table = cdc.VersionedTable(spark, folder, "users")
    base = fold.fold_aggregated(log.where("event_id <= 2000").drop("seq"), key, order).where(F.col("op") != fold.DELETE).select("user_id", "event_type", "value")
    recovery.baseline(base, table, recovery.last_position(read(spark, sf_dir, "events").where("event_id <= 1900"), "event_id"))
    later = log.where("event_id > 2000").drop("seq")
    apply = cdc.merge_batch(table, key, order)
    apply(later, 0)
    apply(later, 0)  # delivered twice
    return table.current()


@query("""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id < 600)
    SELECT user_id, event_type, CASE WHEN event_id >= 300 THEN 'n' || event_id END AS note FROM f WHERE rn = 1 AND event_type <> 'error'
""")
def cdc_stream_with_ddl(spark, sf_dir):
    """Change files followed as a stream; half-way the log adds a column, which the target gets before the rows that have it."""
    e = read(spark, sf_dir, "events")
    folder = _folder(spark, "stream")
    rows = e.select(F.col("event_id").alias("seq"), "user_id", F.when(F.col("event_type") == "error", fold.DELETE).otherwise(fold.INSERT).alias("op"), "event_type", F.lit(None).cast("string").alias("ddl"))
    change = spark.createDataFrame([(299, None, None, None, "ALTER TABLE users ADD COLUMN note VARCHAR(20) DEFAULT 'x'")], "seq long, user_id long, op int, event_type string, ddl string")
    noted = rows.where("seq >= 300 AND seq < 600").withColumn("note", F.concat(F.lit("n"), "seq"))
    table = cdc.VersionedTable(spark, folder, "users")
    first = rows.where("seq < 300")
    apply = cdc.merge_batch(table, ["user_id"], ["seq"], ddl="ddl")
    for part, schema in ((first, "seq long, user_id long, op int, event_type string, ddl string"), (noted.unionByName(change, allowMissingColumns=True), "seq long, user_id long, op int, event_type string, ddl string, note string")):
        part.coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(f"{folder}/log{len(schema)}")
        cdc.follow(spark, f"{folder}/log{len(schema)}", schema, lambda b, n, s=schema: apply(b, n + len(s)), f"{folder}/cp{len(schema)}").awaitTermination()
    if (table.state.read("ddl-tasks") or {}).get("tasks", [{}])[0].get("gap") is not True:
        raise ValueError("the structure change isn't filed")
    return table.current().select("user_id", "event_type", "note")


@query("""
    SELECT event_id // 10 AS transaction, event_id AS seq, 'c' || event_id AS content FROM events
    WHERE event_id % 10 BETWEEN 1 AND 8 AND (event_id // 10) % 5 <> 4 AND NOT (event_id % 10 BETWEEN 4 AND 5 AND (event_id // 10) % 2 = 0) AND event_id % 10 NOT IN (3, 6)
""")
def transactions_committed(spark, sf_dir):
    """Ten events are a transaction with a savepoint; some go back to it, some are rolled back as a whole."""
    k, tx = F.col("event_id") % 10, F.floor(F.col("event_id") / 10)
    kind = F.when(k == 0, "BEGIN").when(k == 3, "SAVEPOINT").when((k == 6) & (tx % 2 == 0), "ROLLBACK_TO").when(k == 6, "NOTE").when((k == 9) & (tx % 5 == 4), "ROLLBACK").when(k == 9, "COMMIT").otherwise("CHANGE")
    content = F.when(k.isin(3, 6), "s").when(kind == "CHANGE", F.concat(F.lit("c"), F.col("event_id").cast("string")))
    return transactions.committed_changes(read(spark, sf_dir, "events").select(tx.alias("transaction"), F.col("event_id").alias("seq"), kind.alias("kind"), content.alias("content")))


@query("""
    SELECT event_id AS position, 'shop.' || CASE WHEN event_id >= 500 THEN 'b' ELSE 'a' END AS table_name, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 1 END AS op,
           user_id::VARCHAR AS user_id, CASE WHEN event_id % 3 = 1 THEN 'was' END AS before FROM events WHERE event_id NOT IN (0, 500)
""")
def binlog_rows(spark, sf_dir):
    """Row events of a binary log: their table is the one that the last map before them names."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id") % 3
    image = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"))
    old = F.create_map(F.lit("user_id"), F.lit("was"))
    none = F.lit(None).cast("map<string,string>")
    row = F.struct(F.when(k == 1, old).when(k == 2, image).otherwise(none).alias("before"), F.when(k != 2, image).otherwise(none).alias("after"))
    maps = F.col("event_id").isin(0, 500)
    kind = F.when(maps, "TABLE_MAP").when(k == 0, "WRITE_ROWS").when(k == 1, "UPDATE_ROWS").otherwise("DELETE_ROWS")
    events = e.select(F.lit("bin.000009").alias("file"), F.col("event_id").alias("position"), kind.alias("kind"), F.lit(7).cast("long").alias("table_id"), F.when(F.col("event_id") == 0, "shop.a").when(maps, "shop.b").alias("table_name"), F.lit(None).cast("string").alias("sql"), F.array(row).alias("rows"))
    found = binlog.row_changes(events)
    return found.select("position", "table_name", "op", F.col("image")["user_id"].alias("user_id"), F.when(F.col("op") == fold.AFTER, F.col("key_image")["user_id"]).alias("before"))


@query("""
    WITH m AS (SELECT event_id, event_id // 4 AS csn, event_id % 6 AS o FROM events WHERE event_id % 7 <> 0 AND user_id % 2 = 0)
    SELECT csn AS transaction, row_number() OVER (PARTITION BY csn ORDER BY event_id)::INTEGER AS place, 'APP.T' AS table_name, o::INTEGER AS operation, 'sql ' || event_id AS sql FROM m WHERE o IN (1, 2, 3)
    UNION ALL SELECT csn, 0, 'APP.T', 5, 'sql ' || event_id FROM m WHERE o = 5
""")
def redo_drain(spark, sf_dir):
    """A mined redo log of one container: transactions by commit number, structure changes apart, what never committed left out."""
    e = read(spark, sf_dir, "events")
    mined = e.select(
        F.col("event_id").alias("scn"), F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 4)).alias("commit_scn"), F.lit(0).cast("long").alias("rs_id"), (F.col("user_id") % 2).cast("int").alias("container"),
        F.lit("APP.T").alias("table_name"), (F.col("event_id") % 6).cast("int").alias("operation"), F.concat(F.lit("sql "), F.col("event_id").cast("string")).alias("sql"),
    )
    changes, tasks = binlog.drained(mined, ["app.t"], container=0)
    return changes.unionByName(tasks.select(F.col("commit_scn").alias("transaction"), F.lit(0).alias("place"), "table_name", F.lit(5).alias("operation"), "sql"))


@query("SELECT c_custkey, 'INSERT' AS op, c_custkey::VARCHAR AS id, c_name || '''s' AS name, '0a0b' AS raw, NULL::VARCHAR AS gone FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'DELETE', c_custkey::VARCHAR, c_name, NULL, NULL FROM customer WHERE c_custkey % 2 = 1")
def redo_inserts_and_deletes(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    insert = F.concat(F.lit('insert into "APP"."C"("ID","NAME","RAW","GONE") values (\''), k, F.lit("',N'"), "c_name", F.lit("''s',HEXTORAW('0a0b'),NULL);"))
    delete = F.concat(F.lit('delete from "APP"."C" where "ID" = \''), k, F.lit("' and \"NAME\" = '"), "c_name", F.lit("' and \"GONE\" IS NULL and ROWID = 'AAA';"))
    parsed = redo.parse_statements(c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, insert).otherwise(delete).alias("sql")), "sql", "c_custkey", ["ID"])
    row = lambda n: F.col("row")[n]
    return parsed.select("c_custkey", "op", row("ID").alias("id"), row("NAME").alias("name"), row("RAW").alias("raw"), row("GONE").alias("gone"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DELETE' ELSE 'COMMIT' END AS kind, CASE WHEN event_id % 3 < 2 THEN event_id::VARCHAR END AS id, CASE WHEN event_id % 3 = 2 THEN event_id END AS xid FROM events")
def log_inserts_and_deletes(spark, sf_dir):
    e, k = read(spark, sf_dir, "events"), F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('table public."e v": INSERT: id[bigint]:'), k, F.lit(" t[text]:'a b'"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('table public."e v": DELETE: id[bigint]:'), k)).otherwise(F.concat(F.lit("COMMIT "), k))
    parsed = test_decoding.parse_lines(e.select("event_id", line.alias("data")), "data", "event_id")
    return parsed.select("event_id", "kind", F.coalesce(F.col("new")["id"], F.col("old")["id"]).alias("id"), "xid")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '2024-01-0' || (1 + event_id % 9) END AS day, event_id % 2 = 1 AS flag, (event_id % 200)::SMALLINT AS mask FROM events")
def log_values(spark, sf_dir):
    """Dates of year zero become null; bits become booleans and small numbers."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    day = F.when(k % 4 == 0, "0000-00-00").otherwise(F.concat(F.lit("2024-01-0"), (1 + k % 9).cast("string")))
    return e.select("event_id", rendering.zero_date_to_null(day).alias("day"), rendering.bits(k % 2, 1).alias("flag"), rendering.bits(k % 200, 9).cast("smallint").alias("mask"))


@query("SELECT * FROM (VALUES ('PURGED', FALSE), ('AUTH', FALSE), ('TARGET_TABLE_MISSING', TRUE), ('SCHEMA_DRIFT', TRUE), ('TRANSACTION_TOO_LARGE', FALSE), ('TRANSIENT', TRUE)) t(kind, retry)")
def failure_classes(spark, sf_dir):
    texts = ["log was purged", "Access denied for user", "[TABLE_OR_VIEW_NOT_FOUND] x", "unknown column a", "transaction 7 is too large", "connection reset"]
    return spark.createDataFrame([(k, recovery.may_retry(k)) for k in map(recovery.failure_class, texts)], "kind string, retry boolean")


# projections and moves ---------------------------------------------------------------------------


@query(f"""
    WITH {_LOG}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1)
    SELECT CASE WHEN op = 1 THEN 'DEL' ELSE 'SET' END AS command, 'app:users:' || user_id AS key, CASE WHEN op <> 1 THEN event_type END AS event_type FROM f
""")
def cache_commands(spark, sf_dir):
    """Folded changes as commands of a cache."""
    folded = fold.fold_aggregated(change_log(read(spark, sf_dir, "events")), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "op")
    made = cache.commands(folded, "app", "users", ["user_id"])
    return made.select("command", "key", F.get_json_object("value", "$.event_type").alias("event_type"))


@query("SELECT 'app:customer:' || c_custkey AS key FROM customer WHERE c_custkey % 9 = 0")
def cache_sweep(spark, sf_dir):
    """Keys of a projection that a rebuild doesn't write any more."""
    rows = read(spark, sf_dir, "customer")
    held = cache.as_json(rows, "app", "customer", ["c_custkey"]).select("key").unionByName(spark.createDataFrame([("app:other:1",)], "key string"))
    return cache.stale_keys(held, cache.as_json(rows.where("c_custkey % 9 <> 0"), "app", "customer", ["c_custkey"]), "app", "customer").select("key")


@query("SELECT count(*) FILTER (WHERE c_custkey % 4 = 0) AS null_keys, count(*) FILTER (WHERE c_custkey % 4 <> 0 AND strlen('{\"id\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}') > 39) AS oversized, 'c_acctbal' AS vanished FROM customer")
def cache_skipped(spark, sf_dir):
    """Rows that a projection leaves out, and columns whose hash fields would stay for ever."""
    rows = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("id"), "c_name")
    drift = cache.layout_drift(["id", "c_name", "c_acctbal"], rows.columns)
    return cache.skipped(rows, "app", "customer", ["id"], most=39).select("null_keys", "oversized", F.lit(",".join(drift)).alias("vanished"))


@query("SELECT c_custkey AS _id, c_name, c_mktsegment FROM customer")
def index_move(spark, sf_dir):
    """Documents moved to a new index, with its settings cleaned and its name given; counts decide over success."""
    docs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), "c_name", "c_mktsegment")
    folder = _folder(spark, "index")
    settings = migration.clean_settings({"index": {"uuid": "x", "number_of_shards": "3"}})
    told = migration.move_collections(spark, {"customers": docs, ".system": docs}, "cust*", folder, "FAIL_IF_EXISTS", naming="PREFIX", affix="new_")
    if settings != {"index": {"number_of_shards": "3"}} or [(t["target"], t["status"], t["differing"]) for t in told] != [("new_customers", "OK", 0)]:
        raise ValueError(told)
    return spark.read.schema(docs.schema).json(f"{folder}/new_customers")


@query("SELECT 'a' AS name, 'bigint' AS type_name UNION ALL SELECT 'b', 'struct<c:string,d:timestamp>' UNION ALL SELECT 'e', 'array<struct<f:double>>' UNION ALL SELECT 'g', 'string'")
def index_mapping(spark, sf_dir):
    mapping = json.loads('{"properties":{"a":{"type":"long"},"b":{"properties":{"c":{"type":"keyword"},"d":{"type":"date"}}},"e":{"type":"nested","properties":{"f":{"type":"double"}}},"g":{"type":"geo_point"}}}')
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in migration.schema_of_mapping(mapping)], "name string, type_name string")


@query("SELECT 'O' || event_id AS _id, event_type AS kind, value FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'O' || event_id, event_type, value FROM events WHERE event_type = 'click'")
def collection_move(spark, sf_dir):
    """A filtered collection inferred, rendered and written as a table, then appended to."""
    e = read(spark, sf_dir, "events")
    docs = e.select(F.to_json(F.struct(F.concat(F.lit("O"), F.col("event_id").cast("string")).alias("_id"), F.col("event_type").alias("kind"), "value")).alias("doc"))
    table = _fresh(spark, "tidemark_collection")
    for mode, where in (("FAIL_IF_EXISTS", '{"kind": {"$in": ["click", "view"]}}'), ("APPEND", '{"kind": "click"}')):
        told = migration.collection_to_table(spark, docs, table, mode, where=where)
        if told["status"] != "OK":
            raise ValueError(told)
    return spark.table(table)


# over JDBC ---------------------------------------------------------------------------------------

#: A database in the driver's process; rows from and to executors in other processes go through the driver.
_URL = "jdbc:derby:memory:tidemark;create=true"
_DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


#: A database on the driver's disk by application, for tables that its memory needn't hold.
_ON_DISK: dict[str, str] = {}


def _disk_url(spark: SparkSession) -> str:
    """A database in a scratch folder of the driver; Spark deletes the folder when the driver ends."""
    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    if app not in _ON_DISK:
        utils = jvm.org.apache.spark.util.Utils
        folder = utils.createTempDir(utils.getLocalDir(spark.sparkContext._jsc.sc().conf()), "tidemark-derby").getPath()
        _ON_DISK[app] = f"jdbc:derby:{folder}/db;create=true"
    return _ON_DISK[app]


@query(f"WITH {_REPLICA} SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM replica WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def jdbc_upsert(spark, sf_dir):
    """All orders brought into a database table by key, and read back in parallel ranges; rows that only the target has stay."""
    url = _disk_url(spark)
    _drop_derby(spark, "ORDERS_T", url=url)
    jdbc.execute(spark, url, "CREATE TABLE ORDERS_T (O_ORDERKEY BIGINT NOT NULL, O_TOTALPRICE DOUBLE)", **_DRIVER)
    orders = read(spark, sf_dir, "orders")
    there, given = (d.select(F.col("o_orderkey").alias("O_ORDERKEY"), F.col("o_totalprice").alias("O_TOTALPRICE")) for d in (replica(orders), orders))
    # a lost row may have the key of one that is there; the key's index is built once, over rows in its order
    jdbc.write_table(merge.last_per_key(there, ["O_ORDERKEY"], there.columns).sort("O_ORDERKEY"), url, "ORDERS_T", **_DRIVER)
    jdbc.execute(spark, url, "ALTER TABLE ORDERS_T ADD PRIMARY KEY (O_ORDERKEY)", **_DRIVER)
    jdbc.upsert_table(given, url, "ORDERS_T", ["O_ORDERKEY"], "derby", **_DRIVER)
    return jdbc.read_table(spark, url, "ORDERS_T", "O_ORDERKEY", jdbc.key_bounds(spark, url, "ORDERS_T", "O_ORDERKEY", **_DRIVER), 4, **_DRIVER).toDF("o_orderkey", "o_totalprice")


def _drop_derby(spark: SparkSession, *tables: str, url: str = _URL) -> None:
    for t in tables:
        try:
            jdbc.execute(spark, url, f"DROP TABLE {t}", **_DRIVER)
        except Exception as e:
            if "42Y55" not in str(e) and "does not exist" not in str(e):
                raise


@query("""SELECT * FROM (VALUES ('ID', 'BIGINT', FALSE, NULL, 'key'), ('NAME', 'VARCHAR', FALSE, NULL, 'unique'), ('NOTE', 'VARCHAR', TRUE, '''none''', ''), ('PARENT', 'BIGINT', TRUE, NULL, 'MD_P')) t(column_name, type_name, nullable, default_value, role)""")
def jdbc_metadata(spark, sf_dir):
    """Keys, unique indexes, nullability, defaults and foreign keys of a database table."""
    _drop_derby(spark, "MD_T", "MD_P")
    jdbc.execute(spark, _URL, "CREATE TABLE MD_P (ID BIGINT NOT NULL PRIMARY KEY)", "CREATE TABLE MD_T (ID BIGINT NOT NULL PRIMARY KEY, NAME VARCHAR(20) NOT NULL, NOTE VARCHAR(9) DEFAULT 'none', PARENT BIGINT REFERENCES MD_P(ID))", jdbc.index_sql("MD_U", "MD_T", ["NAME"], True), **_DRIVER)
    meta = jdbc.metadata(spark, _URL, "MD_T", **_DRIVER)
    unique = {c[0] for _, u, c in meta.indexes if u and len(c) == 1}
    foreign = dict(meta.foreign_keys)
    role = lambda c: "key" if c in meta.key else "unique" if c in unique and meta.other_unique_index else foreign.get(c, "")
    return spark.createDataFrame([(c[0], c[1], c[4], c[5], role(c[0])) for c in meta.columns], "column_name string, type_name string, nullable boolean, default_value string, role string")


@query("SELECT n_nationkey, n_name FROM nation")
def jdbc_scan(spark, sf_dir):
    """A database table scanned as a stream of rows."""
    _drop_derby(spark, "NATION_T")
    jdbc.write_table(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _URL, "NATION_T", "append", **_DRIVER)
    return jdbc.read_table(spark, _URL, "NATION_T", **_DRIVER).toDF("n_nationkey", "n_name")


# structure and metrics ---------------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice, NULL::BIGINT AS note FROM orders")
def structure_applied(spark, sf_dir):
    """A table brought to a new structure: a column added, one in another type, one gone, an index left out."""
    table = _fresh(spark, "tidemark_shaped")
    read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey").write.saveAsTable(table)
    wanted = T.StructType().add("o_orderkey", T.StringType()).add("o_totalprice", T.DoubleType()).add("note", T.LongType())
    changes = [("COLUMN", "CREATE", table, "note"), ("COLUMN", "ALTER", table, "o_orderkey"), ("COLUMN", "DROP", table, "o_custkey"), ("INDEX", "CREATE", table, None)]
    done = structure.apply(spark, changes, {table: wanted}, allow_drop=True)
    if [d for _, d in done] != ["APPLIED", "APPLIED", "APPLIED", "SKIPPED"]:
        raise ValueError(done)
    return spark.table(table)


@query("""SELECT 'rows{table="' || event_type || '",kind=""} ' || CASE WHEN event_type = 'error' THEN 'NaN' ELSE (count(*)::DOUBLE)::VARCHAR END AS line FROM events GROUP BY event_type""")
def gauge_lines(spark, sf_dir):
    """Gauges as lines for scrapers; what isn't known is NaN."""
    samples = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("table")).agg(F.count("*").alias("n")).select("table", F.lit(None).cast("string").alias("kind"), F.when(F.col("table") != "error", F.col("n")).alias("n"))
    return metrics.exposition(samples, "rows", "n", ["table", "kind"])


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN (event_id % 3) * 100 / (event_id % 5) END AS percent FROM events")
def heap_percent(spark, sf_dir):
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", metrics.heap_percent(k % 3, k % 5).alias("percent"))


@query("""
    WITH c AS (SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'none', 0)
    SELECT table_name, n > 0 AND n / 1000.0 > 0.5 * 5 AS heavy, greatest(5000, 2000 * greatest(1, ceil(n / 1000.0)))::BIGINT AS interval_ms FROM c
""")
def full_compare_load(spark, sf_dir):
    """Whether comparing all rows fits a polling interval of five seconds, and the interval to recommend."""
    counts = {t: read(spark, sf_dir, t).count() for t in ("orders", "lineitem", "nation")} | {"none": 0}
    return spark.createDataFrame([(t, metrics.is_heavy(n, 5000), metrics.recommended_interval_ms(n)) for t, n in counts.items()], "table_name string, heavy boolean, interval_ms long")


@query("SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders) AS target_rows, 'OK' AS status UNION ALL SELECT 'gone', (SELECT count(*) FROM orders), NULL, 'MISSING_TABLE' UNION ALL SELECT 'broken', (SELECT count(*) FROM orders), NULL, 'ERROR'")
def row_counts_with_status(spark, sf_dir):
    orders = lambda: read(spark, sf_dir, "orders")
    broken = lambda: orders().where(F.raise_error(F.lit("no")).cast("boolean"))
    found = [scan.counted_pair(spark, orders, t, n) for n, t in (("orders", orders), ("gone", lambda: spark.table("tidemark_no_such_table")), ("broken", broken))]
    return spark.createDataFrame(found, "table_name string, source_rows long, target_rows long, status string")


_ = stamp
