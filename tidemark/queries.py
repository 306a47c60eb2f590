"""Queries over the given tables, each with the SQL that gives the same rows.

The tables hold no replicas or change logs; both are derived by fixed rules, the same ones in both languages.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect.transpile import convert
from .etl.runner import EtlTask, combined, duplicate_keys, resumed
from .functions import canonical, cleanse, rendering
from .operators import audit, cursor, fold, merge, metrics, objects, scan, schema_diff
from .parsers import redo, test_decoding
from .projection import cache, documents, migration
from .streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# derived inputs ----------------------------------------------------------------------------------

LOW = datetime(1998, 1, 1)
_REPLICA = """replica AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 97 <> 0
    UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 211 = 0
)"""
_LOG = """log AS (
    SELECT user_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) AS seq, event_id, ts,
           CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 4 END AS op
    FROM events
)"""


def replica(orders: DataFrame) -> DataFrame:
    """An aged copy of orders: rows missing, rows stale, rows that the source has lost."""
    k = F.col("o_orderkey")
    stale = orders.where(k % 97 != 0).withColumn("o_totalprice", F.when(k % 31 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return stale.unionByName(orders.where(k % 211 == 0).withColumn("o_orderkey", k + 10_000_000))


def change_log(events: DataFrame) -> DataFrame:
    """Changes of one row per user: signups insert, errors delete, the rest are after-images. (ts, event_id) is their order."""
    op = F.when(F.col("event_type") == "signup", fold.INSERT).when(F.col("event_type") == "error", fold.DELETE).otherwise(fold.AFTER)
    return events.select("user_id", "event_type", "value", op.alias("op"), "ts", "event_id")


def change_records(events: DataFrame) -> DataFrame:
    return change_log(events).select(F.col("event_type").alias("object_name"), F.col("op").alias("change_type"), F.lit(1).alias("affected_rows"), F.col("ts").alias("occurred_at"))


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# scans and cursors -------------------------------------------------------------------------------


@query("""
    WITH o AS (SELECT * EXCLUDE o_orderdate, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders)
    SELECT * FROM o WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= (SELECT max(o_orderdate) FROM o) OR o_orderdate IS NULL
""")
def incremental_window(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 53 != 0, F.col("o_orderdate")))
    return orders.where(cursor.window("o_orderdate", LOW, cursor.high_watermark(orders, "o_orderdate"), keyed=True))


@query("SELECT max(o_orderdate) AS high, max(o_orderdate) - INTERVAL 1 SECOND AS stored FROM orders")
def high_watermark_lag(spark, sf_dir):
    high = cursor.high_watermark(read(spark, sf_dir, "orders"), "o_orderdate")
    return spark.createDataFrame([(high, cursor.lagged(high, keyed=True))], "high timestamp_ntz, stored timestamp_ntz")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 53 = 0) AS null_rows FROM orders")
def null_cursor_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 53 != 0, F.col("o_orderdate")))
    return cursor.null_cursor_rows(orders, "o_orderdate")


@query("SELECT * FROM orders WHERE o_orderkey > 5000 AND o_orderkey <= 9000 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, sf_dir):
    return scan.keyset_page(read(spark, sf_dir, "orders"), ["o_orderkey"], 500, [5000], [9000])


@query("SELECT * FROM conversations WHERE conv_id > 10 OR conv_id = 10 AND turn > 1 ORDER BY conv_id, turn LIMIT 60")
def keyset_page_composite(spark, sf_dir):
    return scan.keyset_page(read(spark, sf_dir, "conversations"), ["conv_id", "turn"], 60, [10, 1])


@query("SELECT c_custkey FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 200")
def key_page(spark, sf_dir):
    return scan.key_page(read(spark, sf_dir, "customer"), ["c_custkey"], 200, [100])


@query("SELECT * FROM nation ORDER BY n_nationkey, n_name, n_regionkey LIMIT 7 OFFSET 5")
def keyless_offset_page(spark, sf_dir):
    return scan.offset_page(read(spark, sf_dir, "nation"), 5, 7)


@query("SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def point_fetch(spark, sf_dir):
    keys = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return scan.fetch_by_keys(read(spark, sf_dir, "lineitem"), keys, ["l_orderkey"])


@query("SELECT count(*) AS rows FROM orders WHERE o_orderkey > 1000 AND o_orderkey <= 7000")
def range_count(spark, sf_dir):
    return scan.range_count(read(spark, sf_dir, "orders"), "o_orderkey", 1000, 7000)


@query("""
    WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), w AS (SELECT lo, ceil((hi - lo + 1) / 8.0)::BIGINT AS width FROM b)
    SELECT ((o_orderkey - lo) // width)::BIGINT AS range_no, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders, w GROUP BY 1
""")
def range_split_counts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    number = scan.range_number("o_orderkey", F.lit(low), F.lit(high), 8)
    return orders.groupBy(number.alias("range_no")).agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""
    WITH n AS (SELECT o_orderkey, ntile(16) OVER (ORDER BY o_orderkey) AS bucket FROM orders),
         r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o_orderkey) AS rn FROM n)
    SELECT bucket::INTEGER AS bucket, o_orderkey FROM r WHERE rn = 1
""")
def ntile_boundaries(spark, sf_dir):
    return scan.sampled_boundaries(read(spark, sf_dir, "orders"), ["o_orderkey"], 16)


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS shown, '<binary ' || strlen(text) || ' bytes>' AS as_bytes FROM documents")
def preview_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", rendering.preview_text(F.col("text")).alias("shown"), rendering.preview_binary(F.col("text").cast("binary")).alias("as_bytes"))


@query(f"WITH {_REPLICA} SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM replica) AS target_rows, 'OK' AS status UNION ALL SELECT 'part', (SELECT count(*) FROM part), NULL, 'MISSING_TABLE'")
def row_count_pair(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return scan.row_count_pair(orders, replica(orders), "orders").unionByName(scan.row_count_pair(read(spark, sf_dir, "part"), None, "part"))


# merges and audits -------------------------------------------------------------------------------


@query(f"""
    WITH {_REPLICA}, s AS (SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')
    SELECT * FROM replica WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT * FROM s
""")
def upsert_merge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return merge.upsert(replica(orders), orders.where(F.col("o_orderdate") > F.lit(LOW)), ["o_orderkey"])


@query(f"WITH {_REPLICA} SELECT o.* FROM orders o LEFT JOIN replica r USING (o_orderkey) WHERE r.o_orderkey IS NULL OR o.o_totalprice IS DISTINCT FROM r.o_totalprice")
def upsert_unchanged_guard(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return merge.changed_rows(replica(orders), orders, ["o_orderkey"])


@query("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 3 = 0 OR l_orderkey % 5 = 0")
def key_only_upsert(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return merge.insert_missing(pairs.where("l_orderkey % 3 = 0").distinct(), pairs.where("l_orderkey % 5 = 0"), ["l_orderkey", "l_suppkey"])


@query(f"WITH {_REPLICA} SELECT o_orderkey FROM replica EXCEPT SELECT o_orderkey FROM orders")
def delete_detect(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return merge.surplus_keys(replica(orders), orders, ["o_orderkey"])


@query(f"WITH {_REPLICA} SELECT * FROM replica WHERE o_orderkey IN (SELECT o_orderkey FROM orders)")
def delete_surplus(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return merge.delete_surplus(replica(orders), orders, ["o_orderkey"])


@query(f"WITH {_REPLICA} SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01' AND o_orderkey NOT IN (SELECT o_orderkey FROM replica)")
def missing_key_repair(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return merge.missing_rows(replica(orders), orders, ["o_orderkey"], F.col("o_orderdate") <= F.lit(datetime(2000, 1, 1)))


@query(f"""
    WITH {_REPLICA}, c AS (SELECT (SELECT count(*) FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01') AS s, (SELECT count(*) FROM replica WHERE o_orderdate <= TIMESTAMP '2000-01-01') AS t)
    SELECT s AS source_rows, t AS target_rows, greatest(s - t, 0) AS missing, greatest(t - s, 0) AS surplus FROM c
""")
def row_count_audit(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return audit.row_count_audit(orders, replica(orders), F.col("o_orderdate") <= F.lit(datetime(2000, 1, 1)))


@query(f"""
    WITH {_REPLICA}, n AS (SELECT *, ntile(200) OVER (ORDER BY o_orderkey) AS bucket FROM orders),
         k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o_orderkey) AS rn FROM n) WHERE rn = 1)
    SELECT count(*) AS sampled, count(*) FILTER (WHERE r.o_orderkey IS NULL) AS missing,
           count(*) FILTER (WHERE r.o_orderkey IS NULL OR k.o_totalprice <> r.o_totalprice) AS mismatched,
           count(*) FILTER (WHERE k.o_totalprice <> r.o_totalprice) AS diff_o_totalprice
    FROM k LEFT JOIN replica r ON k.o_orderkey = r.o_orderkey
""")
def content_audit(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return audit.content_audit(orders, replica(orders), ["o_orderkey"], 200).select("sampled", "missing", "mismatched", "diff_o_totalprice")


@query(f"""
    WITH {_REPLICA}, t AS (SELECT * EXCLUDE o_orderpriority, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM replica)
    SELECT * FROM t WHERE NOT coalesce(o_orderpriority = '1-URGENT', false) UNION ALL SELECT * EXCLUDE o_orderpriority, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def range_overwrite(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    target = replica(orders).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 53 != 0, F.col("o_orderpriority")))
    task = EtlTask("t", "", "orders", "RANGE_OVERWRITE", range_condition="o_orderpriority = '1-URGENT'")
    return combined(task, target, orders.where("o_orderpriority = '1-URGENT'"))


@query("SELECT *, NULL::VARCHAR AS note FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, 'new' FROM orders WHERE o_orderkey % 2 = 1")
def etl_append(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    held = orders.where("o_orderkey % 2 = 0").withColumn("note", F.lit(None).cast("string"))
    return combined(EtlTask("t", "", "orders", "APPEND"), held, orders.where("o_orderkey % 2 = 1").withColumn("note", F.lit("new")))


@query("SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal)::DECIMAL(18,2), 2)::DOUBLE AS balance FROM customer GROUP BY 1")
def etl_overwrite(spark, sf_dir):
    read(spark, sf_dir, "customer").createOrReplaceTempView("etl_customer")
    rows = spark.sql("SELECT c_mktsegment, count(*) AS customers, CAST(CAST(sum(c_acctbal) AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM etl_customer GROUP BY 1")
    return combined(EtlTask("t", "", "segments", "OVERWRITE"), rows.limit(0), rows)


@query("""
    WITH s AS (SELECT l_orderkey AS k, max_by(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS v FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1)
    SELECT o_orderkey AS k, 0::BIGINT AS v FROM orders WHERE o_orderkey NOT IN (SELECT k FROM s) UNION ALL SELECT k, v FROM s
""")
def etl_upsert_last_wins(spark, sf_dir):
    source = read(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("K"), F.col("l_partkey").alias("v"), "l_shipdate", "l_linenumber")
    target = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("K"), F.lit(0).cast("long").alias("v"))
    task = EtlTask("t", "", "target", "UPSERT", upsert_keys=["k"], order=["l_shipdate", "l_linenumber", "v"])
    return combined(task, target, source).withColumnRenamed("K", "k")


@query("SELECT l_orderkey, count(*) AS occurrences FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_resume_key(spark, sf_dir):
    return duplicate_keys(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT * FROM events WHERE event_id > 7000")
def resume_after_key(spark, sf_dir):
    return resumed(read(spark, sf_dir, "events"), "event_id", 7000)


# cleansing ---------------------------------------------------------------------------------------

_PEOPLE = """people AS (
    SELECT c_custkey, '138' || lpad((c_custkey % 100000000)::VARCHAR, 8, '0') AS phone, '110101' || lpad(c_custkey::VARCHAR, 12, '0') AS id_card,
           lpad(c_custkey::VARCHAR, 19, '6') AS bank_card, CASE WHEN c_custkey % 7 = 0 THEN 'nobody' ELSE 'user' || c_custkey || '@example.com' END AS email,
           '  ' || c_name || ' ' AS padded, CASE WHEN c_custkey % 5 = 0 THEN '   ' WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END AS blank, c_name AS name, c_mktsegment AS segment
    FROM customer
)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pad = lambda c, n, fill: F.lpad(c.cast("string"), n, fill)
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("138"), pad(k % 100_000_000, 8, "0")).alias("phone"),
        F.concat(F.lit("110101"), pad(k, 12, "0")).alias("id_card"),
        pad(k, 19, "6").alias("bank_card"),
        F.when(k % 7 == 0, "nobody").otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("padded"),
        F.when(k % 5 == 0, "   ").when(k % 5 == 1, "").otherwise(F.col("c_name")).alias("blank"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )


def _cleansed(name: str, column: str, sql: str, *rules: cleanse.Rule) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cleanse.cleanse(people(spark, sf_dir), "people", rules).select("c_custkey", F.col(column).alias("v"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_PEOPLE} SELECT c_custkey, {sql} AS v FROM people"


def _rule(column: str, kind: str, arg: str | None = None, replacement: str = "") -> cleanse.Rule:
    return cleanse.Rule("PEOPLE", column, kind, arg, replacement)


_cleansed("cleanse_trim", "padded", "trim(padded)", _rule("padded", "TRIM"))
_cleansed("cleanse_upper", "name", "upper(name)", _rule("name", "UPPER"))
_cleansed("cleanse_lower", "name", "lower(name)", _rule("NAME", "LOWER"))
_cleansed("cleanse_blank_to_null", "blank", "CASE WHEN trim(blank) = '' THEN NULL ELSE blank END", _rule("blank", "BLANK_TO_NULL"))
_cleansed("cleanse_strip_prefix", "name", "CASE WHEN starts_with(name, 'Customer') THEN substr(name, 9) ELSE name END", _rule("name", "STRIP_PREFIX", "Customer"))
_cleansed("cleanse_strip_suffix", "name", "CASE WHEN ends_with(name, '7') THEN left(name, length(name) - 1) ELSE name END", _rule("name", "STRIP_SUFFIX", "7"))
_cleansed("cleanse_regex_replace", "name", r"regexp_replace(name, '([0-9])([0-9])', '\2\1', 'g')", _rule("name", "REGEX_REPLACE", "([0-9])([0-9])", "$2$1"))
_cleansed("cleanse_mask_phone", "phone", "left(phone, 3) || repeat('*', length(phone) - 7) || right(phone, 4)", _rule("phone", "MASK_PHONE"))
_cleansed("cleanse_mask_id_card", "id_card", "left(id_card, 6) || repeat('*', length(id_card) - 10) || right(id_card, 4)", _rule("id_card", "MASK_ID_CARD"))
_cleansed("cleanse_mask_bank_card", "bank_card", "repeat('*', length(bank_card) - 4) || right(bank_card, 4)", _rule("bank_card", "MASK_BANK_CARD"))
_cleansed("cleanse_mask_name", "name", "left(name, 1) || repeat('*', length(name) - 1)", _rule("name", "MASK_NAME"))
_cleansed("cleanse_mask_email", "email", "CASE WHEN instr(email, '@') <= 1 THEN left(email, 1) || repeat('*', length(email) - 1) ELSE left(email, 1) || '***' || substr(email, instr(email, '@')) END", _rule("email", "MASK_EMAIL"))
_cleansed("cleanse_sha256", "email", "sha256('pepper:' || email)", _rule("email", "HASH_SHA256", " pepper "))
_cleansed("cleanse_chain", "padded", "CASE WHEN upper(trim(padded)) = '' THEN NULL ELSE sha256(regexp_replace(upper(trim(padded)), '[^A-Z0-9]', '', 'g')) END", _rule("padded", "TRIM"), _rule("padded", "UPPER"), _rule("missing", "LOWER"), _rule("padded", "BLANK_TO_NULL"), _rule("padded", "REGEX_REPLACE", "("), _rule("padded", "REGEX_REPLACE", "[^A-Z0-9]"), _rule("padded", "HASH_SHA256"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS flag, (epoch_us(o_orderdate))::VARCHAR AS moment, (epoch_us(o_orderdate))::VARCHAR AS clock,
           rtrim(o_orderpriority || '  ', ' ') AS word, o_orderkey::VARCHAR AS amount
    FROM orders
""")
def canonical_values(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 2 == 0).alias("flag"),
        F.col("o_orderdate").alias("moment"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("clock"),
        F.concat("o_orderpriority", F.lit("  ")).alias("word"),
        F.col("o_orderkey").cast("decimal(20,4)").alias("amount"),
    )
    return rows.select("o_orderkey", *(canonical.canonical(F.col(c), rows.schema[c].dataType).alias(c) for c in rows.columns[1:]))


# change capture ----------------------------------------------------------------------------------


@query(f"""
    WITH {_LOG} SELECT user_id, event_type, value, op FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM log) WHERE rn = 1
""")
def cdc_fold_lww(spark, sf_dir):
    return fold.fold_aggregated(change_log(read(spark, sf_dir, "events")), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value", "op")


@query(f"""
    WITH {_LOG}, t AS (SELECT *, event_id // 20 AS tx FROM log)
    SELECT tx::BIGINT AS tx, user_id, op, value FROM (SELECT *, row_number() OVER (PARTITION BY tx, user_id ORDER BY event_id DESC) AS rn FROM t) WHERE rn = 1
""")
def cdc_fold_transactions(spark, sf_dir):
    """Twenty changes in a row are a transaction; event_id is the log's own sequence."""
    log = change_log(read(spark, sf_dir, "events")).withColumn("tx", F.floor(F.col("event_id") / 20))
    return fold.fold_aggregated(log, ["user_id"], ["event_id"], within=["tx"]).select("tx", "user_id", "op", "value")


@query(f"""
    WITH {_LOG}, m AS (
        SELECT CASE WHEN event_id % 40 = 0 AND op = 4 THEN user_id + 100000 ELSE user_id END AS user_id, event_type, value, op, ts, event_id, 1 AS step FROM log
        UNION ALL SELECT user_id, event_type, value, 1, ts, event_id, 0 FROM log WHERE event_id % 40 = 0 AND op = 4
    )
    SELECT user_id, op, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, step DESC) AS rn FROM m) WHERE rn = 1
""")
def cdc_key_change(spark, sf_dir):
    log = change_log(read(spark, sf_dir, "events"))
    moved = (F.col("event_id") % 40 == 0) & (F.col("op") == fold.AFTER)
    pairs = log.withColumn("old_user", F.when(moved, F.col("user_id"))).withColumn("user_id", F.when(moved, F.col("user_id") + 100_000).otherwise(F.col("user_id")))
    return fold.fold_aggregated(fold.with_key_changes(pairs, ["user_id"], ["old_user"]), ["user_id"], ["ts", "event_id", "_step"]).select("user_id", "op", "event_id")


_APPLIED = f"""
    WITH {_LOG}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE event_id > 2000) WHERE rn = 1),
         b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE event_id <= 2000) WHERE rn = 1 AND op <> 1)
    SELECT user_id, event_type, value FROM b WHERE user_id NOT IN (SELECT user_id FROM f) UNION ALL SELECT user_id, event_type, value FROM f WHERE op <> 1
"""


@query(_APPLIED)
def cdc_apply(spark, sf_dir):
    log = change_log(read(spark, sf_dir, "events"))
    key, order = ["user_id"], ["ts", "event_id"]
    base = fold.fold_aggregated(log.where("event_id <= 2000"), key, order).where(F.col("op") != fold.DELETE).select("user_id", "event_type", "value")
    return fold.apply_changes(base, fold.fold_aggregated(log.where("event_id > 2000"), key, order), key)


@query("""
    WITH l AS (SELECT event_id, '0x' || lpad(to_hex(event_id), 20, '0') AS lsn FROM events) SELECT event_id, lsn FROM l WHERE event_id > 300 AND event_id <= 4000
""")
def lsn_window(spark, sf_dir):
    log = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("0x"), F.lpad(F.hex("event_id"), 20, "0")).alias("lsn"))
    return fold.lsn_window(log, f"0x{300:020X}", f"0x{4000:020X}")


@query("SELECT user_id AS tx, count(*) AS rows, (sum(16 + 32 + 2 * length(event_type) + 2 * length(props)))::BIGINT AS bytes FROM events GROUP BY 1 HAVING count(*) > 60 OR bytes > 9000")
def transaction_budget(spark, sf_dir):
    log = read(spark, sf_dir, "events").select("value", "event_type", "props", F.col("user_id").alias("tx"))
    return fold.over_budget(log, "tx", 60, 9000)


@query("""
    SELECT p_partkey, ['', 'small', 'medium', 'large', NULL][least(p_size % 6, 4) + 1] AS label,
           concat_ws(',', CASE WHEN p_size & 1 > 0 THEN 'a' END, CASE WHEN p_size & 2 > 0 THEN 'b' END, CASE WHEN p_size & 4 > 0 THEN 'c' END) AS labels
    FROM part
""")
def enum_and_set(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", rendering.enum_label(size % 6, ["small", "medium", "large"]).alias("label"), rendering.set_labels(size, ["a", "b", "c"]).alias("labels"))


@query("SELECT event_id, 'public.events' AS table_name, 'UPDATE' AS kind, event_type, value, props FROM (SELECT event_id, event_type || '''s' AS event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 100 END AS value, props FROM events)")
def log_lines(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 9 == 0, "null").otherwise((F.col("event_id") % 100).cast("string"))
    line = F.concat(
        F.lit("table public.events: UPDATE: old-key: event_id[bigint]:"), F.col("event_id").cast("string"), F.lit(" new-tuple: event_id[bigint]:"), F.col("event_id").cast("string"),
        F.lit(" event_type[character varying]:'"), "event_type", F.lit("''s' value[bigint]:"), value, F.lit(" props[json]:'"), "props", F.lit("'"),
    )
    parsed = test_decoding.parse_lines(e.select("event_id", line.alias("data")), "data", "event_id")
    return parsed.select("event_id", "table_name", "kind", *(F.col("new")[c].alias(c) for c in ("event_type",)), F.col("new")["value"].cast("long").alias("value"), F.col("new")["props"].alias("props"))


@query("SELECT c_custkey, 'UPDATE' AS op, 'APP.CUSTOMER' AS table_name, c_custkey::VARCHAR AS previous, c_name || ' and ''co''' AS name, '2024-01-31' AS seen, NULL::VARCHAR AS gone FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 11 = 0")
def redo_statements(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    good = F.concat(F.lit('update "APP"."CUSTOMER" set "NAME" = \''), "c_name", F.lit(" and ''co''', \"SEEN\" = TO_DATE('2024-01-31', 'YYYY-MM-DD'), \"GONE\" = NULL where \"ID\" = '"), k, F.lit("' and \"NAME\" = 'x' and ROWID = 'AAA';"))
    text = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit('update "APP"."CUSTOMER" set "NAME" = OUT_CLOB where "ID" = \''), k, F.lit("'"))).otherwise(good)
    parsed = redo.parse_statements(c.select("c_custkey", text.alias("sql")), "sql", "c_custkey", ["ID"])
    row = lambda n: F.col("row")[n]
    return parsed.select("c_custkey", "op", "table_name", F.col("previous_key")["ID"].alias("previous"), row("NAME").alias("name"), row("SEEN").alias("seen"), row("GONE").alias("gone"))


# metrics -----------------------------------------------------------------------------------------


@query("""
    WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-14 13:00:00', TIMESTAMP '2024-01-15 12:00:00', INTERVAL 1 HOUR)) AS slot),
         c AS (SELECT date_trunc('hour', ts) AS slot, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT slot, coalesce(n, 0) AS changes, coalesce(n, 0) AS rows FROM s LEFT JOIN c USING (slot)
""")
def hourly_series_gapfilled(spark, sf_dir):
    log = change_records(read(spark, sf_dir, "events").where("event_type = 'error'"))
    return metrics.hourly_series(log, stamp("2024-01-15 12:34:56")).withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query("SELECT date_trunc('minute', ts) AS minute, CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 4 END AS change_type, count(*) AS changes FROM events GROUP BY 1, 2")
def minute_changes(spark, sf_dir):
    return metrics.minute_changes(change_records(read(spark, sf_dir, "events"))).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("SELECT event_type AS object_name, count(*) AS rows FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def hot_objects_topk(spark, sf_dir):
    return metrics.top_objects(change_records(read(spark, sf_dir, "events")), most=3)


@query("SELECT CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 4 END AS change_type, count(*) AS rows FROM events GROUP BY 1")
def change_share(spark, sf_dir):
    return metrics.change_share(change_records(read(spark, sf_dir, "events")))


@query("SELECT user_id % 10 AS project, count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def rows_per_project(spark, sf_dir):
    log = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("project"), F.lit(1).alias("affected_rows"), F.col("ts").alias("occurred_at"))
    return metrics.rows_in_window(log, stamp("2024-01-05"), stamp("2024-01-12"))


def _bucket_sql(start: str, end: str, hours: int) -> str:
    """Half-open buckets from ``start``: a sample's bucket is the whole number of widths since then."""
    return f"""
        WITH v AS (SELECT ts, CASE WHEN event_id % 7 = 0 OR day(ts) = 3 THEN NULL ELSE event_id % 1000 END AS value FROM events WHERE day(ts) <> 5),
             w AS (SELECT epoch_us(TIMESTAMP '{start}') AS a, epoch_us(TIMESTAMP '{end}') AS z, {hours} * 3600000000 AS width),
             s AS (SELECT unnest(range(0, ((z - a + width - 1) // width)::BIGINT)) AS i FROM w),
             b AS (SELECT (epoch_us(ts) - a) // width AS i, avg(value) AS average, sum(value)::BIGINT AS total, max(value) AS largest FROM v, w WHERE epoch_us(ts) >= a AND epoch_us(ts) < z GROUP BY 1)
        SELECT make_timestamp((SELECT a FROM w) + s.i * (SELECT width FROM w)) AS slot, average, total, largest FROM s LEFT JOIN b ON b.i = s.i
    """


def _bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("day(ts) <> 5")
    return e.select("ts", F.when((F.col("event_id") % 7 != 0) & (F.dayofmonth("ts") != 3), F.col("event_id") % 1000).alias("value"))


@query(_bucket_sql("2024-01-02 00:00:00", "2024-01-08 00:00:00", 6))
def metric_buckets(spark, sf_dir):
    return metrics.buckets(_bucket_samples(spark, sf_dir), stamp("2024-01-02"), stamp("2024-01-08"), "6 HOURS")


@query(_bucket_sql("2024-01-02 01:17:31", "2024-01-07 05:00:00", 6))
def metric_buckets_unaligned(spark, sf_dir):
    """Buckets begin where the window does, and the last one is cut short."""
    return metrics.buckets(_bucket_samples(spark, sf_dir), stamp("2024-01-02 01:17:31"), stamp("2024-01-07 05:00:00"), "6 HOURS")


@query("SELECT count(*) FILTER (WHERE event_type <> 'error') * 100 / count(*) AS uptime FROM events")
def uptime(spark, sf_dir):
    return metrics.uptime(read(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok")))


@query("""
    WITH v AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 2 END AS value FROM events)
    SELECT user_id, arg_max_null(value, (ts, event_id)) AS newest, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS newest_known FROM v GROUP BY 1
""")
def newest_known(spark, sf_dir):
    samples = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 2).alias("value"))
    return metrics.newest(samples, "user_id", tie="event_id")


@query("""
    SELECT o_orderkey, CASE WHEN w > 0 THEN (o_orderkey * 1000) // w ELSE 0 END AS rows_per_second, CASE WHEN s > 0 THEN round(r * 100.0 / s) ELSE 0 END::INTEGER AS read_percent,
           CASE WHEN s > 0 THEN round(t * 100.0 / s) ELSE 0 END::INTEGER AS write_percent, CASE WHEN s > 0 THEN round(c * 100.0 / s) ELSE 0 END::INTEGER AS commit_percent
    FROM (SELECT o_orderkey, o_orderkey % 7 AS r, o_orderkey % 5 AS t, o_orderkey % 3 AS c, r + t + c AS s, o_custkey % 50 AS w FROM orders)
""")
def throughput_split(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", *metrics.throughput(k, k % 7, k % 5, k % 3, F.col("o_custkey") % 50))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY")
def retention(spark, sf_dir):
    return metrics.older_than(read(spark, sf_dir, "events"), "ts", 30, stamp("2024-02-10")).select("event_id")


@query("""
    SELECT 'DATA_DRIFT' AS category, n_name AS subject, CASE WHEN n_nationkey < 10 THEN 'NEW' WHEN n_nationkey < 15 THEN 'REPEAT' ELSE 'RECOVERED' END AS event
    FROM nation WHERE n_nationkey <= 20 AND (n_nationkey < 10 OR n_nationkey >= 15 OR n_nationkey % 2 = 0)
""")
def alert_events(spark, sf_dir):
    """Nations are subjects: some drift for the first time, some have been told of lately or long ago, some no longer drift."""
    n = read(spark, sf_dir, "nation")
    drift = n.where("n_nationkey < 15").select(F.lit("DATA_DRIFT").alias("category"), F.col("n_name").alias("subject"), F.lit("d").alias("detail"))
    signals = drift.unionByName(drift).unionByName(n.limit(1).select(F.lit("DDL_SKIPPED").alias("category"), F.col("n_name").alias("subject"), F.lit("d").alias("detail")))
    sent = F.when(F.col("n_nationkey") % 2 == 0, "2024-01-01 10:00:00").otherwise("2024-01-01 12:00:00").cast("timestamp")
    state = n.where("n_nationkey BETWEEN 10 AND 20").select(F.lit("DATA_DRIFT").alias("category"), F.col("n_name").alias("subject"), sent.alias("last_sent"), F.lit(True).alias("active"))
    found, _ = alerts.evaluate(signals, state, F.lit("2024-01-01 12:30:00").cast("timestamp"), 60, ("DATA_DRIFT",))
    return found.select("category", "subject", "event")


# tables, names and structure ---------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^Customer#.*7$|^Customer#.......1.*$|^Customer#000000002$')")
def glob_filter(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(objects.matches(F.col("c_name"), "Customer#*7, Customer#???????1*,Customer#000000002, customer#*")).select("c_custkey", "c_name")


@query("SELECT upper(substr(p_brand, 1, 7)) AS target, count(*) AS sources, string_agg(p_brand, ',' ORDER BY p_brand) AS names FROM (SELECT DISTINCT p_brand FROM part) GROUP BY 1 HAVING count(*) > 1")
def name_mapping_conflicts(spark, sf_dir):
    pairs = read(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.lower(F.substring("p_brand", 1, 7)).alias("target")).distinct()
    return objects.mapping_conflicts(pairs)


@query("SELECT * FROM (VALUES (0, 'lineitem', 600), (1, 'orders', 150), (1, 'customer', 150), (1, 'events', NULL), (1, 'part', 20), (1, 'region', 0)) t(bin, table_name, rows)")
def bin_packing(spark, sf_dir):
    items = [objects.Item("orders", 150), objects.Item("lineitem", 600), objects.Item("customer", 150), objects.Item("part", 20), objects.Item("region", 0), objects.Item("events", None)]
    return spark.createDataFrame(objects.plan_rows(objects.pack(items, 2)), "bin int, table_name string, rows int")


@query("""SELECT * FROM (VALUES ('TABLE', 'CREATE', 'part', NULL, 10), ('TABLE', 'DROP', 'region', NULL, 10), ('COLUMN', 'CREATE', 'orders', 'note', 20), ('COLUMN', 'ALTER', 'orders', 'o_totalprice', 20), ('COLUMN', 'DROP', 'orders', 'o_orderpriority', 20)) t(object_type, change_type, table_name, column_name, priority)""")
def schema_changes(spark, sf_dir):
    held = {t: read(spark, sf_dir, t).schema for t in ("orders", "region", "part", "nation")}
    now = T.StructType([T.StructField(f.name.upper() if f.name == "o_custkey" else f.name, T.DecimalType(12, 2) if f.name == "o_totalprice" else f.dataType) for f in held["orders"] if f.name != "o_orderpriority"] + [T.StructField("note", T.StringType())])
    before = schema_diff.spec_of(spark, {k: held[k] for k in ("orders", "region", "nation")})
    after = schema_diff.spec_of(spark, {"ORDERS": now, "part": held["part"]})
    found = schema_diff.changes(before, after, unreadable=["nation"])
    return found.withColumn("table_name", F.lower("table_name"))


@query("SELECT * FROM (VALUES ('o_orderkey', 'OK'), ('o_custkey', 'INCOMPATIBLE'), ('o_orderstatus', 'MISSING'), ('filled', 'UNFED'), ('spare', 'EXTRA')) t(column_name, status)")
def target_columns(spark, sf_dir):
    source = schema_diff.spec_of(spark, {"orders": read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").schema})
    target = T.StructType([T.StructField("O_ORDERKEY", T.DecimalType(20, 0)), T.StructField("o_custkey", T.StringType()), T.StructField("filled", T.DateType(), False), T.StructField("spare", T.DateType())])
    return schema_diff.against_target(source, schema_diff.spec_of(spark, {"orders": target}))


# projections and documents -----------------------------------------------------------------------


@query("""
    SELECT 'app:customer:' || replace(replace(c_name || ':x%', '%', '%25'), ':', '%3A') || ':' || c_custkey AS key,
           c_custkey AS id, c_name || ':x%' AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, (c_custkey % 100)::VARCHAR AS amount
    FROM customer
""")
def cache_key_json(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(":x%")).alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"),
        (F.col("c_custkey") % 100).cast("decimal(10,2)").alias("amount"), F.lit("hidden").alias("secret"),
    )
    values = cache.as_json(rows, "app", "customer", ["name", "id"], ["SECRET"])
    return values.select("key", F.from_json("value", "id long, name string, segment string, amount string").alias("v")).select("key", "v.*")


@query("SELECT 'nation:' || n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'n_regionkey' ELSE '' END AS removed FROM nation")
def cache_hash(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 2 != 0, F.col("n_regionkey")))
    return cache.as_hash(rows, "", "nation", ["n_nationkey"]).select("key", F.col("fields")["n_name"].alias("name"), F.array_join("removed", ",").alias("removed"))


@query("SELECT * FROM (VALUES ('_id', 'ObjectId', 'string'), ('big', 'Int64', 'bigint'), ('k', 'Int32', 'int'), ('mixed', 'Mixed', 'string'), ('none', 'Null', 'string'), ('num', 'Double', 'double'), ('tags', 'Array', 'string'), ('when', 'Date', 'timestamp')) t(name, kind, spark_type)")
def document_types(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.concat(
        F.lit('{"_id":{"$oid":"'), F.lpad(F.hex("event_id"), 24, "0"), F.lit('"},"k":'), k.cast("string"), F.lit(',"big":'), F.when(F.col("event_id") % 2 == 0, "5").otherwise("5000000000"), F.lit(',"num":'),
        F.when(F.col("event_id") % 3 == 0, "1").otherwise("1.5"), F.lit(',"mixed":'), F.when(F.col("event_id") % 2 == 0, "1").otherwise('"one"'), F.lit(',"none":null,"tags":[1,2],"when":{"$date":"2024-01-01T00:00:00Z"}}'),
    )
    return spark.createDataFrame(documents.inferred(read(spark, sf_dir, "events").select(doc.alias("doc")), sample=None), "name string, kind string, spark_type string")


@query("SELECT event_id, event_type FROM events WHERE event_id > 100 AND (event_type IN ('click', 'view') OR user_id < 20) AND NOT (user_id = 3) AND event_type LIKE '%i%'")
def document_filter(spark, sf_dir):
    spec = documents.resume_filter(documents.parse_filter('{"$or":[{"event_type":{"$in":["click","view"]}},{"user_id":{"$lt":20}}],"user_id":{"$not":{"$eq":3}},"event_type":{"$regex":"i"}}'), "event_id", 100)
    return read(spark, sf_dir, "events").where(documents.condition(spec)).select("event_id", "event_type")


@query("SELECT lpad(to_hex(event_id), 24, '0') AS _id, (event_id % 2)::SMALLINT AS flag, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id) AS seen, '{\"a\":1}' AS sub, event_type AS t FROM events")
def document_render(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    seen = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    doc = F.concat(F.lit('{"_id":{"$oid":"'), F.lpad(F.hex("event_id"), 24, "0"), F.lit('"},"flag":'), F.when(F.col("event_id") % 2 == 1, "true").otherwise("false"), F.lit(',"seen":{"$date":"'), seen, F.lit('"},"sub":{"a":1},"t":"'), "event_type", F.lit('"}'))
    docs = e.select(doc.alias("doc"))
    columns = [("_id", "ObjectId", "string"), ("flag", "Boolean", "smallint"), ("seen", "Date", "timestamp"), ("sub", "Document", "string"), ("t", "String", "string")]
    return documents.rendered(docs, "doc", columns).withColumn("seen", F.col("seen").cast("timestamp_ntz"))


@query(f"""
    WITH {_REPLICA}, k AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0)
    SELECT count(*) AS sampled, count(*) FILTER (WHERE r.o_orderkey IS NULL) AS missing, count(*) FILTER (WHERE r.o_totalprice <> o.o_totalprice) AS mismatched
    FROM k JOIN orders o USING (o_orderkey) LEFT JOIN replica r USING (o_orderkey)
""")
def migration_sample(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return migration.verify_sample(orders, replica(orders), "o_orderkey", orders.where("o_orderkey % 10 = 0"))


# user SQL ----------------------------------------------------------------------------------------


def _views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)


_STAR = """
    SELECT r_name, o_orderpriority, count(*) AS items, sum(l_quantity) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY r_name, o_orderpriority
"""


@query(_STAR)
def user_sql_star_join(spark, sf_dir):
    _views(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    return spark.sql(_STAR)


_ROLLUP = "SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"


@query(_ROLLUP)
def user_sql_rollup(spark, sf_dir):
    _views(spark, sf_dir, "customer")
    return spark.sql(_ROLLUP)


_RANKS = "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey) AS place FROM lineitem) t WHERE place <= 3"


@query(_RANKS)
def user_sql_ranks(spark, sf_dir):
    _views(spark, sf_dir, "lineitem")
    return spark.sql(_RANKS)


_FOREIGN = """CREATE OR REPLACE VIEW v AS SELECT "O_ORDERKEY" AS o_orderkey, NVL2(o_orderstatus, 'set', 'unset') AS known, DECODE(o_orderpriority, '1-URGENT', 1, '2-HIGH', 2, 9) AS urgency,
    SUBSTR(o_orderpriority, 1, 3) || '!' AS head, POW(2, MOD(o_orderkey, 3)) AS two, LENGTHB(o_orderstatus) AS bytes, CAST(o_orderkey AS VARCHAR2(20)) AS txt FROM orders WHERE o_orderkey > 10 MINUS SELECT 0, 'a', 0, 'b', 0, 0, 'c' FROM DUAL"""


@query("""
    SELECT DISTINCT o_orderkey, CASE WHEN o_orderstatus IS NOT NULL THEN 'set' ELSE 'unset' END AS known, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS urgency,
           substr(o_orderpriority, 1, 3) || '!' AS head, 2.0 ** (o_orderkey % 3) AS two, strlen(o_orderstatus)::INTEGER AS bytes, o_orderkey::VARCHAR AS txt FROM orders WHERE o_orderkey > 10
""")
def rewritten_view(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    made = convert(_FOREIGN, "oracle", "spark")
    if made.blocked:
        raise ValueError(made.blocked)
    return spark.sql(made.sql)
