"""Queries that rewrite the text of other dialects, scripts and definitions, and run what comes out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import types
from .dialect.text import statements, without_order
from .dialect.transpile import convert, page_sql
from .etl.variables import built_in, definitions, substitute
from .parsers import ddl
from .queries import query, read


def _run(spark: SparkSession, sf_dir: str, sql: str, source: str, *tables: str) -> DataFrame:
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    made = convert(sql, source, "spark")
    if made.blocked:
        raise ValueError(made.blocked)
    return spark.sql(made.sql)


@query("SELECT o_orderkey, o_orderpriority = '1-URGENT' AND NULL IS NULL AS missing, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, 'none') AS status, o_orderkey % 3 = 0 AS absent FROM orders")
def view_null_predicate(spark, sf_dir):
    """MySQL's one-argument ISNULL is a predicate."""
    return _run(spark, sf_dir, "SELECT o_orderkey, (o_orderpriority = '1-URGENT') AS missing, IFNULL(IF(o_orderkey % 3 = 0, NULL, `o_orderstatus`), 'none') AS status, ISNULL(IF(o_orderkey % 3 = 0, NULL, o_orderstatus)) AS absent FROM orders", "mysql", "orders")


@query("""
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, 'none') AS status, length(o_orderpriority)::INTEGER AS chars, strlen(o_orderpriority || 'é')::INTEGER AS bytes,
           instr(o_orderpriority, '-')::INTEGER AS dash, last_day(o_orderdate::DATE)::VARCHAR AS month_end, o_orderkey::VARCHAR AS txt, repeat('ab', 2) AS twice FROM orders
""")
def view_sqlserver(spark, sf_dir):
    """Two-argument ISNULL, LEN, DATALENGTH, CHARINDEX with its needle first, EOMONTH, CONVERT, REPLICATE and brackets."""
    sql = "SELECT [o_orderkey], ISNULL(NULLIF(o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '?' END), 'none') AS status, LEN([o_orderpriority]) AS chars, DATALENGTH(concat(o_orderpriority, 'é')) AS bytes, CHARINDEX('-', o_orderpriority) AS dash, CONVERT(VARCHAR(10), EOMONTH(o_orderdate)) AS month_end, CONVERT(VARCHAR(20), o_orderkey) AS txt, REPLICATE('ab', 2) AS twice FROM orders"
    return _run(spark, sf_dir, sql, "sqlserver", "orders")


@query("SELECT o_orderkey::VARCHAR AS txt, instr(o_orderpriority, '-')::INTEGER AS dash, o_orderstatus || '!' AS loud, ceil(o_totalprice)::BIGINT AS up FROM orders WHERE o_orderkey > 7 EXCEPT SELECT '9', 2, 'x', 0")
def view_postgres(spark, sf_dir):
    """:: casts, STRPOS with its needle last, CEILING, quoted names, EXCEPT."""
    return _run(spark, sf_dir, """SELECT o_orderkey::text AS txt, STRPOS("o_orderpriority", '-') AS dash, o_orderstatus || '!' AS loud, CEILING(o_totalprice)::bigint AS up FROM orders WHERE o_orderkey > 7 EXCEPT SELECT '9', 2, 'x', 0""", "postgres", "orders")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, sum(strlen(c_name))::BIGINT AS bytes FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def view_mysql_rollup(spark, sf_dir):
    """WITH ROLLUP, and LENGTH that counts bytes."""
    return _run(spark, sf_dir, "CREATE VIEW v AS SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, SUM(LENGTH(c_name)) AS bytes FROM customer GROUP BY c_mktsegment, c_nationkey WITH ROLLUP;", "mysql", "customer")


@query("SELECT c_custkey, upper(c_name) AS loud, lower(c_mktsegment) AS soft, c_custkey::BIGINT AS whole, TRUE AS yes FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 15")
def view_mysql_limit(spark, sf_dir):
    """LIMIT offset, count; UCASE and LCASE; CAST AS SIGNED; TRUE."""
    return _run(spark, sf_dir, "SELECT c_custkey, UCASE(c_name) AS loud, LCASE(c_mktsegment) AS soft, CAST(c_custkey AS SIGNED) AS whole, TRUE AS yes FROM customer ORDER BY c_custkey LIMIT 15, 40", "mysql", "customer")


@query("SELECT event_id, ts AS whole, date_trunc('day', ts) AS day, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS code FROM events")
def view_oracle_dates(spark, sf_dir):
    """A date of Oracle keeps its time of day."""
    made = _run(spark, sf_dir, "SELECT event_id, CAST(ts AS DATE) AS whole, CAST(date_trunc('DAY', ts) AS DATE) AS day, DECODE(event_type, 'click', 1, 'view', 2) AS code FROM events", "oracle", "events")
    return made.select("event_id", F.col("whole").cast("timestamp_ntz").alias("whole"), F.col("day").cast("timestamp_ntz").alias("day"), "code")


@query("SELECT n_nationkey, instr(n_name, 'A')::INTEGER AS place, 1 AS one FROM nation ORDER BY n_nationkey LIMIT 11")
def view_db2(spark, sf_dir):
    """POSSTR, SYSIBM.SYSDUMMY1 and FETCH FIRST."""
    return _run(spark, sf_dir, "SELECT n_nationkey, POSSTR(n_name, 'A') AS place, (SELECT 1 FROM SYSIBM.SYSDUMMY1) AS one FROM nation ORDER BY n_nationkey FETCH FIRST 11 ROWS ONLY", "db2", "nation")


@query("SELECT count(*) > 0 AS known, count(*) AS n FROM region")
def view_now(spark, sf_dir):
    """NOW with digits, and the clocks of other dialects."""
    made = _run(spark, sf_dir, "SELECT NOW(6) AS a, SYSDATE() AS b, CURDATE() AS c FROM region", "mysql", "region")
    return made.agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()) == F.count("*")).alias("known"), F.count("*").alias("n"))


_PAGED = ("mysql", "postgres", "hana", "spark", "db2")


@query("SELECT d AS dialect, o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 60), (SELECT unnest(['mysql', 'postgres', 'hana', 'spark', 'db2']) AS d)")
def page_by_dialect(spark, sf_dir):
    """A page in the words of each dialect, read back into Spark's."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    out = None
    for d in _PAGED:
        sql = page_sql("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey", d, 25, 60)
        rows = spark.sql(sql if d == "spark" else convert(sql, d, "spark").sql).select(F.lit(d).alias("dialect"), "o_orderkey", "o_custkey")
        out = rows if out is None else out.unionByName(rows)
    return out


_REFUSED = {
    "rownum": ("oracle", "SELECT * FROM {t} WHERE ROWNUM < 5"), "outer": ("oracle", "SELECT * FROM {t} a, {t} b WHERE a.k = b.k(+)"), "top": ("sqlserver", "SELECT TOP 5 PERCENT * FROM {t}"),
    "json": ("postgres", "SELECT a->>'x' FROM {t}"), "body": ("oracle", "BEGIN SELECT 1 FROM {t}; END"), "days": ("oracle", "SELECT SYSDATE - 1 FROM {t}"), "cast": ("oracle", "SELECT CAST(a AS HYPERTYPE) FROM {t}"),
    "slash": ("mysql", "SELECT 'a\\'b' FROM {t}"), "fine": ("oracle", "SELECT NVL(a, 'ROWNUM (+) ::') FROM {t} -- TOP"),
}


@query("SELECT n_name AS table_name, name, CASE name WHEN 'rownum' THEN 'ROWNUM' WHEN 'outer' THEN 'outer join operator (+)' WHEN 'top' THEN 'TOP' WHEN 'json' THEN 'JSON operator' WHEN 'body' THEN 'procedural body' WHEN 'days' THEN 'date plus or minus a number' WHEN 'cast' THEN 'cast to unknown type HYPERTYPE' WHEN 'slash' THEN 'backslash escape' ELSE '' END AS reason FROM nation, (SELECT unnest(['rownum', 'outer', 'top', 'json', 'body', 'days', 'cast', 'slash', 'fine']) AS name)")
def views_refused(spark, sf_dir):
    """What can't be rewritten surely is refused, and says why; words in strings and comments don't count."""
    tables = [r.n_name for r in read(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame([(t, n, ", ".join(convert(sql.format(t=t.replace(" ", "_")), source, "spark").blocked)) for t in tables for n, (source, sql) in _REFUSED.items()], "table_name string, name string, reason string")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS place, 'INSERT INTO t VALUES (' || n_nationkey || ', ''' || n_name || ';'')' AS statement FROM nation")
def script_statements(spark, sf_dir):
    """A script cut into statements: semicolons in strings and comments don't cut, empty statements go."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    script = ";\n".join(f"-- row; {r.n_nationkey}\nINSERT INTO t VALUES ({r.n_nationkey}, '{r.n_name};')" for r in rows) + ";\n;/* the end; */"
    found = [s[s.index("INSERT") :] for s in statements(script, "mysql")]
    return spark.createDataFrame(list(enumerate(found)), "place int, statement string")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def order_stripped(spark, sf_dir):
    """The outermost ORDER BY goes where a query becomes a derived table."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    inner = without_order("SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS rn, 'order by' AS s FROM orders ORDER BY o_totalprice DESC")
    if "ORDER BY o_totalprice" in inner or "OVER (ORDER BY" not in inner:
        raise ValueError(inner)
    return spark.sql(f"SELECT o_orderstatus, count(*) AS n FROM ({inner}) GROUP BY 1")


@query("SELECT o_orderkey, '1998-05-01' AS since, 'load 2024-02-29 202402 2' AS note, '$x' AS kept FROM orders WHERE o_orderdate >= TIMESTAMP '1998-05-01'")
def etl_variables(spark, sf_dir):
    """References are replaced once; built-in values come from the run's moment."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    values = built_in(datetime(2024, 3, 1, 8), "load", "t", 2) | definitions("from = 1998-05-01\nlit = '$x'")
    return spark.sql(substitute("SELECT o_orderkey, '${from}' AS since, '${taskName} ${yesterday} 202402 ${runIndex}' AS note, ${lit} AS kept FROM orders WHERE o_orderdate >= TIMESTAMP '${from}'", values))


_DDL = "ALTER TABLE shop.{t} ADD COLUMN c{k} INT DEFAULT 0, ADD (d{k} DECIMAL(10, 2), `e {k}` TEXT), DROP COLUMN old_{k}, ADD CONSTRAINT u{k} UNIQUE (c{k})"


@query("SELECT n_nationkey, 'shop.T' || n_nationkey AS table_name, 'c' || n_nationkey || ',d' || n_nationkey || ',e ' || n_nationkey AS added, 'old_' || n_nationkey AS dropped, TRUE AS gap, 'ALTER TABLE target.x ADD COLUMN a INT' AS sent FROM nation")
def ddl_in_log(spark, sf_dir):
    """Structure changes of a log as text: their table, columns that come and go, whether copied rows lack a value, and the statement for the target."""
    out = []
    for r in read(spark, sf_dir, "nation").collect():
        sql = _DDL.format(t=f"T{r.n_nationkey}", k=r.n_nationkey)
        if not ddl.is_structural(sql):
            raise ValueError(sql)
        sent = ddl.retargeted(f"ALTER TABLE shop.T{r.n_nationkey} ADD COLUMN a INT", f"shop.T{r.n_nationkey}", "target.x")
        out.append((r.n_nationkey, ddl.altered_table(sql), ",".join(ddl.added_columns(sql)), ",".join(ddl.dropped_columns(sql)), ddl.leaves_gap(sql), sent))
    return spark.createDataFrame(out, "n_nationkey long, table_name string, added string, dropped string, gap boolean, sent string")


_SPARK_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE lower(data_type) END"


@query(f"SELECT table_name, column_name, {_SPARK_TYPES} AS type_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')")
def create_table_ddl(spark, sf_dir):
    """Tables made from their definitions, as the catalogue then describes them."""
    from .sources import catalog

    spark.sql("CREATE DATABASE IF NOT EXISTS tidemark_ddl")
    made = []
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        spark.sql(f"DROP TABLE IF EXISTS tidemark_ddl.{t}")
        spark.sql(types.create_table(f"tidemark_ddl.{t}", read(spark, sf_dir, t).schema, "it's a copy"))
    for t, schema in catalog.describe_all(spark, "tidemark_ddl").items():
        made += [(t, f.name, f.dataType.simpleString()) for f in schema]
    return spark.createDataFrame(made, "table_name string, column_name string, type_name string")


@query("SELECT * FROM (VALUES ('NUMBER(12,2)', 'decimal(12,2)'), ('NUMBER', 'decimal(38,10)'), ('VARCHAR2(40)', 'string'), ('INT UNSIGNED', 'bigint'), ('BIGINT UNSIGNED', 'decimal(20,0)'), ('TINYINT', 'tinyint'), ('DOUBLE PRECISION', 'double'), ('BYTEA', 'binary'), ('MONEY', 'decimal(19,4)'), ('UUID', 'string')) t(vendor, type_name)")
def vendor_types(spark, sf_dir):
    names = ["NUMBER(12,2)", "NUMBER", "VARCHAR2(40)", "INT UNSIGNED", "BIGINT UNSIGNED", "TINYINT", "DOUBLE PRECISION", "BYTEA", "MONEY", "UUID"]
    return spark.createDataFrame([(n, types.spark_type(n).simpleString()) for n in names], "vendor string, type_name string")
