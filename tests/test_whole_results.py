"""Queries give all their rows on tables larger than the smallest."""

from tests.conftest import SMALL, same_rows
from tidemark import queries, queries_runs
from tidemark.dialect.transpile import convert
from tidemark.sources import jdbc

LARGER = "/root/testdata/sf0.1"


def test_rewritten_view_is_not_capped(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{LARGER}/orders.parquet'")
    same_rows(queries.rewritten_view(spark, LARGER), c.sql(queries.ORACLE_SQL["rewritten_view"]))


def test_row_limit_is_rewritten():
    assert convert("SELECT a FROM t ORDER BY a FETCH FIRST 5 ROWS ONLY", "oracle", "spark").sql.strip() == "SELECT a FROM t ORDER BY a LIMIT 5"


_WHOLE_UPSERT = "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderkey % 211 = 0 AND o_orderkey + 10000000 NOT IN (SELECT o_orderkey FROM orders)"


def test_jdbc_upsert_has_all_orders(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{LARGER}/orders.parquet'")
    df = queries_runs.jdbc_upsert(spark, LARGER)
    same_rows(df, c.sql(_WHOLE_UPSERT))
    same_rows(df, c.sql(queries.ORACLE_SQL["jdbc_upsert"]))


def test_jdbc_upsert_where_a_lost_row_has_the_key_of_another(spark, tmp_path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE TABLE orders AS SELECT o.* REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey - 1 END AS o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS o_totalprice) FROM '{SMALL}/orders.parquet' o")
    c.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    df = queries_runs.jdbc_upsert(spark, str(tmp_path))
    same_rows(df, c.sql(_WHOLE_UPSERT))


def test_derby_updates_what_differs(spark):
    """Nulls too; texts, which Spark stages as large objects, are updated without a comparison."""
    url = "jdbc:derby:memory:differs;create=true"
    for kind in ("int", "string"):
        old, new = ([(1, None), (2, 5), (3, 6), (4, None), (5, 7)], [(1, 4), (2, None), (3, 6), (4, None), (6, 8)])
        table = f"{kind.upper()}_T"
        jdbc.execute(spark, url, f"CREATE TABLE {table} (ID INT NOT NULL PRIMARY KEY, V {'INT' if kind == 'int' else 'CLOB'})")
        as_df = lambda rows: spark.createDataFrame([(k, v if v is None or kind == "int" else str(v)) for k, v in rows], f"ID int, V {kind}")  # noqa: B023, E731
        jdbc.write_table(as_df(old), url, table)
        changed = jdbc.upsert_table(as_df(new), url, table, ["ID"], "derby")
        assert changed == (3 if kind == "int" else 5)
        assert {tuple(r) for r in jdbc.read_table(spark, url, table).collect()} == {tuple(r) for r in as_df([*new, (5, 7)]).collect()}
