from datetime import datetime

import pytest
from pyspark.sql import types as T

from tidemark.dialect import text
from tidemark.dialect.transpile import convert, page_sql, view_body
from tidemark.dialect.types import add_columns, create_table, default_literal, spark_type
from tidemark.etl import variables
from tidemark.parsers import ddl, redo, test_decoding
from tidemark.parsers.transactions import BranchError, PreparedBranch, committed


@pytest.mark.parametrize(
    "dialect, script, wanted",
    [
        ("spark", "select 1; ; select ';' ;-- a;b\n select 2", ["select 1", "select ';'", "-- a;b\n select 2"]),
        ("mysql", "select 'a\\';b'; # x;y\nselect `c;d`", ["select 'a\\';b'", "# x;y\nselect `c;d`"]),
        ("oracle", "select q'[a;']' from dual; select 2", ["select q'[a;']' from dual", "select 2"]),
        ("postgres", "select $f$a;b$f$; /* x /* ; */ ; */ select 2", ["select $f$a;b$f$", "/* x /* ; */ ; */ select 2"]),
        ("sqlserver", "select [a;b]; select 2;", ["select [a;b]", "select 2"]),
        ("oracle", "-- only a comment;", []),
    ],
)
def test_statements(dialect, script, wanted):
    assert text.statements(script, dialect) == wanted
    assert "".join(script[a:b] for _, a, b in text.parts(script, dialect)) == script


def test_outer_order_is_found_and_removed():
    assert text.without_order("select a from (select b order by c) t order by a") == "select a from (select b order by c) t"
    assert text.without_order("select a from t order by a limit 3").endswith("limit 3")
    assert text.without_order("select 'order by x' from t") == "select 'order by x' from t"


@pytest.mark.parametrize(
    "sql, source, target, wanted",
    [
        ('SELECT "a""b" FROM DUAL', "oracle", "spark", 'SELECT `a"b`'),
        ("SELECT TOP (3) a FROM t", "sqlserver", "spark", None),
        ("SELECT [a], LEN(x), ISNULL(a, 'ISNULL(') FROM [t]", "sqlserver", "spark", "SELECT `a`, char_length(x), coalesce(a, 'ISNULL(') FROM `t`"),
        ("SELECT CONVERT(VARCHAR(10), d) FROM t", "sqlserver", "spark", "SELECT CAST(d AS string) FROM t"),
        ("SELECT LENGTH(a), NOW(6) FROM t LIMIT 5, 10", "mysql", "spark", "SELECT OCTET_LENGTH(a), current_timestamp() FROM t LIMIT 10 OFFSET 5"),
        ("SELECT a::numeric(10,2) FROM t", "postgres", "spark", "SELECT a::decimal(10,2) FROM t"),
        ("SELECT NVL(a, b), SYSDATE FROM t", "oracle", "postgres", "SELECT COALESCE(a, b), CURRENT_TIMESTAMP FROM t"),
        ("SELECT DECODE(a, 1, 'x', 'y') FROM t", "oracle", "mysql", "SELECT CASE WHEN a = 1 THEN 'x' ELSE 'y' END FROM t"),
        ("SELECT DECODE(a, NULL, 'x') FROM t", "oracle", "mysql", None),
        ("SELECT a FROM t WHERE ROWNUM < 3", "oracle", "spark", None),
        ("SELECT a || b FROM t", "oracle", "mysql", None),
        ("SELECT a FROM t WHERE x = b(+)", "oracle", "spark", None),
        ("SELECT a->>'k' FROM t", "postgres", "spark", None),
        ("SELECT CAST(a AS mood) FROM t", "postgres", "spark", None),
        ("SELECT a FROM t WHERE f = TRUE LIMIT 3", "mysql", "oracle", "SELECT a FROM t WHERE f = 1 FETCH FIRST 3 ROWS ONLY"),
        ("SELECT a, count(*) FROM t GROUP BY a WITH ROLLUP", "mysql", "spark", "SELECT a, count(*) FROM t GROUP BY ROLLUP(a)"),
        ("SELECT EOMONTH(d, 1) FROM t", "sqlserver", "spark", "SELECT LAST_DAY(ADD_MONTHS(d, 1)) FROM t"),
        ("SELECT ISNULL(a) FROM t", "mysql", "oracle", "SELECT (a IS NULL) FROM t"),
    ],
)
def test_convert(sql, source, target, wanted):
    made = convert(sql, source, target)
    assert made.usable == (wanted is not None), made
    if wanted is not None:
        assert made.sql == wanted


def test_convert_leaves_its_own_dialect_and_views_alone():
    assert convert("SELECT  NVL(a,b)", "oracle", "oracle").sql == "SELECT  NVL(a,b)"
    assert view_body("create or replace view v (a) as select 1;") == "select 1"
    assert page_sql("SELECT a FROM t", "oracle", 10, 20).count("ROWNUM") == 2


@pytest.mark.parametrize(
    "vendor, wanted",
    [("NUMBER(12,2)", T.DecimalType(12, 2)), ("int unsigned", T.LongType()), ("BIGINT UNSIGNED", T.DecimalType(20, 0)), ("TIMESTAMP(6) WITH TIME ZONE", T.TimestampType()), ("timestamp(3)", T.TimestampNTZType()), ("time", T.StringType()), ("BIT(12)", T.IntegerType()), ("bit", T.BooleanType()), ("FLOAT", T.DoubleType()), ("money", T.DecimalType(19, 4)), ("jsonb", T.StringType()), ("geometry", T.BinaryType()), ("MYBLOBTYPE", T.BinaryType()), ("whatever", T.StringType()), ("INTERVAL DAY TO SECOND", T.StringType())],
)
def test_types(vendor, wanted):
    assert spark_type(vendor) == wanted


def test_ddl_text(spark):
    schema = T.StructType([T.StructField("a`b", T.LongType(), False), T.StructField("c", T.StringType(), True, {"remarks": "it's"})])
    spark.sql(create_table("ddl_text", schema))
    assert spark.table("ddl_text").columns == ["a`b", "c"]
    assert "ADD COLUMNS (`c` string)" in add_columns("t", schema[1:])
    assert [default_literal(v, T.LongType()) for v in ("((5))", "'7'", "nextval('x')", None)] == ["5", "7", None, None]
    assert default_literal("'a''b'", T.StringType()) == "'a\\'b'" and default_literal("now()", T.TimestampType()) == "current_timestamp()"


def test_variables():
    assert variables.definitions("a = 1\n\n b=x=y ") == {"a": "1", "b": "x=y"}
    for bad in ("a", "=1", "1a=2", "DATE=3", "a=1\na=2", "a=" + "x" * 4001):
        with pytest.raises(variables.VariableError):
            variables.definitions(bad)
    values = variables.built_in(datetime(2024, 3, 1, 4, 5, 6), "t", "d.x", 3)
    assert variables.substitute("${date} ${datetime} ${yesterday} ${month} ${year} ${runIndex} ${targetTable}", values) == "2024-03-01 2024-03-01 04:05:06 2024-02-29 2024-03 2024 3 d.x"
    assert variables.substitute("${a}", {"a": "${b}", "b": "no"}) == "${b}"
    with pytest.raises(variables.VariableError):
        variables.substitute("${nope}", values)


def test_decoding_lines():
    p = test_decoding.parse
    assert p("BEGIN 77").xid == 77 and p("noise").kind == "OTHER"
    line = p("""table public."odd table": INSERT: id[integer]:1 "na[me"[character varying(10)]:'it''s x[1]:2' f[boolean]:true n[text]:null""")
    assert line.table == "public.odd table" and line.new == {"id": "1", "na[me": "it's x[1]:2", "f": "1", "n": None}
    line = p("table public.t: UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 v[text]:'new-tuple: x'")
    assert (line.old, line.new) == ({"id": "1"}, {"id": "2", "v": "new-tuple: x"})
    assert p("table public.t: UPDATE: id[integer]:2 v[text]:unchanged-toast-datum").refused
    assert p("table public.t: INSERT: id[integer]:2 v[integer[]]:'{1,2}'").refused
    assert p("table public.t: DELETE: id[integer]:2 v[integer[]]:'{1,2}'").old == {"id": "2"}
    assert p("table public.t: DELETE: (no-tuple-data)").refused and p("table public.t: INSERT: id").refused == "malformed"


def test_redo_statements():
    c = redo.parse("""insert into "A"."T"("ID","N","B","D","Q") values ('1','it''s, (x)',HEXTORAW('0aff'),TO_DATE('2024-01-01','YYYY-MM-DD'),q'[a'b, c]');""", ["ID"])
    assert (c.op, c.table, c.row) == ("INSERT", "A.T", {"ID": "1", "N": "it's, (x)", "B": b"\n\xff", "D": "2024-01-01", "Q": "a'b, c"})
    c = redo.parse("""update "T" set "ID" = '2', "N" = NULL where "ID" = '1' and "N" IS NULL and "Z" = STRANGE(1) and ROWID = 'AAB'""", ["ID"])
    assert c.row == {"ID": "2", "N": None, "Z": "STRANGE(1)"} and c.previous_key == {"ID": "1"}
    assert redo.parse("delete from T where ID = 5", ["ID"]).previous_key == {"ID": "5"}
    for bad in ("select 1", "insert into T(A,B) values (1)", "update T set A = 1 where B = 2", "update T set A = OUT_CLOB where ID = 1", "insert into T(ID) values (F(1))"):
        with pytest.raises(redo.Refused):
            redo.parse(bad, ["ID"])
    with pytest.raises(redo.Refused):
        redo.parse("insert into T(ID) values (1)", ["ID"], ["ID", "MEMO"])
    assert redo.literal("DATE'2024-01-01'") == "2024-01-01" and redo.literal("N'ü'") == "ü" and redo.literal("EMPTY_BLOB()") == b"" and redo.literal("0x") == b""


def test_structure_changes():
    sql = "ALTER TABLE `s`.`t` ADD COLUMN a DECIMAL(10,2) DEFAULT 0, ADD (b INT, c VARCHAR(9)), DROP COLUMN d, ADD INDEX i (a), MODIFY e INT"
    assert ddl.altered_table(sql) == "s.t" and ddl.added_columns(sql) == ["a", "b", "c"] and ddl.dropped_columns(sql) == ["d"] and len(ddl.clauses(sql)) == 5
    assert ddl.leaves_gap(sql) and not ddl.leaves_gap("ALTER TABLE t ADD a INT") and ddl.is_structural("create unique index i on t(a)") and not ddl.is_structural("insert into t values (1)")
    assert ddl.retargeted(sql, "s.t", "`x`").startswith("ALTER TABLE `x` ADD COLUMN a")


def test_transactions():
    events = [("BEGIN", "1", None), ("CHANGE", "1", "a"), ("SAVEPOINT", "1", "s"), ("CHANGE", "1", "b"), ("ROLLBACK_TO", "1", "s"), ("CHANGE", "1", "c"), ("COMMIT", "1", None), ("BEGIN", "2", None), ("CHANGE", "2", "x"), ("BEGIN", "3", None), ("CHANGE", "3", "y"), ("COMMIT", "3", None), ("BEGIN", "4", None), ("ROLLBACK", "4", None)]
    assert list(committed(events)) == [("1", ["a", "c"]), ("3", ["y"])]
    branch = PreparedBranch()
    branch.add("x", 1)
    with pytest.raises(BranchError):
        branch.add("y", 2)
    assert branch.commit("x") == [1]
    branch.rollback("x")
