import pytest

from tests.conftest import SMALL, same_rows
from tidemark import queries, queries_runs, queries_sql  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert name in queries.ORACLE_SQL
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries())
