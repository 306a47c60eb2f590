import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(top / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(top / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(value):
    """One spelling for equal values of the two engines."""
    import math

    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple") or hasattr(value, "dtype") and value.dtype.kind in "iuf":
        return round(float(value), 6)
    return str(value)


def same_rows(df, relation):
    ours, theirs = df.toPandas(), relation.df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[columns].itertuples(index=False)), key=repr)
    assert rows(ours) == rows(theirs)
