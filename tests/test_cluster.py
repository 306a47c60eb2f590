"""Queries over an embedded database, with executors in processes of their own."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

from tests.conftest import SMALL, plain

#: The three queries; then types and nulls, an overwritten table, an empty one, and several pages.
_RUN = """
import json, sys
from datetime import date, datetime
from decimal import Decimal
from pyspark.sql import SparkSession
import __spark_entry__
from tidemark.sources import jdbc
top, small = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{top}/shared", "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
out = {q: [list(map(str, r)) for r in __spark_entry__.queries()[q](spark, small).collect()] for q in ("identity_reseeded", "jdbc_scan", "jdbc_upsert")}
url = "jdbc:derby:memory:odd;create=true"
rows = [(1, "it's", Decimal("1.50"), date(2024, 2, 29), datetime(2024, 3, 1, 8, 0, 0, 5), True, 2**40, b"ab"), (2,) + (None,) * 7]
df = spark.createDataFrame(rows, "ID int, A string, B decimal(9,2), C date, D timestamp, E boolean, F long, G binary")
for _ in range(2):
    jdbc.write_table(df, url, "ODD", "overwrite")
out["odd"] = sorted(map(tuple, jdbc.read_table(spark, url, "ODD").collect()), key=lambda r: r[0]) == [r[:7] + (r[7] and bytearray(r[7]),) for r in rows]
jdbc.write_table(df.where("ID > 9"), url, "NONE_T")
out["none"] = [jdbc.read_table(spark, url, "NONE_T").count(), jdbc.key_bounds(spark, url, "NONE_T", "ID")]
jdbc.PAGE_ROWS = 700
jdbc.write_table(spark.range(1, 5001).toDF("ID"), url, "MANY")
out["many"] = [jdbc.read_table(spark, url, "MANY").distinct().count(), jdbc.key_bounds(spark, url, "MANY", "id")]
print("\\nFOUND " + json.dumps(out))
"""


def test_embedded_database_on_a_cluster(duck, tmp_path):
    home = tmp_path / "home"  # executors work below Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": top, "PYSPARK_PYTHON": sys.executable, "TZ": "UTC"}
    run = subprocess.run([sys.executable, "-c", _RUN, str(tmp_path), SMALL], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    told = [x for x in run.stdout.splitlines() if x.startswith("FOUND ")]
    assert told, run.stderr[-3000:]
    found = json.loads(told[0][6:])
    from __spark_entry__ import oracle_sql

    for q in ("identity_reseeded", "jdbc_scan", "jdbc_upsert"):
        number = lambda v: plain(float(v)) if v.replace(".", "").replace("-", "").replace("E", "").isdigit() else v
        assert sorted([number(v) for v in r] for r in found[q]) == sorted([plain(v) for v in r] for r in duck.sql(oracle_sql()[q]).fetchall()), q
    assert found["odd"] and found["none"] == [0, None] and found["many"] == [5000, [1, 5000]]
