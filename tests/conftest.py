import datetime
import decimal
import os
import sys

import duckdb
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    d = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"{d}/checkpoint", "spark.sql.warehouse.dir": f"{d}/warehouse"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the driver's tables are not here")
    return d


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Assert that a DataFrame and a SQL text give the same rows under the same column names."""

    def check(df, sql):
        columns = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect())
        out = duck.execute(sql)
        names = [c[0] for c in out.description]
        assert sorted(names) == columns
        want = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
        assert got == want

    return check
