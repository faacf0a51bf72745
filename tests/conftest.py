import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, tables):
    """Whether a query and its SQL give the same rows, columns by name."""

    def check(query, sql):
        df = query(spark, DATA)
        rows = [tuple(r) for r in df.collect()]
        result = tables.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        ours = sorted((tuple(r[df.columns.index(c)] for c in order) for r in rows), key=repr)
        theirs = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=repr)
        assert ours == theirs
        return rows

    return check
