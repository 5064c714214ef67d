import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else (0.0 if v == 0 else v)
    return v


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with SQL: columns by name, rows in any order."""
    def check(df, sql):
        cols = sorted(df.columns)
        ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
        rel = duck.sql(sql)
        names = rel.columns
        assert sorted(names) == cols
        theirs = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in cols)) for r in rel.fetchall())
        assert ours == theirs

    return check
