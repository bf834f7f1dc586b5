import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(values, names):
    """Rows as sorted tuples with floats rounded."""

    def norm(v):
        if isinstance(v, float):
            return "nan" if v != v else round(v, 9) + 0.0
        if isinstance(v, list | tuple):
            return tuple(map(norm, v))
        return v

    return sorted((tuple(norm(r[n]) for n in names) for r in values), key=lambda x: tuple(map(str, x)))


@pytest.fixture(scope="session")
def same_as_oracle(duck):
    def check(df, sql):
        got = df.collect()
        names = sorted(df.columns)
        result = duck.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == names
        want = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
        assert rows_of(got, names) == rows_of(want, names)
        return len(got)

    return check
