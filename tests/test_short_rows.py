"""Queries against their SQL on an image whose last row is short."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumicube import registry
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def short(spark, data, tmp_path_factory):
    """110 vectors: ten columns have five rows, fifteen have four."""
    out = str(tmp_path_factory.mktemp("short"))
    spark.read.parquet(f"{data}/embeddings.parquet").filter(F.col("vec_id") < 110).coalesce(1).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", ["box_mean", "box_window", "adjacency_correction", "join_neighbours", "column_order_statistics", "adaptive_threshold", "column_log_ratio_mean", "apply_destriping_factors"])
def test_short_last_row(spark, short, name):
    rows = registry.queries()[name](spark, short)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{short}/embeddings.parquet/*.parquet'")
    got, want = rows.collect(), con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert rows_of(got, names) == rows_of(want, names) and got
