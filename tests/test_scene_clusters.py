"""Clusters of many scenes against those of each scene alone, and what ends a scene's iteration."""

import numpy as np
import pytest

from lumicube import registry
from lumicube.operators import clustering
from lumicube.operators import scene_clusters as many
from lumicube.params import ClusterParams


def scenes(r, sizes):
    rows = []
    for name, n in sizes.items():
        centres = r.normal(size=(3, 2)) * 4
        x = centres[r.integers(0, 3, n)] + r.normal(size=(n, 2))
        rows += [(name, i, *map(float, v)) for i, v in enumerate(x)]
    return rows


@pytest.mark.parametrize("block,broadcast", [(7, 20_000), (4096, 0)])
def test_many_scenes_are_each_scene_alone(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(many, "BLOCK", block)
    monkeypatch.setattr(many, "MAX_BROADCAST_STATES", broadcast)
    rows, params = scenes(np.random.default_rng(1), {"a": 300, "b": 40, "c": 90}), ClusterParams(clusters=3, iterations=6)
    df = spark.createDataFrame(rows, "scene string, index long, f double, g double").repartition(5)
    got = {(x["scene"], x["k"]): x for x in many.find_clusters(df, ["f", "g"], many.initial_states(df, ["f", "g"], params), 6).collect()}
    assert len(got) == 9
    for name in "abc":
        own = df.filter(f"scene = '{name}'")
        want = clustering.find_clusters(own, ["f", "g"], clustering.initial_clusters(own, ["f", "g"], "index", params), 6)
        for k, c in enumerate(want):
            x = got[name, k]
            np.testing.assert_allclose([*x["mean"], *x["variance"], x["prior"]], [*c.mean, *c.variance, c.prior], rtol=1e-9)
            assert x["rounds"] == 6 and not x["lost"]


def test_scenes_stop_on_their_own(spark):
    r = np.random.default_rng(2)
    rows = scenes(r, {"moves": 200}) + [("rests", i, float(i % 2), float(i % 3)) for i in range(60)] + [("flat", i, 1.0, float(i)) for i in range(30)]
    rows += [(None, 0, 1.0, 1.0), ("moves", 200, float("nan"), 1.0), ("moves", 201, None, 1.0)]
    df = spark.createDataFrame(rows, "scene string, index long, f double, g double")
    sound = df.filter("scene IS NOT NULL AND f IS NOT NULL AND NOT isnan(f)")
    states = many.initial_states(sound, ["f", "g"], ClusterParams(clusters=2, iterations=8))
    got = {}
    for x in many.find_clusters(df, ["f", "g"], states, 8, tolerance=1e-3).collect():
        got.setdefault(x["scene"], []).append(x)
    assert set(got) == {"moves", "rests", "flat"} and all(len(v) == 2 for v in got.values())
    assert all(x["lost"] and x["rounds"] == 0 and x["variance"] == [1.0, 1.0] for x in got["flat"])  # no variance in f
    assert got["rests"][0]["rounds"] <= 8 and all(abs(sum(x["prior"] for x in v) - 1) < 1e-9 for v in got.values())
    assert many.find_clusters(df.limit(0), ["f", "g"], states, 3).count() == 0
    assert many.find_clusters(df, ["f", "g"], states.limit(0), 3).count() == 0


def test_registered_query(spark, data, same_as_oracle):
    assert same_as_oracle(registry.queries()["find_clusters_scenes"](spark, data), registry.oracle_sql()["find_clusters_scenes"]) == 28


def test_scenes_that_lose_a_cluster_follow_the_sql(spark, data, tmp_path):
    """The second scene has six pixels, fewer than clusters."""
    import duckdb

    from tests.conftest import rows_of

    spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id < 256").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["find_clusters_scenes"])
    names = [c[0] for c in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    got = registry.queries()["find_clusters_scenes"](spark, str(tmp_path)).collect()
    assert rows_of(got, names) == rows_of(want, names) and any(r["m0"] != r["m0"] for r in got)


def test_a_small_variance_survives_blocks(spark, monkeypatch):
    """Two clusters a thousand apart which have variances of 2.5e-15, in blocks of three pixels."""
    monkeypatch.setattr(many, "BLOCK", 3)
    df = spark.createDataFrame([("a", i, 1000.0 * (i % 2) + 1e-7 * (i % 4 // 2)) for i in range(40)], "scene string, index long, f double")
    states = spark.createDataFrame([("a", 0, False, False, [1.0, 999.0], [1.0, 1.0], [0.5, 0.5])], many.STATE)
    rows = many.find_clusters(df, ["f"], states, 1).collect()
    np.testing.assert_allclose([r["variance"][0] for r in rows], 2.5e-15, rtol=0.01)
