"""Roots by Brent's method, regressions on any number of predictors, and both ends of a ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicube import numerics, registry
from lumicube.operators import statistics


def test_roots_and_steps_within_the_methods_bound():
    r = np.random.default_rng(1)
    n = 400
    at, k = r.uniform(-3, 3, n), r.integers(0, 5, n)
    kinds = [lambda d: d**3 + d, np.tanh, lambda d: np.expm1(np.clip(d, -50, 50)), lambda d: np.sign(d) * np.abs(d) ** 0.3, lambda d: d**9]
    f = lambda x: np.choose(k, [g(x - at) for g in kinds])
    lo, hi = at - r.uniform(0.1, 40, n), at + r.uniform(0.1, 40, n)
    found, steps = numerics.brent_roots(f, lo, hi)
    assert np.abs(found - at)[k != 4].max() < 1e-12 and np.abs(found - at)[k == 4].max() < 0.05
    bisections = np.log2((hi - lo) / (0.5 * numerics.MACHINE_EPSILON * np.abs(at)))
    assert (steps <= bisections**2).all()
    assert (steps[k < 3] < bisections[k < 3] / 2).all()
    count = [0]

    def counted(x):
        count[0] += 1
        return f(x)

    numerics.brent_roots(counted, lo, hi)
    assert count[0] == steps.max() + 2


def test_roots_at_ends_and_without_a_bracket():
    f = lambda x: np.array([x[0], x[1] - 2, x[2] ** 2 + 1, x[3] ** 2 + 1, x[4] - 1e-9])
    got = numerics.roots(f, np.array([0.0, 0.0, 1.0, -3.0, -1.0]), np.array([1.0, 2.0, 2.0, 2.0, 1.0]))
    assert got[:4].tolist() == [0.0, 2.0, 1.0, 2.0] and got[4] == pytest.approx(1e-9, rel=1e-12)


def regression(spark, x, y, keys, parts=3):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(*k, *map(float, v), None if w is None else float(w)) for k, v, w in zip(keys, x.tolist(), y, strict=True)]
    df = spark.createDataFrame(rows, f"key string, {', '.join(f'{n} double' for n in names)}, y double").repartition(parts)
    return {r["key"]: r for r in statistics.multi_regression(df, ["key"], names, "y").collect()}


@pytest.mark.parametrize("held", [1, 10_000])
def test_regression_is_numpys(spark, monkeypatch, held):
    monkeypatch.setattr(statistics, "HELD_KEYS", held)
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 6)) * [1, 10, 1e-3, 5, 1, 1]
    x[:, 4] = x[:, 0] * 2 - x[:, 3]
    y = x @ [1, 2, 3, 4, 5, 6] + r.normal(size=300)
    keys = [(k,) for k in r.choice(["a", "b", None], 300)]
    got = regression(spark, x, y, keys)
    assert set(got) == {"a", "b", None}
    for k, row in got.items():
        own = [i for i in range(300) if keys[i][0] == k]
        want, _, rank, s = np.linalg.lstsq(x[own], y[own], rcond=None)
        assert row["rank"] == rank == 5 and row["n"] == len(own)
        np.testing.assert_allclose(row["coefficients"], want, rtol=1e-7)
        np.testing.assert_allclose(row["singular_values"][:5], s[:5], rtol=1e-9)
        assert row["residual"] == pytest.approx(((y[own] - x[own] @ want) ** 2).sum(), rel=1e-8)


def test_regression_takes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = np.array([[1.0, 2.0], [2.0, 1.0], [nan, 1.0], [inf, 1.0], [1.0, 1.0], [0.0, 0.0], [3.0, 6.0]])
    got = regression(spark, x, [5.0, 4.0, 1.0, 1.0, None, 7.0, 5.0], [("a",), ("a",), ("a",), ("c",), ("a",), ("b",), ("d",)])
    assert set(got) == {"a", "b", "d"}
    assert got["a"]["n"] == 2 and got["a"]["coefficients"] == pytest.approx([1.0, 2.0])
    assert got["b"]["rank"] == 0 and got["b"]["coefficients"] == [0.0, 0.0] and got["b"]["residual"] == pytest.approx(49.0)
    assert got["d"]["rank"] == 1 and got["d"]["coefficients"] == pytest.approx([1 / 3, 2 / 3])  # fewer rows than predictors
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    (row,) = statistics.multi_regression(df, [], ["x"], "y").collect()
    assert row["coefficients"] == pytest.approx([2.0]) and row["n"] == 2
    assert statistics.multi_regression(df.limit(0), [], ["x"], "y").count() == 0


def test_both_ends_of_each_key(spark):
    r = np.random.default_rng(3)
    rows = [(k, i, float(v)) for k, n in (("a", 40), ("b", 7), ("c", 6), (None, 9)) for i, v in enumerate(r.integers(0, 8, n))]
    df = spark.createDataFrame(rows, "product_id string, i int, v double")
    got = {(x["product_id"], x["i"], x["end"]) for x in statistics.extremes(df, "v", 3, ["i"]).collect()}
    want = set()
    for k in ("a", "b"):
        own = sorted((v, i) for p, i, v in rows if p == k)
        want |= {(k, i, "low") for _, i in own[:3]} | {(k, i, "high") for _, i in own[-3:]}
    assert got == want
    plan = statistics.extremes(df, "v", 3, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


NEW = "roots_brent multi_regression multi_regression_dependent min_brack_min_brent_powell minima_by_event row_flip resample_weight join_neighbours neighbour_window_3x3 lag_across_track box_mean box_window adjacency_correction spiky_pixels"


@pytest.mark.parametrize("name", NEW.split())
def test_oracle(spark, data, same_as_oracle, name):
    assert same_as_oracle(registry.queries()[name](spark, data), registry.oracle_sql()[name]) > 0
