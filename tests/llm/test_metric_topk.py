"""Exact top-k against brute force in whole numbers, the tree's bounds, and the edge cases of the docstring."""

import math
import random

import numpy as np
import pytest

from lumicube.llm import metric_topk as M

SCHEMA = "vec_id long, embedding array<double>, label int, part int, score long, kind string, n long, turn int"  # clashing names


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "k", 4, 5) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    whole = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows]
    by = {}
    for i, v in queries:
        w = [math.floor(256.0 * x) for x in v]
        by[i] = min(by.get(i, w), w)
    out = []
    for i, q in by.items():
        scores = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in whole if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.fixture
def small(monkeypatch):
    """Parts and pages of a few rows, so that a few hundred rows make a tree with several rounds."""
    for name, value in (("SHELF_BYTES", 20 * 64), ("PAGE_BYTES", 4 * 64), ("WIDEN", 3), ("ROUTED", 50)):
        monkeypatch.setattr(M, name, value)


def vectors(seed, n, dim=8):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * r.choice([0.1, 1, 5], size=(n, 1)) + r.integers(0, 4, (n, 1)) * 2
    x[: n // 3] = x[0]  # a third of all rows are copies
    return [(int(i), v) for i, v in zip(r.permutation(n), x.tolist(), strict=True)]


def test_exact_in_a_deep_tree(spark, small):
    rows = vectors(1, 400)
    queries = [r for r in rows if r[0] % 7 == 0]
    assert found(M.top_products(table_of(spark, rows).repartition(3), table_of(spark, queries))) == brute(rows, queries, 5)


@pytest.mark.parametrize("k", [1, 3, 200])
def test_exact_with_few_candidates(spark, k):
    rows = vectors(2, 60)
    assert found(M.top_products(table_of(spark, rows), table_of(spark, rows[:9]), k)) == brute(rows, rows[:9], k)


def test_scores_beyond_double_precision_are_exact(spark, small):
    r = random.Random(3)
    rows = [(k, [r.choice([1.0, 3.0, 1e5, 1e5 + 1, 2.5e7, -2.5e7]) * 1.0 for _ in range(8)]) for k in range(50)] + [(90, [1e200] * 8), (91, [1e305] * 7 + [1.0])]
    rows[-1] = (91, [-1e200] + [1e200] * 7)
    assert found(M.top_products(table_of(spark, rows), table_of(spark, rows[:10] + rows[-1:]))) == brute(rows, rows[:10] + rows[-1:], 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, []), (7, [1.7e308, 0.0])]
    rows = [(10, [0.0, 0.0]), (11, [1.0, 0.5]), (12, [1.0, 0.5]), (12, [1.0, 0.5]), (13, [-1.0, 0.001]), (14, [-0.001, 0.2])]
    got = found(M.top_products(table_of(spark, odd + rows), table_of(spark, odd + rows + [(13, [-2.0, 0.0])])))
    assert got == brute(rows, rows + [(13, [-2.0, 0.0])], 5)
    assert M.top_products(table_of(spark, rows).limit(0), table_of(spark, rows)).count() == 0
    assert M.top_products(table_of(spark, rows), table_of(spark, rows).limit(0)).count() == 0
    assert M.top_products(table_of(spark, rows[:1]), table_of(spark, rows[:1])).count() == 0
    assert M.top_products(table_of(spark, odd[:4]), table_of(spark, odd[:4])).count() == 0


def test_bounds_hold_and_save_work():
    r = np.random.default_rng(4)
    x = np.floor(256 * (r.normal(size=(4000, 6)) * 0.05 + r.integers(0, 12, (4000, 1)) * r.normal(size=(12, 6))[r.integers(0, 12, 4000)]))
    shelf, root, ids = [], x.mean(axis=0).round(), np.arange(len(x))
    for pivot, own in M.pages(ids, x, 64):
        to = M.distances(x[own], pivot[None])[:, 0]
        shelf.append(M.Page(pivot, float(M.distances(pivot[None], root[None])[0, 0]), float(to.max()), float(np.sqrt((x[own] ** 2).sum(axis=1)).max()), ids[own], x[own], to))
    assert sorted(np.concatenate([p.ids for p in shelf]).tolist()) == ids.tolist() and max(len(p.ids) for p in shelf) <= 64
    q = x[::97]
    for p in shelf:
        bound = M.upper_bounds(q, p.pivot[None], M.distances(q, p.pivot[None]), np.array([p.radius]), np.array([p.norm]))
        assert ((q @ p.x.T).max(axis=1) <= bound[:, 0]).all()
    best, computed = M.search_shelf(shelf, root, ids[::97], q, np.full(len(q), M.NONE, np.int64), 5)
    s = (q @ x.T).astype(np.int64)
    s[np.arange(len(q)), ids[::97]] = M.NONE
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s.astype(float)), axis=1)[:, :5]
    assert (best.ids == want).all() and computed < 0.5 * s.size


def test_registered_query(spark, data, same_as_oracle):
    from lumicube.llm import queries

    assert same_as_oracle(queries.QUERIES["op13_exact_topk"](spark, data), queries.ORACLE_SQL["op13_exact_topk"]) > 0
