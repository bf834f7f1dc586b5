"""Aerosol thickness against plain loops and a search of its own, the table in all axes, and the batched solvers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicube import numerics, registry
from lumicube.operators import aerosol, radiative
from lumicube.plans import catalog_aerosol as c
from lumicube.sources.testdata import BANDS

WL = np.array([b.wavelength for b in BANDS])


# Solvers ----------------------------------------------------------------------------------------------------


def test_batched_lines_are_those_of_single_functions():
    r = np.random.default_rng(1)
    at, k = r.uniform(-30, 30, 40), r.uniform(0.1, 3, 40)
    one = [lambda t, a=a, b=b: float(b * (t - a) ** 2 + np.sin(t - a) * 0.1) for a, b in zip(at, k, strict=True)]
    many = lambda t, rows: k[rows] * (t - at[rows]) ** 2 + np.sin(t - at[rows]) * 0.1
    found = numerics.brackets(many, np.zeros(40), np.ones(40))
    want = np.array([numerics.bracket_minimum(f, 0.0, 1.0) for f in one]).T
    assert np.allclose(found, want)
    x, fx = numerics.minima(many, *found)
    assert np.allclose(x, [numerics.minimum(f, *b) for f, b in zip(one, want.T, strict=True)], atol=1e-6)
    assert np.allclose(fx, many(x, np.arange(40)))


def test_batched_powell_finds_the_minima():
    r = np.random.default_rng(2)
    m = r.normal(size=(30, 4, 4))
    q, at = m @ m.transpose(0, 2, 1) + np.eye(4) * 0.2, r.normal(size=(30, 4)) * 3
    f = lambda x, rows: np.einsum("ri,rij,rj->r", x - at[rows], q[rows], x - at[rows]) + 1
    x, fx = numerics.minima_powell(f, np.zeros((30, 4)), accuracy=1e-14)
    assert np.abs(x - at).max() < 1e-4 and np.abs(fx - 1).max() < 1e-8
    valley = lambda x, rows: (1 - x[:, 0]) ** 2 + 100 * (x[:, 1] - x[:, 0] ** 2) ** 2
    x, _ = numerics.minima_powell(valley, np.array([[-1.2, 1.0], [3.0, -2.0]]))
    assert np.abs(x - 1).max() < 1e-3


# The table in all axes --------------------------------------------------------------------------------------


def test_table_at_many_places_is_the_table_at_each():
    t = radiative.stand_in_table(step=50.0)
    r = np.random.default_rng(3)
    names = ("vza", "sza", "alt", "aot", "ada", "cwv")
    points = {n: np.concatenate((r.uniform(t.axes[n][0] - 1, t.axes[n][-1] + 1, 60), t.axes[n][[0, -1]])) for n in names}
    many = t.many(points)
    for k in range(62):
        one = t.at(**{n: float(points[n][k]) for n in names})
        for v in ("lpw", "egl", "sab", "rat"):
            assert np.allclose(getattr(many, v)[k], getattr(one, v), rtol=1e-12)


def test_with_table_takes_odd_rows(spark):
    t = c.banded()
    rows = spark.createDataFrame([(1, 10.0, 0.2), (2, None, 0.2), (3, float("nan"), 0.2), (4, 1e9, -5.0)], "lpw_id long, angle double, `odd name` double")
    at = {n: F.col("angle") if n == "vza" else F.col("odd name") if n == "aot" else F.lit(1.0) for n in ("vza", "sza", "ada", "alt", "aot", "cwv")}
    got = {x["lpw_id"]: x for x in radiative.with_table(rows, t, at).collect()}
    assert len(got[1]["lpw"]) == len(BANDS) and np.isfinite(got[1]["egl"]).all() and np.isnan(got[2]["lpw"]).all() and np.isnan(got[3]["sab"]).all()
    assert np.allclose(got[4]["lpw"], t.at(60.0, 1.0, 1.0, 0.05, 1.0, 1.0).lpw)
    assert radiative.with_table(rows.limit(0), t, at).count() == 0


# Thickness --------------------------------------------------------------------------------------------------


def plain_bound(dark, path, nodes):
    """dark: list of ranks, each a list of (view, band, value)."""

    def over(aot):
        lpw = path(aot)
        return sum(any(v <= lpw[k][b] for k, b, v in rank) for rank in dark) == len(dark)

    j = 0
    while j < len(nodes):
        j += 1
        if over(nodes[j - 1]):
            break
    start = max(j - 2, 0)
    if start == 0:
        return nodes[0]
    j = 1
    while nodes[start] + j * 0.005 <= nodes[-1]:
        stop = over(nodes[start] + j * 0.005)
        j += 1
        if stop:
            break
    return nodes[start] + (j - 2) * 0.005


def views_of(pixels, views):
    by = {v["product_id"]: (v.asDict(), []) for v in views.collect()}
    for p in pixels.orderBy("y", "x").collect():
        if p["product_id"] in by and p["valid"]:
            by[p["product_id"]][1].append(list(p["radiance"]))
    return by


def best_fit(ref, t, vegetation, soil):
    """Least misfit of five pixels at one thickness, each by Newton steps on two shares, or on one of them alone."""
    weight = np.where(WL > 850, 0, 1000 / WL)
    weight[0] = 0.0
    total = 0.0
    for w, spectrum in zip(aerosol.WEIGHTS, ref, strict=True):
        tries = []
        for on in ((0, 1), (0,), (1,), ()):
            ends = np.array([vegetation, soil])[list(on)].reshape(len(on), len(WL))
            x = np.full(len(on), 0.5)
            for _ in range(8 if on else 0):
                s = x @ ends
                toa = t.lpw + s * t.egl / np.pi / (1 - t.sab * s)
                slope = ends * t.egl / np.pi / (1 - t.sab * s) ** 2
                x = x + np.linalg.lstsq((slope * np.sqrt(weight)).T, np.sqrt(weight) * (spectrum - toa), rcond=None)[0]
            if (x >= 0).all():
                s = x @ ends if on else np.zeros(len(WL))
                tries.append((weight * (spectrum - t.lpw - s * t.egl / np.pi / (1 - t.sab * s)) ** 2).sum())
        total += w * min(tries)
    return total


def plain_land(view, spectra, n_views, table):
    """Bound and thickness of one view by a grid of thicknesses."""
    at = {k: view[k] for k in aerosol.ANGLES}
    nodes = table.axes["aot"]
    x = np.array(spectra)
    seen = [k for k in range(len(WL)) if 420 <= WL[k] <= 690]
    smallest = np.sort(np.where(x > 0, x, np.inf), axis=0)[: 100 // n_views]
    most = plain_bound([[(0, b, rank[b]) for b in seen] for rank in smallest], lambda a: [table.at(**at, aot=a).lpw], nodes)
    red, nir = next(k for k, w in enumerate(WL) if w > 670), next(k for k, w in enumerate(WL) if w > 785)
    ndvi = (x[:, nir] - x[:, red]) / (x[:, nir] + x[:, red])
    pick = lambda lo, hi, sign: [x[k] for k in np.argsort(sign * ndvi, kind="stable") if lo < ndvi[k] < hi]
    dense, medium, sparse = pick(0.4, 0.9, -1), pick(0.1, 0.4, -1), pick(0.01, 0.1, 1)
    if most == nodes[0]:
        return most, most
    if len(dense) < 2 or len(medium) < 3:
        return most, min(most, 0.2)
    vegetation, soil = aerosol.endmembers(BANDS)
    inner = nodes[0] + (most - nodes[0]) * np.arange(10) / 9
    found = []
    for i in range(min(len(dense) // 2, len(medium) // 3, 5)):
        ref = [*dense[2 * i : 2 * i + 2], *medium[2 * i : 2 * i + (2 if i < len(sparse) else 3)], *sparse[i : i + 1]]
        grid = np.linspace(nodes[0], most, 62)[1:-1]
        cost = []
        for a in grid:
            k = min(int((a > inner).sum()) - 1, 8)
            g = (a - inner[k]) / (inner[k + 1] - inner[k])
            lo, hi = (table.at(**at, aot=float(v)) for v in inner[k : k + 2])
            t = type(lo)(*(getattr(lo, n) * (1 - g) + getattr(hi, n) * g for n in ("lpw", "egl", "sab", "rat")))
            cost.append([best_fit(ref, t, v, soil) for v in vegetation])
        cost = np.array(cost)
        found.append(grid[cost.min(axis=1).argmin()])
    found = np.array(found)
    if len(found) > 1:
        found = found[np.abs(found - found.mean()) <= 1.5 * found.std(ddof=1)]
    return most, found.mean()


def test_registered_land_query_against_a_grid(spark, data):
    pixels, views = c.land_scenes(spark, data)
    by, table = views_of(pixels, views), c.banded()
    got = {x["product_id"]: x for x in registry.queries()["aot_land_views"](spark, data).collect()}
    assert got.keys() == by.keys() and {x["origin"] for x in got.values()} == {"fitted"}
    for name in sorted(by)[:1]:
        most, aot = plain_land(*by[name], len(by), table)
        assert got[name]["aot_max"] == pytest.approx(most, abs=1e-6) and got[name]["aot550"] == pytest.approx(aot, abs=0.012)
    assert all(abs(x["aot550"] - 0.12) < 0.01 for x in got.values())  # the simulated one


@pytest.mark.parametrize("name", ["aot_water_views", "aot_water_joint", "lut_interpolation"])
def test_oracle(spark, data, same_as_oracle, name):
    assert same_as_oracle(registry.queries()[name](spark, data), registry.oracle_sql()[name]) > 0


def flat_views(spark, sets):
    rows = [(s, f"{s}{v}", 20.0, 40.0, 0.0, 0.0, 1.0, 55.0) for s, n in sets.items() for v in range(n)]
    return spark.createDataFrame(rows, "set_id string, product_id string, vza double, sza double, ada double, alt double, cwv double, fza double")


def flat_pixels(spark, levels, n=100):
    """Pixels whose spectra are the path radiance at a level, times a rising factor."""
    t = c.banded()
    rows = []
    for product, aot in levels.items():
        lpw = t.at(20.0, 40.0, 0.0, aot, 0.0, 1.0).lpw
        rows += [(product[0], product, k // 10, k % 10, [float(v) for v in lpw * (1 + 0.001 * k)], True, True) for k in range(n)]
    return spark.createDataFrame(rows, "set_id string, product_id string, y int, x int, radiance array<double>, valid boolean, clear boolean")


def test_sets_views_and_what_is_missing(spark):
    views = flat_views(spark, {"a": 2, "b": 1, "c": 1, "d": 1})
    pixels = flat_pixels(spark, {"a0": 0.3, "a1": 0.5, "b0": 0.01, "x0": 0.3}).union(flat_pixels(spark, {"c0": 0.15}, 99)).union(flat_pixels(spark, {"d0": 0.15}, 100))
    own = {x["product_id"]: x for x in aerosol.water_thickness(pixels, views, c.banded(), BANDS, False).collect()}
    joint = {x["product_id"]: x["aot550"] for x in aerosol.water_thickness(pixels, views, c.banded(), BANDS, True).collect()}
    assert own["a0"]["aot550"] == pytest.approx(0.31, abs=0.021) and own["a1"]["aot550"] == pytest.approx(0.52, abs=0.021)
    assert joint["a0"] == joint["a1"] and joint["a0"] < own["a1"]["aot550"]
    assert own["b0"]["aot550"] == 0.05 and max(own["b0"]["correction"]) > 0 and max(own["a0"]["correction"]) == 0
    assert own["c0"]["aot550"] is None and "x0" not in own
    land = {x["product_id"]: x for x in aerosol.land_thickness(pixels, views, c.banded(), BANDS).collect()}
    assert {k: x["origin"] for k, x in land.items()} == {"a0": "default", "a1": "default", "b0": "least", "c0": "none", "d0": "bound"}
    assert land["a0"]["aot550"] == 0.2 and land["d0"]["aot550"] == land["d0"]["aot_max"] < 0.2 and land["c0"]["aot550"] is None


def test_no_pixels_and_no_views(spark):
    views, pixels = flat_views(spark, {"a": 2}), flat_pixels(spark, {"a0": 0.3})
    assert [x["aot550"] for x in aerosol.land_thickness(pixels.limit(0), views, c.banded(), BANDS).collect()] == [None, None]
    assert aerosol.land_thickness(pixels, views.limit(0), c.banded(), BANDS).count() == 0


def test_pixel_sets_fill_up_with_medium_pixels():
    dense, medium, sparse = ([[k] for k in range(lo, lo + n)] for lo, n in ((0, 9), (100, 15), (200, 1)))
    sets = aerosol.pixel_sets(dense, medium, sparse)
    assert sets[:, :, 0].tolist() == [[0, 1, 100, 101, 200], [2, 3, 102, 103, 104], [4, 5, 104, 105, 106], [6, 7, 106, 107, 108]]
    assert list(itertools.chain(aerosol.pixel_sets(dense[:1], medium, sparse))) == []


def test_outliers_do_not_settle():
    assert aerosol.settled(np.array([0.3])) == 0.3
    assert aerosol.settled(np.array([0.2, 0.21, 0.19, 0.2, 0.9])) == pytest.approx(0.2)
