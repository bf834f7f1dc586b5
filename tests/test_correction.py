"""The whole atmospheric correction, on a scene simulated with a known atmosphere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicube import registry
from lumicube.model import Scene
from lumicube.operators import atmosphere as a
from lumicube.operators import correction, radiative
from lumicube.params import AtmosphereParams
from lumicube.plans.catalog_atmosphere import _endmembers
from lumicube.sources.testdata import ATTRS, BANDS

SCALE, AOT, CWV, WIDTH, ROWS = 1e-4, 0.137, 1.4, 20, 16
LUT, WL = a.stand_in_lut(), np.array([b.wavelength for b in BANDS])


@pytest.fixture(scope="module")
def truth():
    """(pixel, band): 110 black pixels, then mixtures of soil and vegetation; the last pixel is masked."""
    share = np.random.default_rng(5).random(WIDTH * ROWS)[:, None]
    e = _endmembers()
    rho = share * e[:, 1] + (1 - share) * e[:, 2]
    rho[np.arange(110) * 2] = 0.0
    return rho


@pytest.fixture(scope="module")
def scene(spark, truth):
    t = LUT.at(AOT, CWV, 35.0).resampled(a.resampling_weights(LUT.wavelengths, BANDS))
    radiance = (t.lpw + truth * t.egl / (np.pi * (1 - t.sab * truth))) / SCALE
    last = len(truth) - 1
    rows = [("s", k // WIDTH, k % WIDTH, [int(round(v)) for v in radiance[k]], [int(k == last)] * len(BANDS)) for k in range(len(truth))]
    return Scene(spark.createDataFrame(rows, "product_id string, y int, x int, radiance array<int>, mask array<smallint>"), BANDS, dict(ATTRS))


def run(scene, **params):
    made = correction.surface_reflectances(scene, SCALE, LUT, AtmosphereParams(**params), _endmembers())
    rows = made.pixels.orderBy("y", "x").collect()
    return made, rows, np.array([r["reflectance"] for r in rows])


def test_whole_chain_finds_the_atmosphere_and_the_surface(scene, truth):
    made, rows, rho = run(scene, water_vapour_map=True)
    assert abs(made.aot - 0.135) < 1e-9  # the fine step below 0.137; the coarse grid alone gives 0.10
    # The scene's shift is the median of the columns'; with bands of 10 nm it isn't 0 even here.
    cells = np.array([r["radiance"] for r in scene.pixels.filter(f"NOT (y = {ROWS - 1} AND x = {WIDTH - 1})").select("radiance").collect()], dtype=float)
    x = np.array([r["x"] for r in scene.pixels.filter(f"NOT (y = {ROWS - 1} AND x = {WIDTH - 1})").select("x").collect()])
    shifts = [a.smile_shift(cells[x == k].mean(axis=0), SCALE, BANDS, LUT, made.aot, 1.0, 35.0) for k in range(WIDTH)]
    assert abs(made.smile_shift - np.median(shifts)) < 1e-6
    assert (rho[-1] == 0).all() and rows[-1]["water_vapour"] == 0
    bright = truth[:-1].min(axis=1) > 0  # black pixels tell nothing of the water vapour
    vapour = np.array([r["water_vapour"] for r in rows[:-1]])
    assert abs(made.water_vapour - vapour.mean()) < 1e-9
    # The shift and the line's wings in the fitted bands cost up to a tenth; reflectances suffer at the line only.
    assert np.abs(vapour[bright] / CWV - 1).max() < 0.15
    assert np.abs(rho[:-1][bright] - truth[:-1][bright]).max() < 0.02


def test_fixed_thickness_is_kept(scene):
    assert run(scene, aot550=0.3)[0].aot == 0.3


def test_adjacency_and_polishing_follow_the_inversion(scene):
    base = run(scene)
    plain = base[2]
    made, _, near = run(scene, adjacency=True)
    table = LUT.at(made.aot, made.water_vapour, 35.0).resampled(a.resampling_weights(LUT.wavelengths, BANDS, made.smile_shift))
    whole = (plain / 1e-4).astype(int).reshape(ROWS, WIDTH, -1)
    want = plain.reshape(ROWS, WIDTH, -1).copy()
    for y in range(ROWS):
        for x in range(WIDTH):
            box = whole[max(0, y - 13) : y + 13, max(0, x - 13) : x + 13].reshape(-1, len(BANDS))
            n = (box != 0).sum(axis=0)
            mean = np.where((whole[y, x] != 0) & (n > 0), np.trunc(box.sum(axis=0) / np.maximum(n, 1)), 0) * 1e-4
            want[y, x] += (want[y, x] - mean) * table.rat
    assert np.abs(near.reshape(want.shape) - want).max() < 3e-4
    polished, _, last = run(scene, adjacency=True, polishing=True)
    assert np.abs(polished.gains - 1).max() > 0
    assert np.allclose(last, near * polished.gains, atol=1e-9)


def test_references_are_the_ends_of_all_pixels(spark):
    red, nir = next(k for k, w in enumerate(WL) if w >= 670), next(k for k, w in enumerate(WL) if w >= 785)
    rows = []
    for k in range(400):
        s = np.full(len(BANDS), 0.1)
        s[nir], s[red], s[0] = 0.4, 0.3 - 0.0005 * k, k
        if k % 10 == 0:
            s[nir] = 0.8  # too bright
        rows.append(("p", k // 20, k % 20, s.tolist()))
    df = spark.createDataFrame(rows, "product_id string, y int, x int, reflectance array<double>")
    kept = [k for k in range(400) if k % 10 and (0.4 - 0.3 + 0.0005 * k) / (0.7 - 0.0005 * k) > 0.1]
    assert sorted(correction.reference_spectra(df, BANDS)[:, 0]) == kept[:25] + kept[-25:]
    assert len(correction.reference_spectra(df.filter(F.col("y") < 2), BANDS)) == 0


def test_red_edge_gains_are_smoothed_alone():
    spectra = np.random.default_rng(6).random((50, len(BANDS))) + 0.5
    edge = (WL >= a.RED_EDGE[0]) & (WL <= a.RED_EDGE[1])
    first = a.polishing_gains(spectra, _endmembers(), WL)
    c = np.linalg.lstsq(_endmembers(), spectra.T, rcond=None)[0]
    smooth = (_endmembers() @ c).T
    raw = (smooth * smooth).sum(axis=0) / (spectra * smooth).sum(axis=0)
    assert np.allclose(first[~edge], raw[~edge])
    assert np.allclose(first[edge], 1 + raw[edge] - a.lowess(raw[edge], 0, 5, 0))


def test_registered_query_gives_every_pixel_and_band(spark, data):
    rows = registry.queries()["correct_atmosphere"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert all(len(r["reflectance"]) == 64 and None not in r["reflectance"] for r in rows)


TABLE = radiative.lut_at(radiative.stand_in_table(), 20.0, 60.0, 0.5, 35.0)


@pytest.mark.parametrize("mode", ["1", "3", "5"])
def test_whole_chain_with_the_table_at_the_scenes_angles(spark, truth, mode):
    """A scene simulated from the table in all its axes, off its nodes; modes with and without a smile."""
    full = radiative.stand_in_table()
    weights = a.resampling_weights(full.axes["wavelength"], BANDS)
    t = full.at(20.0, 35.0, 0.5, AOT, 60.0, CWV).resampled(weights)
    radiance = (t.lpw + truth * t.egl / (np.pi * (1 - t.sab * truth))) / SCALE
    rows = [("s", k // WIDTH, k % WIDTH, [int(round(v)) for v in radiance[k]], [0] * len(BANDS)) for k in range(len(truth))]
    scene = Scene(spark.createDataFrame(rows, "product_id string, y int, x int, radiance array<int>, mask array<smallint>"), BANDS, dict(ATTRS) | {"mode": mode})
    made = correction.surface_reflectances(scene, SCALE, TABLE, AtmosphereParams(water_vapour_map=True), _endmembers())
    rho = np.array([r["reflectance"] for r in made.pixels.orderBy("y", "x").collect()])
    assert made.aot == pytest.approx(AOT, abs=0.006) and (mode == "3") == (made.smile_shift == 0.0)
    land = truth[:, 20] > 0.05
    away = np.array([abs(b.wavelength - 940) > 60 and abs(b.wavelength - 760) > 15 for b in BANDS])
    assert np.abs(rho - truth)[land][:, away].max() < 0.02


def test_table_of_a_scene_is_the_table():
    full = radiative.stand_in_table(step=50.0)
    own = radiative.lut_at(full, 10.0, 30.0, 0.25, 50.0)
    for aot, cwv in ((0.05, 0.3), (0.4, 1.5), (1.0, 5.0)):
        got, want = own.at(aot, cwv, 50.0), full.at(10.0, 50.0, 0.25, aot, 30.0, cwv)
        for n in ("lpw", "egl", "sab", "rat"):
            np.testing.assert_allclose(getattr(got, n), getattr(want, n), rtol=1e-12)
