"""Values that hold for any correct implementation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicube import numerics
from lumicube.functions import radiometry, timegeo
from lumicube.functions.finite import statistics
from lumicube.operators import atmosphere, bands, clustering, lookups, noise
from lumicube.operators.smoothing import lowess
from lumicube.params import ClusterParams, DestripingParams, DropoutParams
from lumicube.sources import products
from lumicube.sources.testdata import BANDS


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_local_regression_keeps_polynomials():
    x = np.arange(40.0)
    for y in (np.full(40, 3.0), 2 * x - 1, 0.1 * x * x - x + 4):
        assert np.abs(lowess(y, 2, 27, 2) - y).max() < 1e-9


def test_local_regression_refuses_bad_parameters():
    for args in ((np.zeros(40), 2, 4, 0), (np.zeros(5), 2, 27, 0), (np.zeros(40), 2, 27, -1)):
        with pytest.raises(ValueError):
            lowess(*args)


def test_legendre(spark):
    assert list(one(spark, *radiometry.legendre(F.lit(0.5), 4))) == [1, 0.5, -0.125, -0.4375, -0.2890625]


def test_sidereal_time(spark):
    mjd = F.lit(54789.625)  # 2008-11-19T15:00
    assert abs(one(spark, timegeo.mjd_to_gst(mjd))[0] - 4.9569015) < 1e-7


def test_leap_seconds(spark):
    from lumicube.sources.time_tables import leap_seconds

    rows = spark.createDataFrame([(51179.0,), (53736.0,), (54832.0,), (41317.0,)], "mjd0 double")
    got = {r["mjd0"]: r["tai_utc"] - 19 for r in lookups.as_of(rows, F.col("mjd0"), leap_seconds(spark), "mjd", "tai_utc").collect()}
    assert got == {51179.0: 13, 53736.0: 14, 54832.0: 15, 41317.0: -9}


def test_line_and_sphere(spark):
    axes = (1.0, 1.0, 1.0)
    v = lambda *c: tuple(F.lit(float(x)) for x in c)
    hit = one(spark, *timegeo.intersect(v(2, 0, 0), v(-1, 0, 0), axes))
    miss = one(spark, *timegeo.intersect(v(2, 2, 0), v(-1, 0, 0), axes))
    assert list(hit) == [1, 0, 0] and all(math.isnan(x) for x in miss)


def test_geodetic_round_trip(spark):
    rows = spark.createDataFrame([(10.0, 50.0, 1.0), (-70.0, -33.0, 0.5), (179.0, 0.0, 0.0), (0.0, 90.0, 2.0), (0.0, -90.0, 2.0)], "a double, b double, c double")
    x, y, z = timegeo.wgs_to_ecef(F.col("a"), F.col("b"), F.col("c"))
    for r in timegeo.with_wgs(rows.withColumns({"x": x, "y": y, "z": z}), (F.col("x"), F.col("y"), F.col("z"))).collect():
        assert abs(r["lat"] - r["b"]) < 1e-9 and abs(r["alt"] - r["c"]) < 1e-6 and (abs(r["b"]) == 90 or abs(r["lon"] - r["a"]) < 1e-9)


def test_perpendicular_angle_is_zero(spark):
    v = lambda *c: tuple(F.lit(float(x)) for x in c)
    assert one(spark, timegeo.angle(v(1, 0, 0), v(0, 1, 0)))[0] == 0


def test_altitude(spark):
    assert list(one(spark, products.parse_altitude(F.lit("Madrid (alt[m] = 750)"), F.lit(0.1)), products.parse_altitude(F.lit("x"), F.lit(0.1)))) == [0.75, 0.1]


def test_statistics_skip_what_is_not_finite(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 4.0), ("a", float("inf")), ("b", 2.0), ("c", float("nan"))], "k string, v double")
    got = {r["k"]: r for r in statistics(rows, ["k"], "v").collect()}
    assert (got["a"]["n"], got["a"]["median"], got["a"]["mean"]) == (2, 2.5, 2.5)
    assert math.isnan(got["b"]["variance"]) and got["c"]["n"] == 0 and math.isnan(got["c"]["mean"])


def test_masks(spark):
    rows = spark.createDataFrame([([0, 0, 0, 0],), ([0, 1, 0, 0],), ([0, 0, 2, 0],), ([0, 2, 0, 1],)], "mask array<smallint>")
    assert [r[0] for r in rows.select(bands.hyper_mask()).collect()] == [0, 1, 2, 3]
    cloud = spark.createDataFrame([(0.0,), (0.0,), (0.5,), (1.0,)], "c double")
    assert [r[0] for r in cloud.select(bands.cloud_mask(F.col("c"), 0.5)).collect()] == [0, 0, 0, 1]
    water = spark.createDataFrame([(20, 40), (40, 20), (180, 160), (20, 10)], "red int, nir int")
    assert [r[0] for r in water.select(bands.water_mask(F.col("red"), F.col("nir"), 1e-3, 1e-3)).collect()] == [0, 1, 0, 0]


def test_classify(spark):
    rows = spark.createDataFrame([(i, *[(f + k) * 0.1 for k in range(4)]) for i, f in enumerate((101, 401, 301, 201))], "i int, f0 double, f1 double, f2 double, f3 double")
    clusters = [clustering.Cluster((m,) * 4, (1.0,) * 4, 0.25) for m in (10.0, 20.0, 30.0, 40.0)]
    got = clustering.with_posteriors(rows, ["f0", "f1", "f2", "f3"], clusters).select("i", clustering.class_index().alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [0, 3, 2, 1]


def test_generator_matches_the_documented_sequence():
    draw = clustering.Lcg(42)
    assert [draw.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]


def test_cluster_without_pixels_is_refused(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,)], "f double")
    with pytest.raises(ArithmeticError):
        clustering.em_step(rows, ["f"], [clustering.Cluster((1.0,), (0.0,), 1.0)])


def test_dropouts(spark):
    rows = [("p", y, x, [10, 20, 30], [0, 0, 0]) for y in range(3) for x in range(3)]
    rows[4] = ("p", 1, 1, [10, 0, 30], [0, 1, 0])
    rows[1] = ("p", 0, 1, [10, 50, 30], [0, 2, 0])
    px = spark.createDataFrame(rows, "product_id string, y int, x int, radiance array<int>, mask array<smallint>")
    got = noise.correct_dropouts(px, DropoutParams(1, "N4")).filter("y = 1 AND x = 1").first()
    assert (got["radiance"], got["mask"]) == ([10, 20, 30], [0, 1, 0])
    lone = spark.createDataFrame([("p", 0, 0, [7], [1])], px.schema)
    assert noise.correct_dropouts(lone).first()["radiance"] == [7]


def test_roots():
    at = numerics.roots(np.cos, np.array([1.0]), np.array([2.0]))
    assert abs(at[0] - math.pi / 2) < 1e-15
    assert numerics.roots(lambda x: x, np.array([0.0]), np.array([1.0]))[0] == 0
    assert numerics.roots(lambda x: x + 1, np.array([0.0]), np.array([1.0]))[0] == 0  # no root: an end


def test_minima():
    f = lambda x: (x - 2) ** 2
    assert abs(numerics.minimum(f, *numerics.bracket_minimum(f, 0.0, 1.0)) - 2) < 1e-6
    got = numerics.minimum_powell(lambda v: float((1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2), np.array([-1.2, 1.0]))
    assert np.abs(got - 1).max() < 1e-3


def test_unmixing_is_constrained():
    r = np.random.default_rng(0)
    ends = r.random((12, 3))
    want = r.dirichlet(np.ones(3), 20)
    got = numerics.unmix(want @ ends.T, ends)
    assert np.abs(got - want).max() < 1e-4 and (got >= 0).all() and np.abs(got.sum(axis=1) - 1).max() < 1e-5


def test_unmixing_takes_missing_spectra(spark):
    ends = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    rows = spark.createDataFrame([(1, [0.25, 0.75, 0.5]), (2, None), (3, [0.25, None, 0.5]), (4, [1.0, 0.0, 0.5])], "k int, s array<double>").coalesce(1)
    got = {r["k"]: r["abundance"] for r in atmosphere.abundances(rows, ["k"], "s", ends).collect()}
    assert got[2] is None and np.isnan(got[3]).all()
    assert np.abs(np.array([got[1], got[4]]) - [[0.25, 0.75], [1, 0]]).max() < 1e-6
    assert atmosphere.abundances(rows.limit(0), ["k"], "s", ends).count() == 0


def test_nonnegative_least_squares_is_the_best_of_all_supports():
    from itertools import combinations

    r = np.random.default_rng(3)
    a, b = r.normal(size=(9, 4)), r.normal(size=(300, 9))
    b[7], b[8, 2] = 0.0, np.nan
    a[:, 3] = a[:, 0] + 1e-3 * r.normal(size=9)  # two columns nearly alike
    best = (b**2).sum(axis=1)
    for k in range(1, 5):
        for some in map(list, combinations(range(4), k)):
            x = np.linalg.lstsq(a[:, some], b[np.isfinite(b).all(axis=1)].T, rcond=None)[0]
            cost = ((b[np.isfinite(b).all(axis=1)].T - a[:, some] @ x) ** 2).sum(axis=0)
            rows = np.flatnonzero(np.isfinite(b).all(axis=1))
            best[rows] = np.where((x >= 0).all(axis=0), np.minimum(best[rows], cost), best[rows])
    got = numerics.nonnegative_least_squares(a, b)
    assert np.isnan(got[8]).all() and (got[7] == 0).all()
    sound = np.arange(300) != 8
    assert (got[sound] >= 0).all() and np.abs(((b - got @ a.T) ** 2).sum(axis=1) - best)[sound].max() < 1e-9
    assert numerics.unmix(np.zeros((0, 9)), a).shape == (0, 4)


def test_water_vapour_is_found_again():
    lut = atmosphere.stand_in_lut()
    w = atmosphere.resampling_weights(lut.wavelengths, BANDS)
    nodes = [lut.at(0.2, c, 35.0).resampled(w) for c in lut.cwv]
    rho = 0.2 + 0.0002 * (np.array([b.wavelength for b in BANDS]) - 400)
    radiance = np.stack([(t.lpw + rho * t.egl / (np.pi * (1 - t.sab * rho))) / 1e-3 for t in nodes])
    got = atmosphere.retrieve_water_vapour(radiance, 1e-3, BANDS, nodes, lut.cwv, 1.0)
    # The line's wings reach into the fitted bands, so the extrapolated surface is right to a few per cent only.
    assert np.abs(got[1:-1] / np.array(lut.cwv)[1:-1] - 1).max() < 0.03


def test_spline_goes_through_its_knots(spark):
    x, y = [0.0, 1.0, 3.0, 4.0], [1.0, 2.0, 0.0, 5.0]
    seg = spark.createDataFrame(lookups.natural_spline(x, y), "knot double, a double, b double, c double, d double")
    rows = spark.createDataFrame([(v,) for v in (*x, -1.0, 5.0)], "t double")
    got = {r["t"]: r["v"] for r in lookups.spline_values(rows, F.col("t"), seg, 4.0, "v").collect()}
    assert got.keys() == set(x) and all(abs(got[a] - b) < 1e-12 for a, b in zip(x, y, strict=True))


def test_parameters_are_checked():
    for bad in (lambda: DropoutParams(0), lambda: DropoutParams(5, "N6"), lambda: DestripingParams(9), lambda: ClusterParams(1)):
        with pytest.raises(ValueError):
            bad()


def test_product_types():
    assert bands.with_suffix("noise_reduction", "CHRIS_M3A") == "CHRIS_M3A_NR"
    with pytest.raises(ValueError):
        bands.with_suffix("noise_reduction", "CHRIS_M0")


def test_products_are_written_and_read(spark, tmp_path):
    px = spark.createDataFrame([("p", 0, 0, [1], [0])], "product_id string, y int, x int, radiance array<int>, mask array<smallint>")
    products.write_product(px, str(tmp_path / "a"))
    assert products.read_product(spark, str(tmp_path / "a")).count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        products.write_product(px, str(tmp_path / "a"))


def test_band_file(spark, tmp_path):
    (tmp_path / "b.hdr").write_text("ENVI\nsamples = 3\nlines = 2\ndata type = 3\nbyte order = 1\n")
    (tmp_path / "b.img").write_bytes(np.arange(6, dtype=">i4").tobytes())
    got = products.read_envi_band(spark, str(tmp_path / "b.hdr"), str(tmp_path / "b.img")).orderBy("y", "x").collect()
    assert [(r["y"], r["x"], r["value"]) for r in got] == [(y, x, 3.0 * y + x) for y in range(2) for x in range(3)]
    x, y = products.decode_xy_table((2).to_bytes(4, "big") + np.array([1.0, 2, 3, 4], dtype=">f8").tobytes())
    assert x.tolist() == [1, 2] and y.tolist() == [3, 4]


def test_golden_pixels_are_located(spark):
    """Three published pixels of a mode-1 scene, from its own telemetry and twenty control points.

    The telemetry isn't part of this repository: LUMICUBE_TELEMETRY names the folder that holds it.
    """
    import glob
    import os

    from lumicube.operators import geometry
    from lumicube.sources import products

    folder = os.environ.get("LUMICUBE_TELEMETRY")
    if not folder:
        pytest.skip("LUMICUBE_TELEMETRY names no folder with telemetry")
    names = products.find_telemetry(spark, folder, "Barrax", "2005-07-09").first()
    leap = F.lit(13.0)
    records = products.read_gps(spark, f"{folder}/{names['gps']}").withColumn("jd", timegeo.gps_to_jd(F.col("week"), F.col("seconds"), leap, 0.999)).orderBy("line").toPandas()
    gps = geometry.Gps(*[records[n].to_numpy() for n in ("jd", "seconds")], *[records[n].to_numpy() / 1000.0 for n in (["x", "y", "z"], ["vx", "vy", "vz"])])
    ict = products.read_ict(spark, f"{folder}/{names['ict']}")
    centres = list(ict.select(*[timegeo.ict_to_jd(F.col(f"ict{k}"), leap) for k in range(1, 6)]).first())
    marks = products.parse_placemarks(spark.read.text(glob.glob(f"{folder}/*.xml"), wholetext=True))
    gcps = [geometry.Gcp(*[r[n] for n in ("x", "y", "lon", "lat")], 0.7) for r in products.control_points(marks, 0.7).orderBy("name").collect()]
    want = {
        (31, 150): (-2.1467485, 39.082634, 110.73890, 12.794340),
        (301, 45): (-2.0291290, 39.103485, 103.96323, 11.660949),
        (210, 351): (-2.0862782, 39.009377, 125.21822, 12.938542),
    }
    pixels = spark.createDataFrame(list(want), "x int, y int")
    info = geometry.Acquisition("1", -2.09, 39.06, 0.7, 2)
    got = {(r["x"], r["y"]): tuple(r[n] for n in ("lon", "lat", "vaa", "vza")) for r in geometry.geometric_correction(pixels, gps, centres, info, gcps).collect()}
    off = np.abs(np.array([np.subtract(got[k], want[k]) for k in want])).max(axis=0)
    assert (off < np.array([2e-7, 5e-6, 5e-6, 5e-6])).all(), off  # the published tolerances


def test_lookups_take_large_tables_by_shuffle(spark, monkeypatch):
    from lumicube.operators import lookups

    r = np.random.default_rng(5)
    keys = np.unique(np.concatenate((r.uniform(0, 1, 200), r.uniform(50, 90, 200), [-7.0])))
    table = spark.createDataFrame([(float(k), float(i)) for i, k in enumerate(keys)], "k double, v double")
    asked = np.concatenate((r.uniform(-20, 120, 500), keys[:50], [keys[-1]]))
    rows = spark.createDataFrame([(i, float(a)) for i, a in enumerate(asked)], "i int, a double")
    for most in (10_000, 0):
        monkeypatch.setattr(lookups, "MAX_TABLE_ROWS", most)
        got = {x["i"]: x["v"] for x in lookups.as_of(rows, F.col("a"), table, "k", "v").collect()}
        at = np.searchsorted(keys, asked, side="right") - 1
        assert got == {i: float(k) for i, k in enumerate(at) if k >= 0}
        got = {x["i"]: x["v"] for x in lookups.interpolated(rows, F.col("a"), table, "k", "v").collect()}
        want = {i: np.interp(a, keys, np.arange(len(keys))) for i, a in enumerate(asked) if keys[0] <= a <= keys[-1]}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert lookups.as_of(rows, F.col("a"), table.limit(0), "k", "v").count() == 0
