"""Queries that must take every pixel and band, held against values computed apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicube import registry
from lumicube.model import mode_of
from lumicube.operators import geometry, statistics
from lumicube.plans import catalog_geometry
from lumicube.sources.testdata import cube

QUERIES = registry.queries()


@pytest.mark.parametrize("name", ["perform_geometric_correction", "pixel_position", "pitch_roll_refine"])
def test_every_pixel_is_located(spark, data, name):
    m = mode_of(catalog_geometry.MODE)
    df = QUERIES[name](spark, data)
    filled = [F.count(F.when(F.col(c).isNotNull() & ~F.isnan(c), 1)) for c in df.columns if c not in "xy"]
    got = df.agg(F.count("*"), F.countDistinct("x", "y"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), *filled).first()
    n = m.rows * m.columns
    assert n == 139_128 and tuple(got) == (n, n, 0, m.columns - 1, 0, m.rows - 1, *[n] * len(filled))


def test_control_points_are_where_they_were_surveyed(spark, data):
    at = {(int(c.x), int(c.y)): c for c in catalog_geometry.GCPS}
    rows = QUERIES["perform_geometric_correction"](spark, data).filter(F.struct("x", "y").isin([F.struct(F.lit(x), F.lit(y)) for x, y in at])).collect()
    assert len(rows) == len(at)
    for r in rows:
        c = at[r["x"], r["y"]]
        # A pixel is some 4e-4 degrees wide.
        assert abs(r["lon"] - c.lon) < 1e-3 and abs(r["lat"] - c.lat) < 1e-3


def test_last_pixel_has_the_angles_of_its_line_and_column(spark, data):
    m, lines = mode_of(catalog_geometry.MODE), geometry.line_geometry(catalog_geometry.gps(), catalog_geometry.CENTRES, catalog_geometry.INFO, catalog_geometry.GCPS)
    x, y = m.columns - 1, m.rows - 1
    t = np.array(geometry.quadratic_terms(x + 0.5, y + 0.5))
    got = QUERIES["pitch_roll_refine"](spark, data).filter((F.col("x") == x) & (F.col("y") == y)).collect()
    assert len(got) == 1
    assert abs(got[0]["pitch"] - (lines.pitch[y] + t @ lines.pitch_fit)) < 2e-9
    assert abs(got[0]["roll"] - (lines.roll[y] + geometry.column_offsets(catalog_geometry.MODE)[x] + t @ lines.roll_fit)) < 2e-9


def test_every_row_is_flipped_at_the_height_of_the_scene(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"), F.col("id").cast("int").alias("label"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["x"], r["y"], r["label"]) for r in QUERIES["row_flip"](spark, str(tmp_path)).collect()}
    assert got == {(k % 25, 79 - k // 25, k) for k in range(2000)}


def box(values, kernel):
    """(sum, count of non-zero values) of the clipped windows of (y, x, band)."""
    half = kernel // 2
    s, n = np.zeros_like(values), np.zeros_like(values)
    for y in range(values.shape[0]):
        for x in range(values.shape[1]):
            w = values[max(0, y - half) : y + half, max(0, x - half) : x + half]
            s[y, x], n[y, x] = w.sum(axis=(0, 1)), (w != 0).sum(axis=(0, 1))
    return s, n


@pytest.fixture(scope="module")
def masked(spark, data):
    rows = cube(spark, data).pixels.orderBy("vec_id").collect()
    return np.array([np.where(np.array(r["mask"]) != 0, 0, np.array(r["radiance"]) - 9000) for r in rows]).reshape(-1, 25, 64)


def test_boxes_take_all_bands_and_the_whole_kernel(spark, data, masked):
    s, n = box(masked, 27)
    mean = np.where((masked != 0) & (n > 0), np.trunc(s / np.maximum(n, 1)), 0)
    got = {(r["y"], r["x"], r["band"]): r["mean"] for r in QUERIES["box_mean"](spark, data).collect()}
    assert got == {(y, x, b + 1): mean[y, x, b] for y, x, b in np.ndindex(masked.shape)}
    reads = {r["band"]: r["reads"] for r in QUERIES["box_window"](spark, data).collect()}
    assert reads == {b + 1: n[:, :, b].sum() for b in range(64)}
    rho = masked * 1e-4
    want = rho + (rho - mean * 1e-4) * (0.1 + 0.01 * np.arange(1, 65))
    rows = QUERIES["adjacency_correction"](spark, data).collect()
    assert len(rows) == masked.size and all(abs(r["reflectance"] - want[r["y"], r["x"], r["band"] - 1]) < 2e-8 for r in rows)


def test_kernel_of_the_other_modes(spark):
    v = np.random.default_rng(7).integers(0, 50, (64, 62, 1))
    rows = spark.createDataFrame([("p", y, x, 1, int(v[y, x, 0])) for y in range(64) for x in range(62)], "product_id string, y int, x int, band int, value int")
    s, n = box(v, 59)
    got = {(r["y"], r["x"]): r["box_mean"] for r in statistics.box_mean(rows, "value", 59).collect()}
    assert got == {(y, x): s[y, x, 0] // n[y, x, 0] if v[y, x, 0] else 0 for y in range(64) for x in range(62)}


def test_other_queries_keep_all_bands(spark, data):
    pixels = {(r["x"], r["y"]): (r["radiance"], r["mask"]) for r in cube(spark, data).pixels.collect()}
    assert {(r["x"], r["y"]): (r["radiance"], r["mask"]) for r in QUERIES["copy_product"](spark, data).collect()} == pixels
    weights = QUERIES["resample_weight"](spark, data).groupBy("band").agg(F.sum("weight").alias("w")).collect()
    assert {r["band"] for r in weights} == set(range(1, 65)) and all(abs(r["w"] - 1) < 1e-6 for r in weights)
    left = {(r["x"], r["y"]): r["left_spectrum"] for r in QUERIES["lag_across_track"](spark, data).collect()}
    assert left.keys() == pixels.keys() and all(v is None or len(v) == 64 for v in left.values())


def circle(seconds):
    """Positions of the synthetic orbit in the inertial frame, from its formula."""
    rate = 2 * np.pi / 5800
    phase = np.radians(45) + rate * (np.asarray(seconds) - 700)
    node = geometry.sidereal(np.array([2453001.0 + 700 / 86400]))[0] + np.radians(11)
    e1, e2 = np.array([np.cos(node), np.sin(node), 0]), np.array([0, 0, 1.0])
    return 6978 * (np.cos(phase)[..., None] * e1 + np.sin(phase)[..., None] * e2), np.cross(e1, e2)


def pointing(seconds, place):
    """(pitch, roll) of the line of sight from the satellite to inertial positions."""
    satellite, normal = circle(seconds)
    sight = place - satellite
    sight = sight / np.linalg.norm(sight, axis=-1, keepdims=True)
    up = satellite / 6978
    roll = np.arcsin(sight @ normal)
    pitch = np.arcsin((sight * np.cross(normal, up)).sum(axis=-1) / np.cos(roll))
    return pitch, roll


def line_seconds():
    m = mode_of("1")
    return 700 + (np.arange(m.rows) - m.rows / 2) * m.time_per_line + m.integration_time / 2


def test_centre_angles_point_at_the_followed_target(spark, data):
    place = np.array([[r[f"t{k}"] for k in range(3)] for r in QUERIES["target_scan_rotation"](spark, data).filter("pass_id = 0").orderBy("line").collect()])
    pitch, roll = pointing(line_seconds(), place)
    rows = QUERIES["pitch_roll_center"](spark, data).filter("pass_id = 0").orderBy("line").collect()
    # Telemetry times resolve 40 microseconds: 0.3 m of the orbit.
    assert np.abs(pitch - [r["pitch"] for r in rows]).max() < 1e-6 and np.abs(roll - [r["roll"] for r in rows]).max() < 1e-6
    assert np.ptp(pitch) > 1e-3


def test_every_pixel_lies_where_its_angles_point(spark, data):
    """From longitude and latitude back to pitch, roll and view angles, by other formulas than the query's."""
    m = mode_of("1")
    rows = QUERIES["pixel_position"](spark, data).toPandas()
    centre = {r["line"]: (r["pitch"], r["roll"]) for r in QUERIES["pitch_roll_center"](spark, data).filter("pass_id = 0").collect()}
    lon, lat = np.radians(rows["lon"].to_numpy()), np.radians(rows["lat"].to_numpy())
    f = 1 / 298.257223563
    n = 6378.137 / np.sqrt(1 - f * (2 - f) * np.sin(lat) ** 2)
    seconds = line_seconds()[rows["y"]]
    theta = lon + geometry.sidereal(2453001.0 + seconds / 86400)
    up = np.stack((np.cos(lat) * np.cos(theta), np.cos(lat) * np.sin(theta), np.sin(lat)), axis=1)
    place = n[:, None] * up * [1, 1, (1 - f) ** 2] + catalog_geometry.INFO.alt * up
    pitch, roll = pointing(seconds, place)
    want = np.array([centre[y] for y in rows["y"]])
    fov = np.radians(m.field_of_view)
    want[:, 1] += (rows["x"] + 0.5) * fov / m.columns - fov / 2
    assert np.abs(pitch - want[:, 0]).max() < 2e-6 and np.abs(roll - want[:, 1]).max() < 2e-6
    back = circle(seconds)[0] - place
    back /= np.linalg.norm(back, axis=1, keepdims=True)
    zenith = np.degrees(np.arccos((back * up).sum(axis=1)))
    assert np.abs(zenith - rows["vza"]).max() < 2e-4
    east = np.stack((-np.sin(theta), np.cos(theta), 0 * theta), axis=1)
    azimuth = np.degrees(np.arctan2((back * east).sum(axis=1), (back * np.cross(up, east)).sum(axis=1)))
    sure = zenith > 1
    turn = np.abs((azimuth - rows["vaa"] + 180) % 360 - 180)
    assert sure.any() and turn[sure].max() < 5e-3


def test_control_point_fit_solves_its_normal_equations(spark, data):
    """Residuals at the control points, by the closed form of the orbit, are orthogonal to all six terms."""
    gcps, m = catalog_geometry.GCPS, mode_of("1")
    made = geometry.line_geometry(catalog_geometry.gps(), catalog_geometry.CENTRES, catalog_geometry.INFO, gcps)
    terms = np.array([geometry.quadratic_terms(c.x, c.y) for c in gcps])
    seconds = made.days * 86400
    left = []
    for c, t in zip(gcps, terms, strict=True):
        line = int(c.y)
        theta = np.radians(c.lon) + geometry.sidereal(2453001.0 + made.days[line : line + 1])[0]
        place = geometry.earth_fixed(np.degrees(theta), c.lat, c.alt)
        pitch, roll = pointing(seconds[line : line + 1], place[None])
        fov = np.radians(m.field_of_view)
        column = (int(c.x) + 0.5) * fov / m.columns - fov / 2
        left.append((pitch[0] - made.pitch[line] - t @ made.pitch_fit, roll[0] - made.roll[line] - column - t @ made.roll_fit))
    fit = QUERIES["gcp_quadratic_fit"](spark, data).filter("pass_id = 0").orderBy("line").collect()
    scale = np.abs(terms).max(axis=0)  # telemetry of the query differs from this one's in its last digits
    for name, own in (("pitch", made.pitch_fit), ("roll", made.roll_fit)):
        assert np.abs((np.array([r[name] for r in fit]) - own) * scale).max() < 1e-9
    scaled = terms / np.linalg.norm(terms, axis=0)
    assert np.abs(scaled.T @ np.array(left)).max() < 3e-6
