"""Geometric correction of many passes against each scene alone, with passes of very different size and scenes of all modes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicube import registry
from lumicube.operators import geometry as one
from lumicube.operators import passes
from lumicube.plans import catalog_geometry as c

NAMES = ("jd", "seconds", "x", "y", "z", "vx", "vy", "vz")


@pytest.fixture(scope="module")
def orbit():
    g = c.gps()
    return np.column_stack((g.jd, g.seconds, g.position, g.velocity))


def tables(spark, orbit):
    """Three passes, one with twice as many records between the same ones, one far too short; scenes of several modes."""
    dense = np.array([(orbit[k] + orbit[k + 1]) / 2 for k in range(len(orbit) - 1)])
    records = [("a", *r) for r in orbit] + [("b", *r) for r in np.concatenate((orbit, dense))] + [("short", *r) for r in orbit[:3]] + [("a", *orbit[7])]
    telemetry = spark.createDataFrame([(p, *map(float, r)) for p, *r in records], f"pass_id string, {', '.join(f'{n} double' for n in NAMES)}").repartition(3)
    kinds = [("a1", "a", "1", 2), ("a2", "a", "5", 1), ("b1", "b", "3", 3), ("s1", "short", "1", 2), ("none", "z", "1", 2)]
    scenes = spark.createDataFrame([(s, p, m, 10.0, 45.0, 0.5, i, c.CENTRES) for s, p, m, i in kinds], "scene_id string, pass_id string, mode string, lon double, lat double, alt double, image int, centres array<double>")
    gcps = spark.createDataFrame([(s, *map(float, (p.x, p.y, p.lon, p.lat, p.alt))) for s, n in (("a1", 7), ("b1", 1)) for p in c.GCPS[:n]], "scene_id string, x double, y double, lon double, lat double, alt double")
    return telemetry, scenes, gcps


def test_many_passes_are_each_scene_alone(spark, orbit):
    telemetry, scenes, gcps = tables(spark, orbit)
    spots = [(0, 0), (371, 373), (100, 20), (186, 200), (5, 740)]
    rows = [(s, x, y, f"{s}{x}") for s in ("a1", "a2", "b1", "s1", "none", "unknown") for x, y in spots] + [("a1", k % 372, k // 372, "skew") for k in range(20_000)]
    pixels = spark.createDataFrame(rows, "scene_id string, x int, y int, note string")
    got = {(r["scene_id"], r["x"], r["y"], r["note"]): r for r in passes.geometric_correction(pixels, telemetry, scenes, gcps).collect()}
    records = {p: sorted({tuple(r[n] for n in NAMES) for r in telemetry.filter(F.col("pass_id") == p).collect()}) for p in "ab"}
    seen, by = 0, {}
    for (n, x, y, _), r in got.items():
        by.setdefault((n, x, y), []).append(r)
    for s in scenes.collect():
        if s["pass_id"] not in records:
            continue
        t = np.array(records[s["pass_id"]])
        info = one.Acquisition(s["mode"], 10.0, 45.0, 0.5, s["image"])
        marks = sorted((one.Gcp(**{k: r[k] for k in ("x", "y", "lon", "lat", "alt")}) for r in gcps.filter(F.col("scene_id") == s["scene_id"]).collect()), key=lambda p: (p.x, p.y))
        own = spark.createDataFrame([(x, y) for n, x, y, _ in set(rows) if n == s["scene_id"] and y < info.constants.rows], "x int, y int")
        for w in one.geometric_correction(own, one.Gps(t[:, 0], t[:, 1], t[:, 2:5], t[:, 5:8]), c.CENTRES, info, marks, include_angles=True).dropDuplicates(["x", "y"]).collect():
            mine = by[s["scene_id"], w["x"], w["y"]]
            for g in mine:
                seen += 1
                for name in ("lon", "lat", "vaa", "vza", "pitch", "roll"):
                    assert g[name] == pytest.approx(w[name], abs=1e-9), (s["scene_id"], name)
    assert seen == len(got) and {k[0] for k in got} == {"a1", "a2", "b1"}


def test_no_tables(spark, orbit):
    telemetry, scenes, gcps = tables(spark, orbit)
    pixels = spark.createDataFrame([("a1", 1, 1)], "scene_id string, x int, y int")
    for args in ((pixels.limit(0), telemetry, scenes, gcps), (pixels, telemetry.limit(0), scenes, gcps), (pixels, telemetry, scenes.limit(0), gcps)):
        assert passes.geometric_correction(*args).count() == 0
    assert passes.geometric_correction(pixels, telemetry, scenes, gcps.limit(0)).count() == 1 == passes.geometric_correction(pixels, telemetry, scenes).count()


@pytest.mark.parametrize("name", ["orbital_plane", "target_scan_rotation", "gcp_time_shift", "pitch_roll_pixel"])
def test_oracle(spark, data, same_as_oracle, name):
    assert same_as_oracle(registry.queries()[name](spark, data), registry.oracle_sql()[name]) > 370


def test_passes_are_dealt_over_tasks(spark, data):
    """Small records are not put together into one task, and a line table has only what is asked for."""
    lines = c._pass_lines(spark, data, c.GCPS[:1], values=("days", passes.UNSHIFTED))
    assert lines.columns == ["pass_id", "mode", "alt", "line", "days", passes.UNSHIFTED]
    assert lines.select(F.spark_partition_id().alias("task")).distinct().count() > 1
