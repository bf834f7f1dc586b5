"""Geometric correction of many scenes: telemetry, centre times and control points as tables.

Each pass's telemetry meets the pass's scenes in one cogroup, where the orbit is fitted once and the lines of every scene
are found; the result is a table of a row a line, which pixels meet by an equality join.  All else is column arithmetic
with each scene's own constants.

telemetry: pass_id, jd, seconds, x, y, z (km), vx, vy, vz (km/s), Earth-fixed; some hundred records a pass.
scenes: scene_id, pass_id, mode, lon, lat, alt, image (chronological, from 0), centres (array of five Julian dates).
gcps: scene_id, x, y, lon, lat, alt; at least none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..model import MODES, mode_of
from . import geometry as geo

AXES = [f"{n}{k}" for n in ("s", "p", "r", "w", "t") for k in range(3)]
FITS = [f"{n}{k}" for n in ("fp", "fr") for k in range(6)]
VALUES = ["days", "gst", "pitch0", "roll0", *AXES, *FITS]
#: Another value of a line: its time if there were no control points.
UNSHIFTED = "days0"
#: Tasks that passes are dealt over, at least, for every core.
TASKS_A_CORE = 4


def line_table(telemetry: DataFrame, scenes: DataFrame, gcps: DataFrame | None = None, values: Sequence[str] = VALUES) -> DataFrame:
    """scene_id, mode, alt, y, and by line: days since the pass's first record, sidereal time, centre angles, satellite,
    axes, the followed target, and the quadratic corrections; of these only ``values``, if given.

    Times and the target are shifted to the control point nearest to the scene's middle, if there is one; corrections need
    three points.  Scenes whose pass has fewer than five records are left out, as are passes without a scene; records of
    equal time count once; order within the tables doesn't matter.
    """
    kinds = dict(scenes.dtypes)
    points = F.array().cast("array<struct<x:double,y:double,lon:double,lat:double,alt:double>>")
    if gcps is not None:
        fields = [F.col(c).cast("double").alias(c) for c in ("x", "y", "lon", "lat", "alt")]
        own = gcps.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("gcps"))
        scenes = scenes.join(own, "scene_id", "left").withColumn("gcps", F.coalesce("gcps", points))
    else:
        scenes = scenes.withColumn("gcps", points)
    records = telemetry.select("pass_id", *[F.col(c).cast("double").alias(c) for c in ("jd", "seconds", "x", "y", "z", "vx", "vy", "vz")])

    def lines(own: pa.Table, rows: pa.Table) -> pa.Table:
        t = own.sort_by("jd")
        jd = t.column("jd").to_numpy()
        t = t.filter(pa.array(np.diff(jd, prepend=-np.inf) > 0))
        column = lambda *n: np.stack([np.asarray(t.column(c)) for c in n], axis=1)
        made: list[list[np.ndarray]] = [[] for _ in range(1 + len(values))]
        ids, modes, heights, counts = [], [], [], []
        if t.num_rows >= 5 and rows.num_rows:
            gps = geo.Gps(np.asarray(t.column("jd")), np.asarray(t.column("seconds")), column("x", "y", "z"), column("vx", "vy", "vz"))
            orbit = geo.Orbit(gps)
            for r in rows.to_pylist():
                info = geo.Acquisition(r["mode"], r["lon"], r["lat"], r["alt"], r["image"])
                found = geo.line_geometry(gps, r["centres"], info, [geo.Gcp(**p) for p in r["gcps"]], orbit)
                n = len(found.days)
                ids.append(r["scene_id"])
                modes.append(r["mode"])
                heights.append(r["alt"])
                counts.append(n)
                own = {"days": found.days, UNSHIFTED: found.unshifted, "gst": geo.sidereal(found.zero + found.days), "pitch0": found.pitch, "roll0": found.roll}
                vectors = (found.satellite, found.pitch_axis, found.roll_axis, found.yaw_axis, found.nominal)
                own |= {name: vectors[k // 3][:, k % 3] for k, name in enumerate(AXES)}
                own |= {name: np.full(n, v) for name, v in zip(FITS, (*found.pitch_fit, *found.roll_fit), strict=True)}
                for k, v in enumerate((np.arange(n, dtype=np.int32), *(own[v] for v in values))):
                    made[k].append(v)
        each = pa.array(np.repeat(np.arange(len(counts)), counts))
        first = [pa.array(v, k).take(each) for v, k in ((ids, rows.schema.field("scene_id").type), (modes, pa.string()), (heights, pa.float64()))]
        rest = [pa.array(np.concatenate(v) if v else [], k) for v, k in zip(made, (pa.int32(), *[pa.float64()] * len(values)), strict=True)]
        return pa.table([*first, *rest], names=["scene_id", "mode", "alt", "y", *values])

    scenes = scenes.select(*[F.col(c).alias(c) for c in scenes.columns])  # may share a plan with the telemetry
    schema = f"scene_id {kinds['scene_id']}, mode string, alt double, y int" + "".join(f", {v} double" for v in values)
    # Records are few bytes and much work: a number of partitions of its own keeps them from being put together by size.
    session = telemetry.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * session.sparkContext.defaultParallelism)
    records, scenes = records.repartition(parts, "pass_id"), scenes.repartition(parts, "pass_id")
    return records.groupBy("pass_id").cogroup(scenes.groupBy("pass_id")).applyInArrow(lines, schema)


def _of_mode(values: dict[str, float], other: float) -> Column:
    """A constant of the row's mode."""
    out = F.lit(float(other))
    for name, v in values.items():
        out = F.when(F.col("mode") == name, F.lit(float(v))).otherwise(out)
    return out


def pixel_angles(pixels: DataFrame, lines: DataFrame) -> DataFrame:
    """Pixels (scene_id, y, x, ...) with their line's columns, and pitch and roll (radians)."""
    fov = {n: math.radians(m.field_of_view) for n, m in MODES.items()}
    step = _of_mode({n: fov[n] / m.columns for n, m in MODES.items()}, fov["2"] / MODES["2"].columns)
    first = _of_mode({n: -v if n == "5" else -v / 2 for n, v in fov.items()}, -fov["2"] / 2)
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    terms = geo.quadratic_terms(x, y)
    terms[0] = F.lit(1.0)
    fit = lambda n: sum((F.col(f"{n}{k}") * t for k, t in enumerate(terms)), F.lit(0.0))
    rows = pixels.join(lines, ["scene_id", "y"])
    return rows.withColumns({"pitch": F.col("pitch0") + fit("fp"), "roll": F.col("roll0") + x * step + first + fit("fr")})


def pixel_positions(angles: DataFrame, altitude: Column, keep: Sequence[str]) -> DataFrame:
    """``keep`` and lon, lat, vaa, vza (degrees), at each row's own altitude (km)."""
    return geo.pixel_positions(angles.withColumn("_at", altitude).drop("alt"), F.col("_at")).select(*keep, "lon", "lat", "vaa", "vza")


def geometric_correction(pixels: DataFrame, telemetry: DataFrame, scenes: DataFrame, gcps: DataFrame | None = None, use_altitude: bool = True) -> DataFrame:
    """Pixels (scene_id, y, x, ...) of all scenes with lon, lat, vaa, vza, pitch and roll; rows of backward scans are flipped.

    Pixels of unknown scenes and beyond a scene's last line have no line and are left out; other columns are kept.
    """
    rows = _of_mode({n: m.rows for n, m in MODES.items()}, mode_of("").rows).cast("int")
    turned = scenes.select("scene_id", F.when(F.col("image") % 2 == 1, rows - 1).alias("_last"))
    flipped = pixels.join(turned, "scene_id").withColumn("y", F.when(F.col("_last").isNotNull(), (F.col("_last") - F.col("y")).cast("int")).otherwise(F.col("y"))).drop("_last")
    angles = pixel_angles(flipped, line_table(telemetry, scenes, gcps))
    return pixel_positions(angles, F.col("alt") if use_altitude else F.lit(0.0), [*pixels.columns, "pitch", "roll"])
