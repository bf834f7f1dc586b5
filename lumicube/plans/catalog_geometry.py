"""Queries: the geometric correction, step by step, for passes of a synthetic orbit over a synthetic target.

Telemetry comes from the events, pixels from the embeddings.
The orbit is a circle, so the SQL of the per-line steps is its closed form and needs no splines.  The other queries are
held against closed forms in the tests: telemetry times are Julian dates, whose 40 microseconds move the splines by
decimetres, which no common rounding hides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import timegeo as g
from ..model import mode_of
from ..operators import geometry as ops, passes
from ..registry import register
from ..sources.testdata import table

MODE = "1"
INFO = ops.Acquisition(MODE, 10.0, 45.0, 0.5, 2)
_EPOCH = 2453000.5


def gps() -> ops.Gps:
    """A circular polar orbit, 600 km high, that passes the target's latitude near the third image's centre."""
    t = np.arange(0.0, 1200.0, 8.0)
    radius, rate = 6978.0, 2 * np.pi / 5800.0
    phase = math.radians(45.0) + rate * (t - 700.0)
    jd = _EPOCH + 0.5 + t / 86400.0
    node = ops.sidereal(np.array([_EPOCH + 0.5 + 700.0 / 86400.0]))[0] + math.radians(11.0)
    pos = radius * np.stack((np.cos(phase) * np.cos(node), np.cos(phase) * np.sin(node), np.sin(phase)), axis=1)
    vel = radius * rate * np.stack((-np.sin(phase) * np.cos(node), -np.sin(phase) * np.sin(node), np.cos(phase)), axis=1)
    gst = -ops.sidereal(jd)
    fixed, moving = ops.turned(pos, gst), ops.turned(vel, gst)
    moving = moving + 7.292115854788046e-5 * np.stack((fixed[:, 1], -fixed[:, 0], 0 * t), axis=1)
    return ops.Gps(jd, t, fixed, moving)


#: Seconds of the images' centres since the first record.
SECONDS = (604.0, 652.0, 700.0, 748.0, 796.0)
CENTRES = [_EPOCH + 0.5 + s / 86400.0 for s in SECONDS]
GCPS = tuple(ops.Gcp(x, y, 10.0 + (x - 186) * 4e-4, 45.0 - (y - 187) * 3e-4, 0.5) for x, y in ((186.4, 187.6), (60.2, 80.9), (300.1, 90.3), (80.7, 300.2), (310.5, 290.8), (190.3, 60.4), (200.8, 330.1)))


# Tables ------------------------------------------------------------------------------------------------------

#: Records of a pass, vectors that make a scene, and how far the nodes of the passes lie apart (degrees, ten of them).
RECORDS, VECTORS, NODE_STEP = 150, 500, 0.05
_M = mode_of(MODE)
_FOV = math.radians(_M.field_of_view)


def _node(p: Column) -> Column:
    return F.radians(11.0 + NODE_STEP * (p % 10))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as records, RECORDS a pass (the last pass has more): every pass has the circular orbit of ``gps``, a day
    later than the one before and with a node of its own."""
    e = table(spark, sf_dir, "events")
    last = max(1, e.count() // RECORDS) - 1
    rows = e.select("event_id", F.least(F.floor(F.col("event_id") / RECORDS), F.lit(last)).alias("pass_id"))
    rows = rows.withColumns({"seconds": 8.0 * (F.col("event_id") - F.col("pass_id") * RECORDS), "day": F.lit(_EPOCH + 0.5) + F.col("pass_id")})
    gst = lambda jd: g.mjd_to_gst(g.jd_to_mjd(jd))
    rows = rows.withColumn("jd", F.col("day") + F.col("seconds") / 86400.0)
    rows = rows.withColumns({"node": gst(F.col("day") + 700.0 / 86400.0) + _node(F.col("pass_id")), "phase": math.radians(45.0) + 2 * math.pi / 5800.0 * (F.col("seconds") - 700.0), "gst": gst(F.col("jd"))})
    radius, rate, phase, node = 6978.0, 2 * math.pi / 5800.0, F.col("phase"), F.col("node")
    pos = (radius * F.cos(phase) * F.cos(node), radius * F.cos(phase) * F.sin(node), radius * F.sin(phase))
    vel = (-radius * rate * F.sin(phase) * F.cos(node), -radius * rate * F.sin(phase) * F.sin(node), radius * rate * F.cos(phase))
    fixed, moving = g.eci_to_ecef(F.col("gst"), pos), g.eci_to_ecef(F.col("gst"), vel)
    rows = rows.select("pass_id", "jd", "seconds", *[c.alias(n) for n, c in zip(("x", "y", "z", "u", "v", "vz"), (*fixed, *moving), strict=True)])
    rate = F.lit(g.EARTH_RATE)
    return rows.select("pass_id", "jd", "seconds", "x", "y", "z", (F.col("u") + rate * F.col("y")).alias("vx"), (F.col("v") - rate * F.col("x")).alias("vy"), "vz")


def _scenes(ids: DataFrame) -> DataFrame:
    """Scenes (scene_id, pass_id) of the mode over the target, at the pass's centre times."""
    day = F.lit(_EPOCH + 0.5) + F.col("pass_id")
    return ids.select(
        "scene_id", "pass_id", F.lit(MODE).alias("mode"), F.lit(INFO.lon).alias("lon"), F.lit(INFO.lat).alias("lat"), F.lit(INFO.alt).alias("alt"), F.lit(INFO.image).alias("image"),
        F.array(*[day + s / 86400.0 for s in SECONDS]).alias("centres"),
    )


def _gcps(scenes: DataFrame, marks: Sequence[ops.Gcp] = ()) -> DataFrame:
    points = F.array(*[F.struct(*[F.lit(float(getattr(c, n))).alias(n) for n in ("x", "y", "lon", "lat", "alt")]) for c in marks or GCPS])
    return scenes.select("scene_id", F.explode(points).alias("c")).select("scene_id", "c.*")


def _pass_lines(spark: SparkSession, sf_dir: str, marks: Sequence[ops.Gcp] | None = None, *, values: Sequence[str]) -> DataFrame:
    """The lines of a scene of every pass; pass_id, line and ``values`` of the line table."""
    records = telemetry(spark, sf_dir)
    scenes = _scenes(records.select("pass_id").distinct().select(F.col("pass_id").alias("scene_id"), "pass_id"))
    lines = passes.line_table(records, scenes, None if marks is None else _gcps(scenes, marks), values)
    return lines.withColumnsRenamed({"scene_id": "pass_id", "y": "line"})


def scenes_and_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every VECTORS vectors are the pixels of a scene, each some 279 of them; the scenes are dealt over the passes."""
    m, i = _M, F.col("vec_id")
    pixels = table(spark, sf_dir, "embeddings").select(F.floor(i / VECTORS).alias("scene_id"), (i % VECTORS).alias("at"))
    each = pixels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(m.rows * m.columns // VECTORS)))).withColumn("k", F.col("at") + VECTORS * F.col("k"))
    each = each.filter(F.col("k") < m.rows * m.columns).select("scene_id", (F.col("k") % m.columns).cast("int").alias("x"), F.floor(F.col("k") / m.columns).cast("int").alias("y"))
    count = telemetry(spark, sf_dir).agg((F.max("pass_id") + 1).alias("n")).first()["n"]  # one number
    return _scenes(pixels.select("scene_id").distinct().withColumn("pass_id", F.col("scene_id") % count)), each


@register("perform_geometric_correction")
def perform_geometric_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of every scene, with control points, over all passes."""
    scenes, pixels = scenes_and_pixels(spark, sf_dir)
    out = passes.geometric_correction(pixels, telemetry(spark, sf_dir), scenes, _gcps(scenes))
    return out.select("scene_id", "x", "y", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "vaa", "vza", "pitch", "roll")])


@register("pixel_position")
def pixel_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes, pixels = scenes_and_pixels(spark, sf_dir)
    angles = passes.pixel_angles(pixels, passes.line_table(telemetry(spark, sf_dir), scenes))
    rows = passes.pixel_positions(angles, F.col("alt"), ["scene_id", "x", "y"])
    return rows.select("scene_id", "x", "y", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "vaa", "vza")])


@register(
    "pitch_roll_pixel",
    f"SELECT vec_id // {VECTORS} AS scene_id, ((vec_id % {VECTORS} + {VECTORS} * k) % {_M.columns})::INTEGER AS x, round(((vec_id % {VECTORS} + {VECTORS} * k) % {_M.columns} + 0.5e0) * {_FOV / _M.columns!r}::DOUBLE - {_FOV / 2!r}::DOUBLE, 12) AS delta, count(*) AS n "
    f"FROM embeddings, range({_M.rows * _M.columns // VECTORS + 1}) t(k) WHERE vec_id % {VECTORS} + {VECTORS} * k < {_M.rows * _M.columns} GROUP BY ALL",
)
def pitch_roll_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll of the columns about the pointing, and how many pixels of each scene stand in a column."""
    _, pixels = scenes_and_pixels(spark, sf_dir)
    x = F.col("x")
    return pixels.groupBy("scene_id", "x").agg(F.count("*").alias("n")).select("scene_id", "x", F.round((x + 0.5) * (_FOV / _M.columns) - _FOV / 2, 12).alias("delta"), "n")


@register("pitch_roll_center")
def pitch_roll_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pass_lines(spark, sf_dir, values=("pitch0", "roll0")).select("pass_id", "line", F.col("pitch0").alias("pitch"), F.col("roll0").alias("roll"))


def _sidereal_sql(days: str) -> str:
    """Sidereal time (radians, whole turns not taken off) at days since the first record of pass p."""
    mjd = f"((({_EPOCH + 0.5!r}::DOUBLE + p) + {days}) - {g.MJD_OFFSET}e0)"
    t = f"(({mjd} - 51544.5e0) / 36525)"
    return f"({g.SEC_RAD!r}::DOUBLE * ({g.GST[0]}e0 + ({g.GST[1]}e0 + ({g.GST[2]}e0 - {g.GST[3]} * {t}) * {t}) * {t} + 86400 * ({mjd} - floor({mjd}))))"


def _since_first_sql(seconds: float) -> str:
    """Days since the first record of a time that is given as a Julian date."""
    return f"((({_EPOCH + 0.5!r}::DOUBLE + p) + {seconds}e0 / 86400) - ({_EPOCH + 0.5!r}::DOUBLE + p))"


def _place_sql(lon: str, lat: str, alt: str) -> str:
    n = f"({g.WGS84_A}e0 / sqrt(1 - {g.WGS84_E2!r}::DOUBLE * power(sin(radians({lat})), 2)))"
    return f"""({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS px, ({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS py,
  ((1 - {g.WGS84_E2!r}::DOUBLE) * {n} + {alt}) * sin(radians({lat})) AS pz"""


#: The circular orbit's node, and for every line its time, the normal of the plane that the Earth carries along since the
#: setup, and the target as the slowed scan turns it about that normal.
_LINES_SQL = f"""passes AS (SELECT p::BIGINT AS p FROM (SELECT greatest(count(*) // {RECORDS}, 1) AS n FROM events), LATERAL (SELECT unnest(range(n::BIGINT)) AS p)),
times AS (SELECT p, {_since_first_sql(604.0)} - {ops.SETUP_SECONDS}e0 / 86400 AS setup, {_since_first_sql(700.0)} AS middle, {_sidereal_sql(_since_first_sql(700.0))} + radians(11.0e0 + {NODE_STEP}e0 * (p % 10)) AS node FROM passes),
ats AS (SELECT p, k::INTEGER AS line, setup, node, middle, (middle - {_M.rows} * {_M.time_per_line!r}::DOUBLE / 2 / 86400) + (k * {_M.time_per_line!r}::DOUBLE + {_M.integration_time!r}::DOUBLE / 2) / 86400 AS days FROM times, range({_M.rows}) t(k)),
turn AS (SELECT p, line, node, {_sidereal_sql("days")} AS gst, node - {_sidereal_sql("setup")} + {_sidereal_sql("days")} AS carried, 2 * pi() / 5800 / {ops.SLOW_DOWN}e0 * (days - middle) * 86400 AS a FROM ats),
place AS (SELECT {_place_sql(f"{INFO.lon}e0", f"{INFO.lat}e0", f"{INFO.alt}e0")}),
still AS (SELECT p, line, gst, a, sin(carried) AS n0, -cos(carried) AS n1, cos(gst) * px - sin(gst) * py AS v0, sin(gst) * px + cos(gst) * py AS v1, pz AS v2 FROM turn, place),
followed AS (SELECT p, line, gst, v0 * cos(a) + n1 * v2 * sin(a) + n0 * (n0 * v0 + n1 * v1) * (1 - cos(a)) AS t0,
  v1 * cos(a) - n0 * v2 * sin(a) + n1 * (n0 * v0 + n1 * v1) * (1 - cos(a)) AS t1, v2 * cos(a) + (n0 * v1 - n1 * v0) * sin(a) AS t2 FROM still)"""


def _rounded(df: DataFrame, digits: int, **values: Column) -> DataFrame:
    return df.select("pass_id", "line", *[(F.round(c, digits) + 0.0).alias(n) for n, c in values.items()])


@register("orbital_plane", f"WITH {_LINES_SQL} SELECT p AS pass_id, line, round(sin(node), 9) AS n0, round(-cos(node), 9) AS n1, 0.0::DOUBLE AS n2 FROM turn")
def orbital_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pass_lines(spark, sf_dir, values=("p0", "p1", "p2")), 9, n0=F.col("p0"), n1=F.col("p1"), n2=F.col("p2"))


@register("target_scan_rotation", f"WITH {_LINES_SQL} SELECT p AS pass_id, line, round(t0, 6) AS t0, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM followed")
def target_scan_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pass_lines(spark, sf_dir, values=("t0", "t1", "t2")), 6, t0=F.col("t0"), t1=F.col("t1"), t2=F.col("t2"))


_NEAREST_SQL = f"""{_LINES_SQL}, mark AS (SELECT {_place_sql(f"{GCPS[0].lon!r}::DOUBLE", f"{GCPS[0].lat!r}::DOUBLE", f"{GCPS[0].alt}e0")}),
near AS (SELECT p, arg_min(line, power(cos(gst) * t0 + sin(gst) * t1 - px, 2) + power(cos(gst) * t1 - sin(gst) * t0 - py, 2) + power(t2 - pz, 2)) AS line FROM followed, mark GROUP BY p)"""


@register("gcp_time_shift", f"WITH {_NEAREST_SQL} SELECT t.p AS pass_id, t.line, round(((near.line + 1) % {_M.rows} - {GCPS[0].y + 0.5!r}::DOUBLE) * {_M.time_per_line!r}::DOUBLE, 9) AS shift_seconds FROM turn t JOIN near USING (p)")
def gcp_time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pass_lines(spark, sf_dir, GCPS[:1], values=("days", passes.UNSHIFTED))
    return _rounded(rows, 9, shift_seconds=(F.col("days") - F.col(passes.UNSHIFTED)) * ops.DAY)


@register("gcp_quadratic_fit")
def gcp_quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six coefficients (line counts them from 0) of pitch and roll of every pass."""
    first = _pass_lines(spark, sf_dir, GCPS, values=passes.FITS).filter("line = 0")
    both = F.arrays_zip(F.array(*[f"fp{k}" for k in range(6)]).alias("pitch"), F.array(*[f"fr{k}" for k in range(6)]).alias("roll"))
    return first.select("pass_id", F.posexplode(both).alias("line", "c")).select("pass_id", "line", "c.pitch", "c.roll")


@register("pitch_roll_refine")
def pitch_roll_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes, pixels = scenes_and_pixels(spark, sf_dir)
    rows = passes.pixel_angles(pixels, passes.line_table(telemetry(spark, sf_dir), scenes, _gcps(scenes)))
    return rows.select("scene_id", "x", "y", F.round("pitch", 9).alias("pitch"), F.round("roll", 9).alias("roll"))
