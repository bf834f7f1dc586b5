"""Time scales, coordinates and viewing geometry as column functions.  Lengths are km, angles degrees unless said."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: WGS-84 ellipsoid, rotation of the Earth (rad/s).
WGS84_A, WGS84_F = 6378.137, 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)
EARTH_RATE = 7.292115854788046e-5
#: Julian dates of the epochs, and offset of the modified Julian date.
JD_UNIX, MJD_OFFSET, JD_MJD2000 = 2440587.5, 2400000.5, 2451544.5
JD_GPS, JD_ICT = 2444244.5, 2451538.5
#: IAU 1982 mean sidereal time, radians a sidereal second.
GST = (24110.54841, 8640184.812866, 0.093104, 6.2e-6)
SEC_RAD = 7.272205216643039903848712e-5

Vector = tuple[Column, Column, Column]


def julian_date(ts: Column) -> Column:
    return F.unix_millis(ts) / 864e5 + JD_UNIX


def jd_to_mjd(jd: Column) -> Column:
    return jd - MJD_OFFSET


def jd_to_mjd2000(jd: Column) -> Column:
    return jd - JD_MJD2000


def mjd_to_gst(mjd: Column) -> Column:
    """Greenwich mean sidereal time (radians, from 0 to 2 pi) of a UT1 date."""
    a, b, c, d = GST
    t = (mjd - 51544.5) / 36525.0
    f = 86400.0 * (mjd - F.floor(mjd))
    return F.pmod(SEC_RAD * (a + (b + (c - d * t) * t) * t + f), F.lit(2 * math.pi))


#: Fixed value (s): delay of the position telemetry.
GPS_DELAY = 0.999


def gps_to_jd(week: Column, seconds: Column, delta_gps: Column, delay: float = 0.0) -> Column:
    return JD_GPS + week * 7 + (seconds - delay - delta_gps) / 86400.0


def ict_to_jd(value: Column, delta_gps: Column) -> Column:
    return (value - delta_gps) / 86400.0 + JD_ICT


def rotate_z(c: Column, s: Column, v: Vector) -> Vector:
    return c * v[0] - s * v[1], s * v[0] + c * v[1], v[2]


def ecef_to_eci(gst: Column, v: Vector) -> Vector:
    return rotate_z(F.cos(gst), F.sin(gst), v)


def eci_to_ecef(gst: Column, v: Vector) -> Vector:
    return rotate_z(F.cos(gst), -F.sin(gst), v)


def velocity_to_eci(gst: Column, position: Vector, velocity: Vector) -> Vector:
    """Velocity in the inertial frame; ``position`` is Earth-fixed.  The rotation of the frame is added."""
    x, y, _ = ecef_to_eci(gst, position)
    u, v, w = ecef_to_eci(gst, velocity)
    return u - EARTH_RATE * y, v + EARTH_RATE * x, w


def wgs_to_ecef(lon: Column, lat: Column, alt: Column) -> Vector:
    u, v = F.radians(lon), F.radians(lat)
    n = WGS84_A / F.sqrt(1.0 - WGS84_E2 * F.sin(v) * F.sin(v))
    return (n + alt) * F.cos(v) * F.cos(u), (n + alt) * F.cos(v) * F.sin(u), ((1.0 - WGS84_E2) * n + alt) * F.sin(v)


def with_wgs(rows: DataFrame, v: Vector, names: tuple[str, str, str] = ("lon", "lat", "alt")) -> DataFrame:
    """``rows`` with longitude, latitude and altitude, by the closed solution of the quartic; the poles and the
    equator apart.

    Every quantity is a projection of its own: as one expression, the repeated terms would grow beyond what code
    generation takes.
    """
    x, y, z = v
    keep = rows.columns
    b, ar = F.col("_b"), F.nullif(WGS84_A * F.col("_r"), F.lit(0.0))
    e, f, w, g, t = (F.col(n) for n in ("_e", "_f", "_w", "_g", "_t"))
    rows = rows.withColumns({"_x": x, "_y": y, "_z": z})
    rows = rows.withColumns({"_b": WGS84_B * F.signum("_z"), "_r": F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))})
    rows = rows.withColumn("_s", WGS84_A * WGS84_A - b * b)
    rows = rows.withColumns({"_e": (b * F.col("_z") - F.col("_s")) / ar, "_f": (b * F.col("_z") + F.col("_s")) / ar})
    rows = rows.withColumns({"_p": (e * f + 1.0) * 4.0 / 3.0, "_q": 2.0 * (e * e - f * f)})
    rows = rows.withColumn("_d", F.sqrt(F.col("_p") * F.col("_p") * F.col("_p") + F.col("_q") * F.col("_q")))
    rows = rows.withColumn("_w", F.cbrt(F.col("_d") - F.col("_q")) - F.cbrt(F.col("_d") + F.col("_q")))
    rows = rows.withColumn("_g", (F.sqrt(e * e + w) + e) / 2.0)
    rows = rows.withColumn("_t", F.sqrt(g * g + (f - w * g) / F.nullif(2.0 * g - e, F.lit(0.0))) - g)
    # South of the equator the arc tangent lies in the second quadrant; half a turn less gives latitude and altitude
    # their right signs (the reference corrects the latitude only).
    rows = rows.withColumn("_phi", F.atan2(WGS84_A * (1.0 - t * t), 2.0 * b * t))
    rows = rows.withColumn("_phi", F.when(F.col("_phi") > math.pi / 2, F.col("_phi") - math.pi).otherwise(F.col("_phi")))
    r, zz, phi = F.col("_r"), F.col("_z"), F.col("_phi")
    pole = (r < 1e-6) & (zz != 0)  # within a millimetre of the axis the solution degenerates
    high = (r - WGS84_A * t) * F.cos(phi) + (zz - b) * F.sin(phi)
    return rows.select(
        *keep,
        F.when(pole, 0.0).otherwise(F.degrees(F.atan2("_y", "_x"))).alias(names[0]),
        F.when(zz == 0, 0.0).when(pole, 90.0 * F.signum(zz)).otherwise(F.degrees(phi)).alias(names[1]),
        F.when(zz == 0, r - WGS84_A).when(pole, F.abs(zz - b)).otherwise(high).alias(names[2]),
    )

def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = F.nullif(norm(a), F.lit(0.0))
    return a[0] / n, a[1] / n, a[2] / n


def angle(a: Vector, b: Vector) -> Column:
    """Angle in radians; 0 where the scalar or the vector product vanishes, as in the reference."""
    c, s = dot(a, b), norm(cross(a, b))
    return F.when((c != 0) & (s != 0), F.atan2(s, c)).otherwise(0.0)


def rotate(axis: Vector, radians: Column, v: Vector) -> Vector:
    """Rotation about a unit axis, as the quaternion product q v q* expands."""
    w, s = F.cos(radians / 2), F.sin(radians / 2)
    q = (axis[0] * s, axis[1] * s, axis[2] * s)
    t = tuple(2.0 * c for c in cross(q, v))
    u = cross(q, t)
    return v[0] + w * t[0] + u[0], v[1] + w * t[1] + u[1], v[2] + w * t[2] + u[2]


Quaternion = tuple[Column, Column, Column, Column]


def quaternion_product(p: Quaternion, q: Quaternion) -> Quaternion:
    a, b, c, d = p
    e, f, g, h = q
    return a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e


def intersect(point: Vector, direction: Vector, axes: tuple[float, float, float]) -> Vector:
    """Where a line meets an ellipsoid about the origin, nearest to the point; NaN where it misses."""
    rr = [x * x for x in axes]
    a = sum((d * d / r for d, r in zip(direction, rr, strict=True)), F.lit(0.0))
    b = sum((d * p / r for d, p, r in zip(direction, point, rr, strict=True)), F.lit(0.0))
    c = sum((p * p / r for p, r in zip(point, rr, strict=True)), F.lit(-1.0))
    disc = b * b - a * c
    root = F.when(disc >= 0, F.sqrt(disc)).otherwise(float("nan"))
    t = F.when(b > 0, (root - b) / a).otherwise((-b - root) / a)
    return point[0] + t * direction[0], point[1] + t * direction[1], point[2] + t * direction[2]


def viewing_geometry(position: Vector, satellite: Vector, lat: Column) -> tuple[Column, Column]:
    """Azimuth and zenith angle (radians) under which ``position``, at geodetic latitude ``lat``, is seen."""
    v = tuple(p - s for p, s in zip(position, satellite, strict=True))
    phi = F.radians(lat)
    sp, cp = F.sin(phi), F.cos(phi)
    r = F.sqrt(position[0] * position[0] + position[1] * position[1])
    st, ct = position[1] / r, position[0] / r
    south = cp * v[2] - sp * ct * v[0] - sp * st * v[1]
    east = ct * v[1] - st * v[0]
    up = cp * ct * v[0] + cp * st * v[1] + sp * v[2]
    zenith = math.pi / 2 + F.asin(up / norm(v))
    azimuth = F.atan(east / south) + F.when(south > 0, math.pi).when(south < 0, 2 * math.pi).otherwise(0.0)
    return F.pmod(azimuth, F.lit(2 * math.pi)), zenith


#: Chronological image numbers by image number from 1; odd ones scan backwards.
CHRONOLOGICAL = (2, 1, 3, 0, 4)


def chronological_image(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CHRONOLOGICAL]), number.cast("int"))
