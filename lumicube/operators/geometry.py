"""Geometric correction: longitude, latitude and view angles of every pixel from telemetry.

What depends on the line alone (a thousand rows at most) is computed with numpy when the plan is built: satellite
positions by splines, the moving target, axes and the angles that point at it, and the correction from control points.
Pixels then meet their line by a broadcast equality join, and everything else is column arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import timegeo as g
from ..model import Mode, mode_of
from .lookups import spline_coefficients
from .smoothing import lowess

#: The scan follows the target this many times slower than the satellite moves.
SLOW_DOWN = 5.0
#: Seconds from the orbit's fixing to the first image's centre.
SETUP_SECONDS = 400.0
DAY = 86400.0


@dataclass(frozen=True)
class Acquisition:
    mode: str
    lon: float
    lat: float
    alt: float  # km
    image: int  # chronological, from 0; odd images scan backwards

    @property
    def constants(self) -> Mode:
        return mode_of(self.mode)

    @property
    def backward(self) -> bool:
        return self.image % 2 == 1


@dataclass(frozen=True)
class Gcp:
    x: float
    y: float
    lon: float
    lat: float
    alt: float


@dataclass(frozen=True)
class Gps:
    """Telemetry by record: Julian date, seconds, position (km) and velocity (km/s) in the Earth-fixed frame."""

    jd: np.ndarray
    seconds: np.ndarray
    position: np.ndarray
    velocity: np.ndarray


@dataclass(frozen=True)
class Lines:
    """By line: time, satellite, axes and centre angles; and the quadratic corrections of pitch and roll.

    Times are days since ``zero``, the Julian date of the first record: a Julian date resolves 40 microseconds, in which
    the satellite moves 0.3 m, and azimuths at small zenith angles show that.
    """

    zero: float
    days: np.ndarray
    satellite: np.ndarray
    pitch_axis: np.ndarray
    roll_axis: np.ndarray
    yaw_axis: np.ndarray
    pitch: np.ndarray
    roll: np.ndarray
    pitch_fit: np.ndarray
    roll_fit: np.ndarray
    nominal: np.ndarray  # inertial positions of the followed target, without control points
    unshifted: np.ndarray  # times without control points


def sidereal(jd: np.ndarray) -> np.ndarray:
    mjd = np.asarray(jd) - g.MJD_OFFSET
    a, b, c, d = g.GST
    t = (mjd - 51544.5) / 36525.0
    return np.mod(g.SEC_RAD * (a + (b + (c - d * t) * t) * t + DAY * (mjd - np.floor(mjd))), 2 * np.pi)


def turned(v: np.ndarray, angle: np.ndarray) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.stack((c * v[..., 0] - s * v[..., 1], s * v[..., 0] + c * v[..., 1], v[..., 2] + 0 * c), axis=-1)


def rotated(axis: np.ndarray, angle: np.ndarray, v: np.ndarray) -> np.ndarray:
    w, q = np.cos(angle / 2)[..., None], axis * np.sin(angle / 2)[..., None]
    t = 2 * np.cross(q, v)
    return v + w * t + np.cross(q, t)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c, s = (a * b).sum(axis=-1), np.linalg.norm(np.cross(a, b), axis=-1)
    return np.where((c != 0) & (s != 0), np.arctan2(s, c), 0.0)


def earth_fixed(lon: float, lat: float, alt: float) -> np.ndarray:
    u, v = math.radians(lon), math.radians(lat)
    n = g.WGS84_A / math.sqrt(1 - g.WGS84_E2 * math.sin(v) ** 2)
    return np.array(((n + alt) * math.cos(v) * math.cos(u), (n + alt) * math.cos(v) * math.sin(u), ((1 - g.WGS84_E2) * n + alt) * math.sin(v)))


class Orbit:
    """Splines through the records' inertial positions and velocities, but for the last two records.

    Its times are days since the first record.
    """

    def __init__(self, gps: Gps):
        gst = sidereal(gps.jd)
        pos, vel = turned(gps.position, gst), turned(gps.velocity, gst)
        vel = vel + g.EARTH_RATE * np.stack((-pos[:, 1], pos[:, 0], 0 * pos[:, 0]), axis=1)
        n = len(gps.jd) - 2
        self.zero = gps.jd[0]
        self.t, state = gps.jd[:n] - self.zero, np.concatenate((pos, vel), axis=1)[:n]
        nxt = np.concatenate((pos[1:], pos[:1]))
        gap = np.concatenate((np.diff(gps.seconds), [gps.seconds[-1] - gps.seconds[0]]))
        rate = lowess((angle(pos, nxt) / gap)[:n], 0, 5, 0)
        if n < 3 or (np.diff(self.t) <= 0).any():
            raise ValueError("a spline needs three or more strictly increasing knots")
        self.segments = spline_coefficients(self.t, np.concatenate((state, rate[:, None]), axis=1))

    def _values(self, days: np.ndarray) -> np.ndarray:
        """Positions, velocities and angular rate (times, 7)."""
        i = np.clip(np.searchsorted(self.t[:-1], days, side="right") - 1, 0, len(self.t) - 2)
        h = (days - self.t[i])[:, None]
        a, b, c, d = (v[i] for v in self.segments)
        return a + h * (b + h * (c + h * d))

    def at(self, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self._values(days)
        return s[:, :3], s[:, 3:6]

    def angular_rate(self, days: float) -> float:
        return float(self._values(np.array([days]))[0, 6])

    def sidereal(self, days: np.ndarray) -> np.ndarray:
        return sidereal(self.zero + np.asarray(days))


def line_times(mode: Mode, centre: float) -> np.ndarray:
    """Times of the lines of an image about its centre, in days as ``centre``."""
    start = centre - mode.rows * mode.time_per_line / 2 / DAY
    return start + (np.arange(mode.rows) * mode.time_per_line + mode.integration_time / 2) / DAY


def _plane(orbit: Orbit, setup: float, days: np.ndarray) -> np.ndarray:
    """Normal of the orbital plane, fixed to the Earth at setup time."""
    r, v = orbit.at(np.array([setup]))
    fixed = turned(unit(np.cross(r, v)), -orbit.sidereal(np.array([setup])))
    return turned(np.broadcast_to(fixed, (len(days), 3)), orbit.sidereal(days))


def _followed(orbit: Orbit, setup: float, days: np.ndarray, place: np.ndarray, middle: float, image: int) -> np.ndarray:
    """Inertial positions of a place as the slowed scan follows it, right at time ``middle``."""
    target = turned(np.broadcast_to(place, (len(days), 3)), orbit.sidereal(days))
    a = orbit.angular_rate(setup) / SLOW_DOWN * (days - middle) * DAY
    return rotated(_plane(orbit, setup, days), a if image % 2 == 0 else -a, target)


def _angles(satellite: np.ndarray, target: np.ndarray, pitch_axis: np.ndarray, yaw_axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pitch and roll that point from the satellite at the target.

    Pitch turns about the pitch axis, from straight down towards the roll axis; roll then tilts towards the pitch axis.
    """
    line = target - satellite
    across, along, up = ((line * axis).sum(axis=-1) for axis in (pitch_axis, np.cross(pitch_axis, yaw_axis), yaw_axis))
    return np.arctan2(along, -up), np.arctan2(across, np.hypot(along, up))


def column_offsets(mode_name: str) -> np.ndarray:
    """Roll of the columns about the pointing; in mode 5 the last column points at the target."""
    m = mode_of(mode_name)
    fov = math.radians(m.field_of_view)
    return (np.arange(m.columns) + 0.5) * fov / m.columns - (fov if mode_name == "5" else fov / 2)


def quadratic_terms(x, y):
    return [1.0 + 0 * x, x, y, x * x, x * y, y * y]


def nearest_gcp(gcps: Sequence[Gcp], x: float, y: float) -> int:
    return min(range(len(gcps)), key=lambda k: ((gcps[k].x - x) ** 2 + (gcps[k].y - y) ** 2, k)) if gcps else -1


def line_geometry(gps: Gps, centres: Sequence[float], info: Acquisition, gcps: Sequence[Gcp] = (), orbit: Orbit | None = None) -> Lines:
    """Everything that depends on the line.  ``centres`` are the five images' centre times (Julian dates, UT1),
    ``orbit`` the records' orbit, if it is fitted already."""
    m, orbit = info.constants, orbit or Orbit(gps)
    setup, middle = centres[0] - orbit.zero - SETUP_SECONDS / DAY, centres[info.image] - orbit.zero
    days = unshifted = line_times(m, middle)
    best = nearest_gcp(gcps, m.rows / 2, m.rows / 2)
    ifov = math.radians(m.instantaneous_field_of_view)
    nominal = target = _followed(orbit, setup, days, earth_fixed(info.lon, info.lat, info.alt), middle, info.image)
    extra = 0.0
    if best >= 0:
        # The time of closest approach to the control point shifts all times.
        c = gcps[best]
        place = earth_fixed(c.lon, c.lat, c.alt)
        near = int(np.argmin(np.linalg.norm(turned(nominal, -orbit.sidereal(days)) - place, axis=1)))
        middle = days[near]
        line = (near + 1) % m.rows
        shift = (line - (m.rows - c.y + 0.5 if info.backward else c.y + 0.5)) * m.time_per_line / DAY
        days, setup = days + shift, setup + shift
        target = _followed(orbit, setup, days, place, middle, info.image)
        extra = ((m.columns // 2 if info.mode != "5" else m.columns - 1) - c.x) * ifov
    satellite, velocity = orbit.at(days)
    pitch_axis, yaw_axis = unit(np.cross(satellite, velocity)), unit(satellite)
    pitch, roll = _angles(satellite, target, pitch_axis, yaw_axis)
    roll = roll + extra
    fits = np.zeros((2, 6))
    if len(gcps) > 2:
        row = np.array([int(c.y) for c in gcps])
        column = np.array([int(c.x) for c in gcps])
        seen = np.stack([turned(earth_fixed(c.lon, c.lat, c.alt), orbit.sidereal(days[r])) for c, r in zip(gcps, row, strict=True)])
        p, r = _angles(satellite[row], seen, pitch_axis[row], yaw_axis[row])
        terms = np.stack(quadratic_terms(np.array([c.x for c in gcps]), np.array([c.y for c in gcps])), axis=1)
        wrong = np.stack((p - pitch[row], r - roll[row] - column_offsets(info.mode)[column]), axis=1)
        fits = np.linalg.lstsq(terms, wrong, rcond=None)[0].T
    return Lines(orbit.zero, days, satellite, pitch_axis, np.cross(pitch_axis, yaw_axis), yaw_axis, pitch, roll, fits[0], fits[1], nominal, unshifted)


def lines_frame(spark: SparkSession, lines: Lines) -> DataFrame:
    names = [f"{n}{k}" for n in ("s", "p", "r", "w") for k in range(3)]
    values = np.concatenate((lines.satellite, lines.pitch_axis, lines.roll_axis, lines.yaw_axis), axis=1)
    rows = [(k, float(sidereal(lines.zero + lines.days[k])), float(lines.pitch[k]), float(lines.roll[k]), *map(float, values[k])) for k in range(len(lines.days))]
    return spark.createDataFrame(rows, "y int, gst double, pitch0 double, roll0 double, " + ", ".join(f"{n} double" for n in names))


def pixel_angles(pixels: DataFrame, lines: Lines, mode_name: str) -> DataFrame:
    """Pixels (y, x, ...) with their line's columns, pitch and roll (radians)."""
    m = mode_of(mode_name)
    fov = math.radians(m.field_of_view)
    x, y = F.col("x") + 0.5, F.col("y") + 0.5

    def quadratic(c: np.ndarray) -> Column:
        return sum((F.lit(float(v)) * t for v, t in zip(c, quadratic_terms(x, y), strict=True)), F.lit(0.0))

    rows = pixels.join(F.broadcast(lines_frame(pixels.sparkSession, lines)), "y")  # a row a line
    offset = x * (fov / m.columns) - (fov if mode_name == "5" else fov / 2)
    return rows.withColumns({"pitch": F.col("pitch0") + quadratic(lines.pitch_fit), "roll": F.col("roll0") + offset + quadratic(lines.roll_fit)})


def pixel_positions(angles: DataFrame, altitude: float | Column) -> DataFrame:
    """lon, lat, vaa, vza (degrees) beside pitch and roll."""
    v = lambda n: tuple(F.col(f"{n}{k}") for k in range(3))
    keep = [c for c in angles.columns if c not in {"gst", "pitch0", "roll0", *(f"{n}{k}" for n in "sprw" for k in range(3))}]
    put = lambda df, n, t: df.withColumns({f"{n}{k}": c for k, c in enumerate(t)})
    rows = put(angles, "d", g.rotate(v("p"), -F.col("pitch"), tuple(-c for c in v("w"))))
    rows = put(rows, "q", g.rotate(v("p"), -F.col("pitch"), v("r")))
    rows = put(rows, "e", g.rotate(v("q"), F.col("roll"), v("d")))
    axes = (g.WGS84_A + altitude, g.WGS84_A + altitude, g.WGS84_B + altitude)
    rows = put(rows, "h", g.intersect(v("s"), v("e"), axes))
    rows = g.with_wgs(rows, v("h"), ("_lon", "_lat", "_alt"))
    azimuth, zenith = g.viewing_geometry(v("h"), v("s"), F.col("_lat"))
    rows = rows.withColumns({"vaa": F.degrees(azimuth), "vza": F.degrees(zenith)})
    rows = put(rows, "f", g.eci_to_ecef(F.col("gst"), v("h")))
    return g.with_wgs(rows, v("f")).select(*keep, "lon", "lat", "vaa", "vza")


def geometric_correction(pixels: DataFrame, gps: Gps, centres: Sequence[float], info: Acquisition, gcps: Sequence[Gcp] = (), use_altitude: bool = True, include_angles: bool = False) -> DataFrame:
    """Pixels (y, x, ...) with lon, lat, vaa, vza and, if asked for, pitch and roll; backward scans are flipped."""
    m = info.constants
    if info.backward:
        pixels = pixels.withColumn("y", (m.rows - 1 - F.col("y")).cast("int"))
    out = pixel_positions(pixel_angles(pixels, line_geometry(gps, centres, info, gcps), info.mode), info.alt if use_altitude else 0.0)
    return out if include_angles else out.drop("pitch", "roll")
