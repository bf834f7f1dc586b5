"""Queries: time scales, coordinates, geometry, and lookups in small tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import timegeo as g
from ..operators import lookups
from ..registry import register
from ..sources.testdata import TELEMETRY_SQL, table, telemetry
from ..sources.time_tables import LEAP_SECONDS, leap_seconds

_TWO_PI = f"{2 * math.pi!r}::DOUBLE"
_A, _B, _E2 = (f"{v!r}::DOUBLE" for v in (g.WGS84_A, g.WGS84_B, g.WGS84_E2))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", g.julian_date(F.col("o_orderdate").cast("timestamp")).alias("jd"))


_JD_SQL = f"jd AS (SELECT o_orderkey, epoch_ms(o_orderdate) / 864e5 + {g.JD_UNIX}e0 AS jd FROM orders)"


@register("julian_date", f"WITH {_JD_SQL} SELECT o_orderkey, round(jd, 6) AS jd FROM jd")
def julian_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", F.round("jd", 6).alias("jd"))


@register("date_to_mjd", f"WITH {_JD_SQL} SELECT o_orderkey, round(jd - {g.MJD_OFFSET}e0, 6) AS mjd, round(jd - {g.JD_MJD2000}e0, 6) AS mjd2000 FROM jd")
def date_to_mjd(spark: SparkSession, sf_dir: str) -> DataFrame:
    jd = F.col("jd")
    return _orders(spark, sf_dir).select("o_orderkey", F.round(g.jd_to_mjd(jd), 6).alias("mjd"), F.round(g.jd_to_mjd2000(jd), 6).alias("mjd2000"))


_GST_POLY = f"(({g.GST[0]}e0 + ({g.GST[1]}e0 + ({g.GST[2]}e0 - {g.GST[3]} * tt) * tt) * tt + 86400 * (mjd - floor(mjd))) * {g.SEC_RAD!r}::DOUBLE)"
_GST_SQL = f"{_JD_SQL}, m AS (SELECT o_orderkey, mjd, (mjd - 51544.5e0) / 36525 AS tt FROM (SELECT o_orderkey, jd - {g.MJD_OFFSET}e0 AS mjd FROM jd)), gst AS (SELECT o_orderkey, mjd, {_GST_POLY} - floor({_GST_POLY} / {_TWO_PI}) * {_TWO_PI} AS gst FROM m)"


@register("mjd_to_gst", f"WITH {_GST_SQL} SELECT o_orderkey, round(gst, 6) AS gst FROM gst")
def mjd_to_gst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", F.round(g.mjd_to_gst(g.jd_to_mjd(F.col("jd"))), 6).alias("gst"))


_TAI_SQL = "tai AS (SELECT jd - 2400000.5e0 AS mjd, s::DOUBLE AS tai_utc FROM (VALUES " + ", ".join(f"({jd}e0, {s}e0)" for jd, s in LEAP_SECONDS) + ") v(jd, s))"


@register("join_asof_tai", f"WITH {_JD_SQL}, {_TAI_SQL} SELECT o_orderkey, tai_utc FROM (SELECT o_orderkey, jd - {g.MJD_OFFSET}e0 AS mjd FROM jd) o ASOF JOIN tai t ON o.mjd >= t.mjd")
def join_asof_tai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.as_of(_orders(spark, sf_dir), g.jd_to_mjd(F.col("jd")), leap_seconds(spark), "mjd", "tai_utc").select("o_orderkey", "tai_utc")


@register("delta_gps", f"WITH {_JD_SQL}, {_TAI_SQL} SELECT o_orderkey, tai_utc - 19 AS delta FROM (SELECT o_orderkey, jd - {g.MJD_OFFSET}e0 AS mjd FROM jd) o ASOF JOIN tai t ON o.mjd >= t.mjd")
def delta_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.as_of(_orders(spark, sf_dir), g.jd_to_mjd(F.col("jd")), leap_seconds(spark), "mjd", "tai_utc")
    return out.select("o_orderkey", (F.col("tai_utc") - 19.0).alias("delta"))


def ut1_stand_in(spark: SparkSession) -> DataFrame:
    """mjd, ut1_utc on a ten-day grid: a stand-in for the published table."""
    mjd = 47000.0 + F.col("id") * 10
    return spark.range(1000).select(mjd.alias("mjd"), (0.4 * F.sin(mjd / 100)).alias("ut1_utc"))


_UT1_SQL = f"{_JD_SQL}, ut1 AS (SELECT 47000.0e0 + i * 10 AS mjd, 0.4e0 * sin((47000.0e0 + i * 10) / 100) AS u FROM range(1000) t(i)), seg AS (SELECT mjd AS lo, lead(mjd) OVER (ORDER BY mjd) AS hi, u, lead(u) OVER (ORDER BY mjd) AS nu FROM ut1), od AS (SELECT o_orderkey, jd, jd - {g.MJD_OFFSET}e0 AS mjd FROM jd), d AS (SELECT o_orderkey, jd, u + (mjd - lo) / (hi - lo) * (nu - u) AS delta FROM od JOIN seg ON mjd >= lo AND mjd < hi)"


@register("join_interp_ut1", f"WITH {_UT1_SQL} SELECT o_orderkey, round(delta, 8) AS delta FROM d")
def join_interp_ut1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.interpolated(_orders(spark, sf_dir), g.jd_to_mjd(F.col("jd")), ut1_stand_in(spark), "mjd", "ut1_utc")
    return out.select("o_orderkey", F.round("ut1_utc", 8).alias("delta"))


@register("delta_ut1", f"WITH {_UT1_SQL} SELECT o_orderkey, round(jd + delta / 86400 - 2440000, 9) AS ut1 FROM d")
def delta_ut1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.interpolated(_orders(spark, sf_dir), g.jd_to_mjd(F.col("jd")), ut1_stand_in(spark), "mjd", "ut1_utc")
    return out.select("o_orderkey", F.round(F.col("jd") + F.col("ut1_utc") / 86400.0 - 2440000, 9).alias("ut1"))


@register("gps_time_to_jd", f"SELECT event_id, round({g.JD_GPS}e0 + (1000 + user_id % 500) * 7 + (value * 1000 - 13) / 86400, 6) AS jd FROM events")
def gps_time_to_jd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(g.gps_to_jd(1000 + F.col("user_id") % 500, F.col("value") * 1000, F.lit(13.0)), 6).alias("jd"))


@register("ict_to_jd", f"SELECT event_id, round((value * 1e5 - 13) / 86400 + {g.JD_ICT}e0, 6) AS jd FROM events")
def ict_to_jd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(g.ict_to_jd(F.col("value") * 1e5, F.lit(13.0)), 6).alias("jd"))


# Coordinates of the line items: longitude, latitude and altitude made of keys --------------------------------

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_LON, _LAT, _ALT = "(l_partkey * 7 % 360 - 180 + l_discount)", "(l_suppkey * 13 % 170 - 85 + l_tax)", "(l_quantity / 25)"
_LLA = f"SELECT {', '.join(_KEY)}, {_LON} AS lon, {_LAT} AS lat, {_ALT} AS alt, l_extendedprice % 6 AS gst FROM lineitem"
_N = f"({_A} / sqrt(1 - {_E2} * power(sin(radians(lat)), 2)))"
_ECEF_SQL = f"ecef AS (SELECT *, ({_N} + alt) * cos(radians(lat)) * cos(radians(lon)) AS px, ({_N} + alt) * cos(radians(lat)) * sin(radians(lon)) AS py, ((1 - {_E2}) * {_N} + alt) * sin(radians(lat)) AS pz FROM ({_LLA}))"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    lon = F.col("l_partkey") * 7 % 360 - 180 + F.col("l_discount")
    lat = F.col("l_suppkey") * 13 % 170 - 85 + F.col("l_tax")
    return rows.select(*_KEY, lon.alias("lon"), lat.alias("lat"), (F.col("l_quantity") / 25).alias("alt"), (F.col("l_extendedprice") % 6).alias("gst"))


def _ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = g.wgs_to_ecef(F.col("lon"), F.col("lat"), F.col("alt"))
    return _places(spark, sf_dir).withColumns({"px": x, "py": y, "pz": z})


def _p() -> g.Vector:
    return F.col("px"), F.col("py"), F.col("pz")


def _rounded(rows: DataFrame, values: dict[str, Column], digits: int) -> DataFrame:
    return rows.select(*_KEY, *[F.round(c, digits).alias(n) for n, c in values.items()])


def _geo_sql(columns: dict[str, str], digits: int, ctes: str = _ECEF_SQL, source: str = "ecef") -> str:
    return f"WITH {ctes} SELECT {', '.join(_KEY)}, {', '.join(f'round({e}, {digits}) AS {n}' for n, e in columns.items())} FROM {source}"


@register("wgs_to_ecef", _geo_sql({"ox": "px", "oy": "py", "oz": "pz"}, 5))
def wgs_to_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ecef(spark, sf_dir), dict(zip(("ox", "oy", "oz"), _p(), strict=True)), 5)


@register("ecef_to_wgs", _geo_sql({"olon": "lon", "olat": "lat", "oalt": "alt"}, 5))
def ecef_to_wgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle is the place the position was made of: the conversion must return it."""
    rows = g.with_wgs(_ecef(spark, sf_dir), _p(), ("olon", "olat", "oalt"))
    return _rounded(rows, {n: F.col(n) for n in ("olon", "olat", "oalt")}, 5)


@register("ecef_to_eci_and_back", _geo_sql({"ex": "cos(gst) * px - sin(gst) * py", "ey": "sin(gst) * px + cos(gst) * py", "bx": "cos(gst) * px + sin(gst) * py", "vx": f"cos(gst) * (px / 1000) - sin(gst) * (py / 1000) - {g.EARTH_RATE!r}::DOUBLE * (sin(gst) * px + cos(gst) * py)"}, 5))
def ecef_to_eci(spark: SparkSession, sf_dir: str) -> DataFrame:
    gst, p = F.col("gst"), _p()
    e, b = g.ecef_to_eci(gst, p), g.eci_to_ecef(gst, p)
    v = g.velocity_to_eci(gst, p, tuple(c / 1000 for c in p))
    return _rounded(_ecef(spark, sf_dir), {"ex": e[0], "ey": e[1], "bx": b[0], "vx": v[0]}, 5)


_DOT, _CX, _CY, _CZ = "px * 3000 + py * 2000 + pz * 1000", "(py * 1000 - pz * 2000)", "(pz * 3000 - px * 1000)", "(px * 2000 - py * 3000)"
_CN = f"sqrt({_CX} * {_CX} + {_CY} * {_CY} + {_CZ} * {_CZ})"


@register("vector_math", _geo_sql({"angle": f"CASE WHEN {_DOT} <> 0 AND {_CN} <> 0 THEN atan2({_CN}, {_DOT}) ELSE 0 END", "cx": f"{_CX} / 1e6", "ux": "px / sqrt(px * px + py * py + pz * pz)"}, 7))
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tuple(F.lit(v) for v in (3000.0, 2000.0, 1000.0))
    return _rounded(_ecef(spark, sf_dir), {"angle": g.angle(_p(), o), "cx": g.cross(_p(), o)[0] / 1e6, "ux": g.unit(_p())[0]}, 7)


_C, _S = "cos(gst)", "sin(gst)"


@register("quaternion", _geo_sql({"rx": f"px * {_C} + (py * 0.8e0 - pz * -0.6e0) * 0 + (1 - {_C}) * 0 * px + {_S} * (-0.6e0 * pz - 0.8e0 * py)", "w": f"cos(gst / 2) * cos(gst / 3) - sin(gst / 2) * sin(gst / 3)"}, 5))
def quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation about the axis (0, -0.6, 0.8), for whose first component Rodrigues' formula is short."""
    zero = F.lit(0.0)
    r = g.rotate((zero, F.lit(-0.6), F.lit(0.8)), F.col("gst"), _p())
    gst = F.col("gst")
    product = g.quaternion_product((F.cos(gst / 2), F.sin(gst / 2), zero, zero), (F.cos(gst / 3), F.sin(gst / 3), zero, zero))
    return _rounded(_ecef(spark, sf_dir), {"rx": r[0], "w": product[0]}, 5)


_HIT_SQL = f"""{_ECEF_SQL}, ray AS (SELECT *, px * 1.1e0 AS qx, py * 1.1e0 AS qy, pz * 1.1e0 AS qz, -px / 6000 + (gst - 3) / 4 AS dx, -py / 6000 AS dy, -pz / 6000 AS dz FROM ecef),
abc AS (SELECT *, (dx * dx + dy * dy) / ({_A} * {_A}) + dz * dz / ({_B} * {_B}) AS a, (dx * qx + dy * qy) / ({_A} * {_A}) + dz * qz / ({_B} * {_B}) AS b, (qx * qx + qy * qy) / ({_A} * {_A}) + qz * qz / ({_B} * {_B}) - 1 AS c FROM ray),
hit AS (SELECT *, CASE WHEN b * b - a * c < 0 THEN NULL WHEN b > 0 THEN (-b + sqrt(greatest(b * b - a * c, 0))) / a ELSE (-b - sqrt(greatest(b * b - a * c, 0))) / a END AS t FROM abc)"""


@register("line_ellipsoid_intersection", _geo_sql({"hx": "qx + t * dx", "hz": "qz + t * dz"}, 4, _HIT_SQL, "hit"))
def line_ellipsoid_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _p()
    q, d = tuple(c * 1.1 for c in p), (-p[0] / 6000 + (F.col("gst") - 3) / 4, -p[1] / 6000, -p[2] / 6000)
    hit = g.intersect(q, d, (g.WGS84_A, g.WGS84_A, g.WGS84_B))
    return _rounded(_ecef(spark, sf_dir), {"hx": F.nanvl(hit[0], F.lit(None).cast("double")), "hz": F.nanvl(hit[2], F.lit(None).cast("double"))}, 4)


_VIEW_SQL = f"""{_ECEF_SQL}, v AS (SELECT *, -px * 0.1e0 - 300 AS vx, -py * 0.1e0 + 200 AS vy, -pz * 0.1e0 - 100 AS vz, sqrt(px * px + py * py) AS r FROM ecef),
top AS (SELECT *, cos(radians(lat)) * vz - sin(radians(lat)) * px / r * vx - sin(radians(lat)) * py / r * vy AS s, px / r * vy - py / r * vx AS e,
  cos(radians(lat)) * px / r * vx + cos(radians(lat)) * py / r * vy + sin(radians(lat)) * vz AS u FROM v),
az AS (SELECT *, atan(e / s) + CASE WHEN s > 0 THEN pi() WHEN s < 0 THEN 2 * pi() ELSE 0 END AS a FROM top)"""


@register("viewing_geometry", _geo_sql({"azimuth": f"a - floor(a / {_TWO_PI}) * {_TWO_PI}", "zenith": "pi() / 2 + asin(u / sqrt(vx * vx + vy * vy + vz * vz))"}, 6, _VIEW_SQL, "az"))
def viewing_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _p()
    satellite = (p[0] * 1.1 + 300, p[1] * 1.1 - 200, p[2] * 1.1 + 100)
    azimuth, zenith = g.viewing_geometry(p, satellite, F.col("vlat"))
    rows = g.with_wgs(_ecef(spark, sf_dir), p, ("vlon", "vlat", "valt"))
    return _rounded(rows, {"azimuth": azimuth, "zenith": zenith}, 6)


@register("acquisition_info", "SELECT o_orderkey, (o_orderkey % 5 + 1)::INTEGER AS number, [2, 1, 3, 0, 4][o_orderkey % 5 + 1]::INTEGER AS chronological, [2, 1, 3, 0, 4][o_orderkey % 5 + 1] % 2 = 1 AS backward FROM orders")
def acquisition_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.testdata import table

    number = (F.col("o_orderkey") % 5 + 1).cast("int")
    c = g.chronological_image(number)
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"), c.alias("chronological"), (c % 2 == 1).alias("backward"))


@register("line_times", "SELECT user_id, i::INTEGER AS line, round(centre - 374 * 0.0253995e0 / 2 + i * 0.0253995e0 + 0.0241899e0 / 2, 6) AS t FROM (SELECT user_id, avg(event_id % 1000)::DOUBLE AS centre FROM events GROUP BY user_id), range(374) r(i)")
def line_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the lines of an image about the middle of each user's events."""
    from ..model import mode_of
    from ..sources.testdata import table

    m = mode_of("1")
    centres = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.col("event_id") % 1000).alias("centre"))
    each = centres.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(m.rows - 1))))
    return each.select("user_id", "line", F.round(F.col("centre") - m.rows * m.time_per_line / 2 + F.col("line") * m.time_per_line + m.integration_time / 2, 6).alias("t"))


@register("row_flip", "SELECT (vec_id % 25)::INTEGER AS x, (max(vec_id // 25) OVER () - vec_id // 25)::INTEGER AS y, label FROM embeddings")
def row_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.testdata import cube

    pixels = cube(spark, sf_dir).pixels
    last = pixels.agg(F.max("y").alias("last"))  # one row
    return pixels.crossJoin(F.broadcast(last)).select("x", (F.col("last") - F.col("y")).alias("y"), "label")


# Nearest and spline lookups ---------------------------------------------------------------------------------

_GCPS = tuple((f"GCP{k:02d}", 3.0 + 7.3 * k % 22, 1.0 + 5.1 * k % 18, 0.1 * k) for k in range(1, 11))
_GCP_SQL = "gcp AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x!r}::DOUBLE, {y!r}::DOUBLE, {a!r}::DOUBLE)" for n, x, y, a in _GCPS) + ") v(name, gx, gy, alt))"
_PIX_SQL = "pix AS (SELECT vec_id, (vec_id % 25)::INTEGER AS x, (vec_id // 25)::INTEGER AS y FROM embeddings)"


def _gcps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_GCPS), "name string, gx double, gy double, alt double")


def _pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.testdata import cube

    return cube(spark, sf_dir).pixels.select("vec_id", "x", "y")


@register("join_gcp_pixel", f"WITH {_GCP_SQL}, {_PIX_SQL} SELECT name, vec_id FROM gcp JOIN pix ON x = trunc(gx)::INTEGER AND y = trunc(gy)::INTEGER")
def join_gcp_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _gcps(spark).select("name", F.col("gx").cast("int").alias("x"), F.col("gy").cast("int").alias("y"))
    return _pix(spark, sf_dir).join(F.broadcast(at), ["x", "y"]).select("name", "vec_id")


@register("join_nearest_gcp", f"WITH {_GCP_SQL}, {_PIX_SQL} SELECT vec_id, arg_min(name, (power(gx - x, 2) + power(gy - y, 2), name)) AS name FROM pix, gcp GROUP BY vec_id")
def join_nearest_gcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most some tens of control points: they enter the expression of each pixel as one literal array."""
    rows = [F.struct(F.lit(n).alias("name"), F.lit(x).alias("gx"), F.lit(y).alias("gy")) for n, x, y, _ in _GCPS]
    near = F.array_min(F.transform(F.array(*rows), lambda c: F.struct(((c["gx"] - F.col("x")) * (c["gx"] - F.col("x")) + (c["gy"] - F.col("y")) * (c["gy"] - F.col("y"))).alias("d"), c["name"].alias("name"))))
    return _pix(spark, sf_dir).select("vec_id", near["name"].alias("name"))


_TRACK_SQL = f"{TELEMETRY_SQL}, line AS (SELECT event_id AS line, signal AS lx, signal * 0.3e0 AS ly FROM telemetry)"


@register("join_nearest_line", f"WITH {_TRACK_SQL}, {_GCP_SQL} SELECT name, arg_min(line, (power(lx - gx, 2) + power(ly - gy, 2), line)) AS line FROM gcp, line GROUP BY name")
def join_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = telemetry(spark, sf_dir).select(F.col("event_id").alias("line"), F.col("signal").alias("lx"), (F.col("signal") * 0.3).alias("ly"))
    d = (F.col("lx") - F.col("gx")) * (F.col("lx") - F.col("gx")) + (F.col("ly") - F.col("gy")) * (F.col("ly") - F.col("gy"))
    pairs = lines.join(F.broadcast(_gcps(spark)), F.lit(True))  # ten control points
    return pairs.groupBy("name").agg(F.min_by("line", F.struct(d, "line")).alias("line"))


def _spline_sql(knots: int) -> str:
    """The spline through the events' mean values of each part of the identifiers, 6 apart: knots, second derivatives by
    elimination down (c, d) and substitution up (m), and the segments."""
    return f"""knots AS (SELECT event_id % {knots} AS k, (event_id % {knots}) * 6.0e0 AS x, avg(value) AS y FROM events GROUP BY 1, 2),
rows AS (SELECT k, x, y, lead(y) OVER w AS y1, lag(y) OVER w AS y0 FROM knots WINDOW w AS (ORDER BY k)),
down AS (SELECT 1::BIGINT AS k, 0.25e0 AS c, (6 * (y1 - 2 * y + y0) / 36) / 4 AS d FROM rows WHERE k = 1
  UNION ALL SELECT r.k, 1 / (4 - s.c), (6 * (r.y1 - 2 * r.y + r.y0) / 36 - s.d) / (4 - s.c) FROM down s JOIN rows r ON r.k = s.k + 1 WHERE r.k < {knots - 1}),
up AS (SELECT {knots - 2}::BIGINT AS k, d AS m FROM down WHERE k = {knots - 2} UNION ALL SELECT s.k, s.d - s.c * u.m FROM up u JOIN down s ON s.k = u.k - 1),
bent AS (SELECT k, x, y, coalesce(m, 0) AS m FROM knots LEFT JOIN up USING (k)),
seg AS (SELECT x AS knot, y AS a, (y1 - y) / 6 - 6 * (2 * m + m1) / 6 AS b, m / 2 AS c, (m1 - m) / 36 AS d FROM (SELECT *, lead(y) OVER (ORDER BY k) AS y1, lead(m) OVER (ORDER BY k) AS m1 FROM bent) WHERE y1 IS NOT NULL)"""


_SPLINE_SQL = _spline_sql(20)
_LAST_KNOT = 114.0


def _segments(spark: SparkSession, sf_dir: str, knots: int = 20) -> DataFrame:
    from ..sources.testdata import table

    means = table(spark, sf_dir, "events").groupBy((F.col("event_id") % knots).alias("k")).agg(F.avg("value").alias("y")).orderBy("k").collect()  # a row a knot
    made = lookups.natural_spline([6.0 * r["k"] for r in means], [r["y"] for r in means])
    return spark.createDataFrame(made, "knot double, a double, b double, c double, d double")


@register("natural_spline", f"WITH RECURSIVE {_SPLINE_SQL} SELECT knot, round(a, 7) AS a, round(b, 7) AS b, round(c, 7) AS c, round(d, 7) AS d FROM seg")
def natural_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("knot", *[F.round(n, 7).alias(n) for n in "abcd"])


_AT_SPLINE = f"WITH RECURSIVE {TELEMETRY_SQL}, {_SPLINE_SQL}, at AS (SELECT event_id, signal, s.*, q - knot AS h FROM (SELECT event_id, signal, signal % 120 AS q FROM telemetry) ASOF JOIN seg s ON q >= knot WHERE q <= {_LAST_KNOT!r})"


#: Knots of the spline that covers all of the signals' range, 0 to 120.
_KNOTS = 21


@register(
    "join_spline_segment",
    f"WITH RECURSIVE {TELEMETRY_SQL}, {_spline_sql(_KNOTS)}, met AS (SELECT event_id, s.*, q - knot AS h FROM (SELECT event_id, (signal % 120 + 120) % 120 AS q FROM telemetry) ASOF JOIN seg s ON q >= knot) "
    "SELECT event_id, knot, round(h, 9) AS h, round(a + h * (b + h * (c + h * d)), 6) AS v FROM met",
)
def join_spline_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that each event's signal falls into, its distance from the knot, and the spline's value there."""
    segments = _segments(spark, sf_dir, _KNOTS).select("knot", F.struct("knot", *"abcd").alias("s"))
    rows = telemetry(spark, sf_dir).withColumn("q", F.pmod(F.col("signal"), F.lit(120.0)))
    met = lookups.as_of(rows, F.col("q"), segments, "knot", "s").withColumn("h", F.col("q") - F.col("s.knot"))
    v = F.col("s.a") + F.col("h") * (F.col("s.b") + F.col("h") * (F.col("s.c") + F.col("h") * F.col("s.d")))
    return met.select("event_id", F.col("s.knot").alias("knot"), F.round("h", 9).alias("h"), F.round(v, 6).alias("v"))


@register("trajectory_interpolation", f"{_AT_SPLINE} SELECT event_id, round(a + h * (b + h * (c + h * d)), 6) AS v FROM at".replace(" at AS", " met AS").replace("FROM at", "FROM met"))
def trajectory_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir)
    out = lookups.spline_values(rows, F.pmod(F.col("signal"), F.lit(120.0)), _segments(spark, sf_dir), _LAST_KNOT, "v")
    return out.select("event_id", F.round("v", 6).alias("v"))


_NODES = [0.3, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]


@register("join_lut_interp", f"WITH {TELEMETRY_SQL}, node AS (SELECT lo, hi, tv, lead(tv) OVER (ORDER BY lo) AS nv FROM (SELECT v AS lo, lead(v) OVER (ORDER BY v) AS hi, v * v AS tv FROM (SELECT unnest({_NODES})::DOUBLE AS v))), q AS (SELECT event_id, 0.3e0 + abs(signal) % 4.7e0 AS w FROM telemetry) SELECT event_id, round(tv + ln(w / lo) / ln(hi / lo) * (nv - tv), 7) AS v FROM q JOIN node ON w >= lo AND w < hi")
def join_lut_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = 0.3 + F.abs("signal") % 4.7
    i, f = lookups.bracket(w, _NODES, log=True)
    values = F.array(*[F.lit(n * n) for n in _NODES])
    lo, hi = F.get(values, i), F.get(values, i + 1)
    return telemetry(spark, sf_dir).select("event_id", F.round(lo + f * (hi - lo), 7).alias("v"))
