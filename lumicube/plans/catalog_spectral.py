"""Queries: reflectances, features and the scalar functions of radiometry."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import radiometry as r
from ..operators import reflectance as ops
from ..operators.bands import bands_frame, categorized, valid_pixels
from ..operators.smoothing import tricube
from ..registry import register
from ..sources.testdata import BANDS, BANDS_SQL, CUBE_SQL, LONG_SQL, PRODUCT_BANDS_SQL, cube, product_bands, table

#: The features need bands narrow enough to stand strictly inside the intervals.
FEATURE_BANDS = tuple(dataclasses.replace(b, bandwidth=8.0) for b in BANDS)
_PI = f"{math.pi!r}::DOUBLE"
_DAY = "(1 / power(1 - 0.01673e0 * cos(radians((162 - 4) * 0.9856e0)), 2))"
_FACTORS_SQL = f"""{BANDS_SQL},
solar AS (SELECT i + 200.0::DOUBLE AS x, 8.6e18 / power(i + 200.0::DOUBLE, 5) / (exp(2492.7e0 / (i + 200.0::DOUBLE)) - 1) AS y FROM range(2201) t(i)),
near AS (SELECT band, y, 1 / power(1 + abs(2 * (x - wl) / bw), 4) AS w FROM solar JOIN bands ON x - wl > -bw AND x - wl <= bw),
irradiance AS (SELECT band, sum(w * y) / sum(w) AS average FROM near GROUP BY band),
factors AS (SELECT band, {_PI} / (cos(radians(35e0)) * 1000 * average * {_DAY}) AS factor FROM irradiance)"""
#: The same for the bands of all products.
_MANY_SQL = _FACTORS_SQL.replace(BANDS_SQL, PRODUCT_BANDS_SQL)
_TOA_SQL = f"{LONG_SQL}, {_FACTORS_SQL}, toa AS (SELECT x, y, band, mask, trunc(value * factor / 1e-4 + 0.5e0)::INTEGER AS refl FROM long JOIN factors USING (band))"


def toa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.toa_reflectances(cube(spark, sf_dir), ops.solar_stand_in(spark), bands_frame(spark, BANDS))


@register(
    "compute_toa_reflectances",
    f"WITH {_TOA_SQL}, good AS (SELECT x, y FROM toa GROUP BY x, y HAVING max(mask & 3) = 0) SELECT band, count(*) AS n, round(avg(refl * 1e-4), 9) AS mean_reflectance FROM toa JOIN good USING (x, y) GROUP BY band",
)
def compute_toa_reflectances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reflectance per band of the pixels without faults."""
    rows = toa(spark, sf_dir).filter(valid_pixels()).select(F.posexplode("toa_refl").alias("pos", "refl"))
    return rows.groupBy((F.col("pos") + 1).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("refl") * 1e-4), 9).alias("mean_reflectance"))


@register("solar_irradiance_correction", "SELECT o_orderkey, round(1 / power(1 - 0.01673e0 * cos(radians((dayofyear(o_orderdate) - 4) * 0.9856e0)), 2), 9) AS factor FROM orders")
def solar_irradiance_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(r.solar_irradiance_correction(F.dayofyear("o_orderdate")), 9).alias("factor"))


@register("toa_factor", f"WITH {_MANY_SQL} SELECT band, round(factor * 1e6, 6) AS factor FROM factors")
def toa_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = ops.band_averages(ops.solar_stand_in(spark), product_bands(spark, sf_dir))
    return ops.toa_factors(averages, 35.0, 162).select("band", F.round(F.col("factor") * 1e6, 6).alias("factor"))


@register("weighted_band_average", f"WITH {_MANY_SQL} SELECT band, round(average, 6) AS average FROM irradiance")
def weighted_band_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.band_averages(ops.solar_stand_in(spark), product_bands(spark, sf_dir)).select("band", F.round("average", 6).alias("average"))


@register("bell_weight", f"WITH {_MANY_SQL} SELECT band, count(*) AS n, round(sum(w), 9) AS total FROM near GROUP BY band")
def bell_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.col("x") - F.col("wavelength")
    near = ops.solar_stand_in(spark).join(F.broadcast(product_bands(spark, sf_dir)), (delta > -F.col("bandwidth")) & (delta <= F.col("bandwidth")))
    return near.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum(r.bell_weight(delta, F.col("bandwidth"))), 9).alias("total"))


_RESAMPLE_SQL = f"""{PRODUCT_BANDS_SQL}, shaped AS (SELECT *, 6.0e0 - 4.0e0 * (band % 1000 - 1) / 63 AS e FROM bands),
solar AS (SELECT i + 200.0::DOUBLE AS x, 8.6e18 / power(i + 200.0::DOUBLE, 5) / (exp(2492.7e0 / (i + 200.0::DOUBLE)) - 1) AS y FROM range(2201) t(i)),
weights AS (SELECT band, x, y, exp(-power(abs(x - wl) / (bw * power(1 / (power(2e0, e) * ln(2e0)), 1 / e)), e)) AS w FROM solar JOIN shaped ON abs(x - wl) <= 2 * bw),
normed AS (SELECT band, x, y, w / sum(w) OVER (PARTITION BY band) AS w FROM weights)"""


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = product_bands(spark, sf_dir).drop("n").withColumn("e", 6.0 - 4.0 * (F.col("band") % 1000 - 1) / 63)
    delta = F.abs(F.col("x") - F.col("wavelength"))
    near = ops.solar_stand_in(spark).join(F.broadcast(bands), delta <= 2 * F.col("bandwidth"))
    from pyspark.sql import Window

    near = near.withColumn("raw", r.resample_weight(delta, F.col("bandwidth"), F.col("e")))
    return near.withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy("band")))


@register("resample_weight", f"WITH {_RESAMPLE_SQL} SELECT band, x, round(w, 9) AS weight FROM normed")
def resample_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir).select("band", "x", F.round("w", 9).alias("weight"))


@register("join_resample", f"WITH {_RESAMPLE_SQL} SELECT band, count(*) AS n, round(sum(w * y), 6) AS value FROM normed GROUP BY band")
def join_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("y")), 6).alias("value"))


# Features ---------------------------------------------------------------------------------------------------

_GROUP_SQL = {g: "(" + ", ".join(str(b.index) for b in of) + ")" for g, of in categorized(FEATURE_BANDS).items()}
_WV, _O2 = ops.Interpolator(FEATURE_BANDS, ops.WATER_VAPOUR), ops.Interpolator(FEATURE_BANDS, ops.OXYGEN)


def _group_sql(g: str) -> str:
    ids = _GROUP_SQL[g]
    return f"""l_{g} AS (SELECT x, y, band, refl * 1e-4 AS v, 400.0e0 + 10 * (band - 1) AS wl FROM toa WHERE band IN {ids}),
d_{g} AS (SELECT *, lag(v) OVER w AS v0, lag(wl) OVER w AS wl0 FROM l_{g} WINDOW w AS (PARTITION BY x, y ORDER BY band)),
b_{g} AS (SELECT x, y, sum(0.5e0 * (v + v0) * (wl - wl0)) / (max(wl) - min(wl)) AS b FROM d_{g} GROUP BY x, y),
f_{g} AS (SELECT x, y, any_value(b) AS brightness, sum(CASE WHEN v0 IS NULL THEN 0 WHEN (v0 - b) * (v - b) >= 0 THEN 0.5e0 * (abs(v0 - b) + abs(v - b)) * (wl - wl0)
  ELSE 0.5e0 * (power(v0 - b, 2) + power(v - b, 2)) / abs(v0 - v) * (wl - wl0) END) / (max(wl) - min(wl)) AS whiteness FROM d_{g} JOIN b_{g} USING (x, y) GROUP BY x, y)"""


def _interp_sql(at: ops.Interpolator) -> str:
    mean = lambda of: "(" + " + ".join(f"refls[{b.index}]" for b in of) + f") / {len(of)}.0e0"
    return f"((1 - {at.weight!r}::DOUBLE) * ({mean(at.inf)}) + {at.weight!r}::DOUBLE * ({mean(at.sup)}))"


_MU = r.air_mass(35.0, 20.0)
_ATMOSPHERE_SQL = f"""trans AS (SELECT 600 + i * 0.5e0 AS x, 1 - 0.6e0 * exp(-power((600 + i * 0.5e0 - 760.6e0) / 6, 2)) - 0.4e0 * exp(-power((600 + i * 0.5e0 - 944.4e0) / 20, 2)) AS y FROM range(1201) t(i)),
tr AS (SELECT k, sum(y / power(1 + abs(2 * (x - k) / 8), 4)) / sum(1 / power(1 + abs(2 * (x - k) / 8), 4)) AS t FROM trans, (VALUES ({_O2.inner.wavelength}e0), ({_WV.inner.wavelength}e0)) v(k) WHERE x - k > -8 AND x - k <= 8 GROUP BY k),
refls AS (SELECT x, y, list(refl ORDER BY band) AS refls FROM toa GROUP BY x, y),
paths AS (SELECT x, y, {_MU!r}::DOUBLE / ln((SELECT t FROM tr WHERE k = {_O2.inner.wavelength})) * ln(refls[{_O2.inner.index}] / {_interp_sql(_O2)}) AS o2,
  {_MU!r}::DOUBLE / ln((SELECT t FROM tr WHERE k = {_WV.inner.wavelength})) * ln(refls[{_WV.inner.index}] / {_interp_sql(_WV)}) AS wv FROM refls)"""
FEATURES_SQL = f"{_TOA_SQL}, {', '.join(_group_sql(g) for g in ('all', 'vis', 'nir'))}, {_ATMOSPHERE_SQL}"


def transmittances(spark: SparkSession) -> dict[int, float]:
    rows = ops.band_averages(ops.transmittance_stand_in(spark), bands_frame(spark, [_O2.inner, _WV.inner])).collect()
    return {x["band"]: x["average"] for x in rows}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's eight features beside its reflectances."""
    paths = ops.atmospheric_features("toa_refl", FEATURE_BANDS, transmittances(spark), 35.0, 20.0)
    return ops.with_surface_features(toa(spark, sf_dir), "toa_refl", FEATURE_BANDS).withColumns(paths)


@register("brightness", f"WITH {_TOA_SQL}, {_group_sql('all')} SELECT x, y, round(brightness, 9) AS brightness FROM f_all")
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_surface_features(toa(spark, sf_dir), "toa_refl", FEATURE_BANDS).select("x", "y", F.round("brightness", 9).alias("brightness"))


@register("whiteness", f"WITH {_TOA_SQL}, {_group_sql('vis')} SELECT x, y, round(whiteness, 9) AS whiteness FROM f_vis")
def whiteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_surface_features(toa(spark, sf_dir), "toa_refl", FEATURE_BANDS).select("x", "y", F.round("whiteness_vis", 9).alias("whiteness"))


@register("band_interpolation", f"WITH {_TOA_SQL}, refls AS (SELECT x, y, list(refl ORDER BY band) AS refls FROM toa GROUP BY x, y) SELECT x, y, round({_interp_sql(_WV)}, 6) AS wv, round({_interp_sql(_O2)}, 6) AS o2 FROM refls")
def band_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toa(spark, sf_dir).select("x", "y", F.round(_WV.value("toa_refl"), 6).alias("wv"), F.round(_O2.value("toa_refl"), 6).alias("o2"))


@register("optical_path", f"WITH {_TOA_SQL}, {_ATMOSPHERE_SQL} SELECT x, y, round(o2, 8) AS o2, round(wv, 8) AS wv FROM paths")
def optical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ops.atmospheric_features("toa_refl", FEATURE_BANDS, transmittances(spark), 35.0, 20.0)
    return toa(spark, sf_dir).select("x", "y", *[F.round(c, 8).alias(n) for n, c in cols.items()])


_EIGHT = [f"f_{g}.{k} AS {k}{s}" for g, s in (("all", ""), ("vis", "_vis"), ("nir", "_nir")) for k in ("brightness", "whiteness")]
FEATURE_NAMES = ["brightness", "whiteness", "brightness_vis", "whiteness_vis", "brightness_nir", "whiteness_nir", "o2", "wv"]


@register(
    "extract_features",
    f"WITH {FEATURES_SQL} SELECT x, y, {', '.join(f'round({n}, 8) AS {n}' for n in FEATURE_NAMES)} FROM (SELECT f_all.x, f_all.y, {', '.join(_EIGHT)}, o2, wv FROM f_all JOIN f_vis USING (x, y) JOIN f_nir USING (x, y) JOIN paths USING (x, y))",
)
def extract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("x", "y", *[F.round(n, 8).alias(n) for n in FEATURE_NAMES])


# Scalar functions on the large tables -----------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(name).cast("double")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_REF, _LPW, _EGL, _SAB = "(l_discount + 0.05e0)", "(l_tax * 10)", "(l_quantity + 100)", "(0.1e0 + l_tax)"
_INV = f"({_PI} * (l_extendedprice * 1e-3 - {_LPW}) / {_EGL})"
_AZ = "abs(l_quantity * 7.3e0 - l_extendedprice % 360)"
_X = "(l_discount * 10 - 0.5e0)"


def _scalar_columns() -> dict[str, dict[str, Column]]:
    """Column functions of the line items, by query; built when a query runs, as columns need a session."""
    q, p, d, t = _c("l_quantity"), _c("l_extendedprice"), _c("l_discount"), _c("l_tax")
    lpw, egl, sab = t * 10, q + 100, t + 0.1
    return {
        "azimuthal_difference": {"difference": r.azimuthal_difference(q * 7.3, p % 360.0)},
        "lambert_inverse": {"reflectance": r.lambert_inverse(p, 1e-3, lpw, egl, sab)},
        "lambert_forward": {"radiance": r.lambert_forward(d + 0.05, 1e-3, lpw, egl, sab)},
        "adjacency_term": {"term": r.adjacency_term(d, t, q / 50)},
        "global_flux": {"flux": r.global_flux(q, d, t * 500)},
        "ndvi": {"ndvi": r.ndvi(q, d * 100)},
        "pow2_to_pow9": {f"pow{n}": r.int_power(d + 1, n) for n in range(2, 10)},
        "legendre": {f"p{k}": c for k, c in enumerate(r.legendre(d * 10 - 0.5, 4))},
        "frac_index_log_and_linear": {"linear": _frac_index(q / 12, _NODES, False), "log": _frac_index(q / 12, _NODES, True)},
    }


def _scalar_sql() -> dict[str, tuple[int, dict[str, str]]]:
    """Digits and DuckDB expressions of the same."""
    forms = ["1.0e0", _X, f"(3 * {_X}**2 - 1) / 2", f"(5 * {_X}**3 - 3 * {_X}) / 2", f"(35 * {_X}**4 - 30 * {_X}**2 + 3) / 8"]
    held = "least(greatest(l_quantity / 12, 0.3e0), 5e0)"
    return {
        "azimuthal_difference": (6, {"difference": f"CASE WHEN {_AZ} > 180 THEN 360 - {_AZ} ELSE {_AZ} END"}),
        "lambert_inverse": (8, {"reflectance": f"{_INV} / (1 + {_INV} * {_SAB})"}),
        "lambert_forward": (5, {"radiance": f"({_LPW} + {_REF} * {_EGL} / ({_PI} * (1 - {_SAB} * {_REF}))) / 1e-3"}),
        "adjacency_term": (8, {"term": "(l_discount - l_tax) * (l_quantity / 50)"}),
        "global_flux": (8, {"flux": "l_quantity * cos(radians(l_tax * 500)) + l_discount"}),
        "ndvi": (8, {"ndvi": "(l_quantity - l_discount * 100) / nullif(l_quantity + l_discount * 100, 0)"}),
        "pow2_to_pow9": (8, {f"pow{n}": f"power(l_discount + 1, {n})" for n in range(2, 10)}),
        "legendre": (8, {f"p{k}": f for k, f in enumerate(forms)}),
        "frac_index_log_and_linear": (8, {"linear": _frac_sql(held, _NODES), "log": _frac_sql(f"ln({held})", [math.log(v) for v in _NODES])}),
    }


#: Stand-in nodes of the water vapour axis; only their number and ends are known.
_NODES = [0.3, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]


def _frac_index(v: Column, nodes: list[float], logs: bool) -> Column:
    """Node index plus fraction; the fraction is held in [0, 1], so that values off the axis stay at its ends."""
    v = F.least(F.greatest(v, F.lit(nodes[0])), F.lit(nodes[-1]))
    at = [math.log(n) if logs else n for n in nodes]
    v = F.ln(v) if logs else v
    out = F.lit(len(at) - 2) + (v - at[-2]) / (at[-1] - at[-2])
    for i in range(len(at) - 3, -1, -1):
        out = F.when(v < at[i + 1], i + (v - at[i]) / (at[i + 1] - at[i])).otherwise(out)
    return out


def _frac_sql(v: str, at: list[float]) -> str:
    cases = " ".join(f"WHEN {v} < {at[i + 1]!r}::DOUBLE THEN {i} + ({v} - ({at[i]!r}::DOUBLE)) / {at[i + 1] - at[i]!r}::DOUBLE" for i in range(len(at) - 2))
    return f"(CASE {cases} ELSE {len(at) - 2} + ({v} - ({at[-2]!r}::DOUBLE)) / {at[-1] - at[-2]!r}::DOUBLE END)"


def _register_scalar(name: str, digits: int, sqls: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").select(*_LINE, *[F.round(c, digits).alias(n) for n, c in _scalar_columns()[name].items()])

    register(name, f"SELECT {', '.join(_LINE)}, {', '.join(f'round({e}, {digits}) AS {n}' for n, e in sqls.items())} FROM lineitem")(run)


for _name, (_digits, _sqls) in _scalar_sql().items():
    _register_scalar(_name, _digits, _sqls)


@register("tricube_weight", "SELECT event_id, round(power(1 - power(abs(i - j)::DOUBLE / greatest(i, 26 - i), 3), 1.5e0), 9) AS w FROM (SELECT event_id, event_id % 27 AS i, event_id // 27 % 27 AS j FROM events)")
def tricube_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each event's place in the window about another place."""
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in tricube(27, i)]) for i in range(27)])
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.get(F.get(weights, (n % 27).cast("int")), (F.floor(n / 27) % 27).cast("int")), 9).alias("w"))


_RESIDUAL_SQL = "SELECT user_id, event_id, abs(value - avg(value) OVER (PARTITION BY user_id)) AS a FROM events"


@register("bisquare_weight", f"WITH r AS ({_RESIDUAL_SQL}), m AS (SELECT user_id, 6 * list_sort(list(a))[count(*) // 2 + 1] AS mad FROM r GROUP BY user_id) SELECT event_id, round(CASE WHEN mad > 0 THEN CASE WHEN a < mad THEN 1 - power(a / mad, 2) ELSE 0 END ELSE 1 END, 8) AS w FROM r JOIN m USING (user_id)")
def bisquare_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumn("a", F.abs(F.col("value") - F.avg("value").over(own)))
    rank = rows.withColumns({"k": F.row_number().over(own.orderBy("a")) - 1, "n": F.count("*").over(own)})
    rows = rank.withColumn("mad", 6 * F.max(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("a"))).over(own))
    w = F.when(F.col("mad") > 0, F.when(F.col("a") < F.col("mad"), 1 - F.pow(F.col("a") / F.col("mad"), F.lit(2))).otherwise(0.0)).otherwise(1.0)
    return rows.select("event_id", F.round(w, 8).alias("w"))


@register("log_density_diag", f"WITH {CUBE_SQL} SELECT x, y, round(-0.5e0 * (3 * ln(2 * {_PI}) + ln(1e6 * 4e6 * 9e6)) - 0.5e0 * (power(radiance[1] - 10000, 2) / 1e6 + power(radiance[2] - 10100, 2) / 4e6 + power(radiance[3] - 9900, 2) / 9e6), 8) AS d FROM cube")
def log_density_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.transform(F.slice("radiance", 1, 3), lambda v: v.cast("double"))
    mean, variance = F.array(*map(F.lit, (10000.0, 10100.0, 9900.0))), F.array(*map(F.lit, (1e6, 4e6, 9e6)))
    return cube(spark, sf_dir).pixels.select("x", "y", F.round(r.log_density(three, mean, variance), 8).alias("d"))


