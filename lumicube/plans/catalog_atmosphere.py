"""Queries: atmospheric correction and unmixing on the test cube, with stand-in tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import numerics
from ..operators import atmosphere as ops, correction
from ..operators.bands import nearest_index, valid_pixels
from ..params import AtmosphereParams
from ..registry import register
from ..sources.testdata import BANDS, CUBE_SQL, LONG_SQL, cube, cube_long
from .sql import det

#: Radiances of the cube (some 10000) times this are like those of the stand-in tables.
SCALE = 1.0e-3
AOT, CWV, SZA = 0.2, 1.2, 35.0
_PI = f"{np.pi!r}::DOUBLE"


def _table() -> ops.Rtc:
    lut = ops.stand_in_lut()
    return lut.at(AOT, CWV, SZA).resampled(ops.resampling_weights(lut.wavelengths, BANDS))


_T = _table()
#: The stand-in tables at AOT, CWV (linear in its logarithm between the nodes 1 and 1.5) and SZA, resampled to the bands,
#: from their formulas: nothing here comes from the plan's own numbers.
_COEF_SQL = f"""wl AS (SELECT 390.0e0 + i AS wl FROM range(661) t(i)),
gas AS (SELECT wl, exp(-power((wl - 940) / 25, 2)) AS line, 1 - 0.5e0 * exp(-power((wl - 760.5e0) / 3, 2)) AS oxygen, ln({CWV}e0) / ln(1.5e0) AS f FROM wl),
trans AS (SELECT wl, ((1 - f) * exp(-0.25e0 * 1.0e0 * line) + f * exp(-0.25e0 * 1.5e0 * line)) * oxygen AS t FROM gas),
rtc AS (SELECT wl, (0.3e0 + 1.2e0 * {AOT}e0) * power(wl / 500, -2.5e0) AS lpw,
  t * (120.0e0 * power(wl / 500, -1.2e0) * exp(-0.8e0 * {AOT}e0) * cos(radians({SZA}e0)) + 25.0e0 * power(wl / 500, -2.0e0) * (0.4e0 + {AOT}e0)) AS egl,
  (0.05e0 + 0.1e0 * {AOT}e0) * power(wl / 500, -1.0e0) AS sab, 0.1e0 + 0.5e0 * {AOT}e0 * power(wl / 500, -0.5e0) AS rat FROM trans),
bell AS (SELECT b::INTEGER AS band, 400.0e0 + 10 * (b - 1) AS centre, 6.0e0 - 4.0e0 * (b - 1) / 63 AS e FROM range(1, 65) t(b)),
weights AS (SELECT band, wl, exp(-power(abs(centre - wl) / (10 * power(1 / (power(2.0e0, e) * ln(2.0e0)), 1 / e)), e)) AS w FROM bell, wl WHERE abs(centre - wl) <= 20),
by_band AS (SELECT band, {', '.join(f'sum(w * {n}) / sum(w) AS {n}' for n in ('lpw', 'egl', 'sab', 'rat'))} FROM weights JOIN rtc USING (wl) GROUP BY band),
coef AS (SELECT {', '.join(f'list({n} ORDER BY band) AS {n}' for n in ('lpw', 'egl', 'sab', 'rat'))} FROM by_band)"""
_RHO_SQL = f"{LONG_SQL}, {_COEF_SQL}, a AS (SELECT x, y, band, value, {_PI} * (value * 1e-3 - lpw[band]) / egl[band] AS a, sab[band] AS sab FROM long, coef), rho AS (SELECT x, y, band, value, a / (1 + a * sab) AS rho FROM a)"


@register("compute_surface_reflectances", f"WITH {_RHO_SQL}, fixed AS (SELECT x, y, band, CASE WHEN band = 37 THEN (lag(rho) OVER w + lead(rho) OVER w) / 2 ELSE rho END AS rho FROM rho WINDOW w AS (PARTITION BY x, y ORDER BY band)) SELECT band, round(avg(rho), 8) AS mean, round(min(rho), 8) AS least, round(max(rho), 8) AS most FROM fixed GROUP BY band")
def compute_surface_reflectances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inversion of every pixel and band with the oxygen band interpolated (modes without a water-vapour retrieval)."""
    rows = cube(spark, sf_dir).pixels.select("x", "y", ops.invert("radiance", SCALE, _T).alias("rho"))
    rows = rows.withColumn("rho", ops.interpolate_oxygen("rho", BANDS)).select(F.posexplode("rho").alias("pos", "rho"))
    return rows.groupBy((F.col("pos") + 1).alias("band")).agg(F.round(F.avg("rho"), 8).alias("mean"), F.round(F.min("rho"), 8).alias("least"), F.round(F.max("rho"), 8).alias("most"))


@register("o2_interpolation", f"WITH {_RHO_SQL} SELECT x, y, round((rho0 + rho2) / 2, 8) AS rho FROM (SELECT *, lag(rho) OVER w AS rho0, lead(rho) OVER w AS rho2 FROM rho WINDOW w AS (PARTITION BY x, y ORDER BY band)) WHERE band = 37")
def o2_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube(spark, sf_dir).pixels.select("x", "y", ops.invert("radiance", SCALE, _T).alias("rho"))
    return rows.select("x", "y", F.round(F.element_at(ops.interpolate_oxygen("rho", BANDS), nearest_index(BANDS, 760.0)), 8).alias("rho"))


@register("forward_inverse_round_trip", f"WITH {LONG_SQL} SELECT band, sum(value)::BIGINT AS total FROM long GROUP BY band")
def forward_inverse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube(spark, sf_dir).pixels.select(ops.invert("radiance", SCALE, _T).alias("rho"))
    rows = rows.select(ops.forward("rho", SCALE, _T).alias("back")).select(F.posexplode("back").alias("pos", "v"))
    return rows.groupBy((F.col("pos") + 1).alias("band")).agg(F.sum(F.round("v").cast("long")).alias("total"))


@register("calculator_factory", f"WITH {LONG_SQL}, {_COEF_SQL} SELECT band, round(lpw, 8) AS lpw, round(egl, 6) AS egl, count(*) AS n, round(avg(value * {SCALE}e0 - lpw) / any_value(egl), 9) AS excess FROM by_band JOIN long USING (band) GROUP BY band, lpw, egl")
def calculator_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled table, and by how much the scene's mean radiance exceeds the path radiance, in parts of the flux."""
    rows = [(k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(_T.lpw, _T.egl, strict=True))]
    coefficients = spark.createDataFrame(rows, "band int, lpw double, egl double")  # a row a band
    met = cube_long(spark, sf_dir).join(F.broadcast(coefficients), "band").groupBy("band", "lpw", "egl").agg(F.count("*").alias("n"), F.avg(F.col("value") * SCALE - F.col("lpw")).alias("e"))
    return met.select("band", F.round("lpw", 8).alias("lpw"), F.round("egl", 6).alias("egl"), "n", F.round(F.col("e") / F.col("egl"), 9).alias("excess"))


@register(
    "lpw_correction",
    f"WITH {LONG_SQL}, {_COEF_SQL}, dark AS (SELECT band, value, row_number() OVER (PARTITION BY band ORDER BY value, y, x) AS rank FROM long WHERE value > 0) "
    f"SELECT band, round(greatest(0, any_value(lpw) * 9 - avg(value) * {SCALE}e0), 8) AS correction FROM dark JOIN by_band USING (band) WHERE rank <= {correction.DARK} GROUP BY band",
)
def lpw_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to take off a path radiance that is nine times too large, by the scene's dark pixels, in an oblique view."""
    from ..operators.statistics import smallest

    dark = smallest(cube_long(spark, sf_dir), ["band"], "value", correction.DARK, ["y", "x"]).groupBy("band").agg((F.avg("value") * SCALE).alias("mean"))
    means = {r["band"]: r["mean"] for r in dark.collect()}  # a number a band
    bands = sorted(means)
    out = ops.path_radiance_correction(0.05, 0.05, 55.0, [9 * float(_T.lpw[b - 1]) for b in bands], [means[b] for b in bands])
    return spark.createDataFrame(list(zip(bands, out, strict=True)), "band int, correction double").withColumn("correction", F.round("correction", 8))


def _endmembers() -> np.ndarray:
    wl = np.array([b.wavelength for b in BANDS])
    vegetation = 0.05 + 0.4 / (1 + np.exp(-(wl - 715) / 15))
    soil = 0.05 + 0.35 * (wl - 400) / 630
    return np.stack((np.ones_like(wl), vegetation, soil), axis=1)


@register("wv_retrieval")
def wv_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radiances simulated with a known water vapour for each pixel; the retrieval must return it (see the tests)."""
    lut = ops.stand_in_lut()
    weights = ops.resampling_weights(lut.wavelengths, BANDS)
    tables = [lut.at(AOT, w, SZA).resampled(weights) for w in lut.cwv]
    rho = 0.2 + 0.0002 * (np.array([b.wavelength for b in BANDS]) - 400)
    choice = F.lit(None).cast("array<double>")
    for k, t in enumerate(tables):
        values = (t.lpw + rho * t.egl / (np.pi * (1 - t.sab * rho))) / SCALE
        choice = F.when(F.col("vec_id") % len(tables) == k, F.array(*[F.lit(float(v)) for v in values])).otherwise(choice)
    pixels = cube(spark, sf_dir).pixels.select("product_id", "y", "x", choice.alias("radiance"))
    return ops.with_water_vapour(pixels, SCALE, BANDS, lut, AOT, SZA, 1.0).select("x", "y", F.round("water_vapour", 6).alias("water_vapour"))


@register("smile_shift")
def smile_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of every column; the scene's is the median."""
    rows = cube_long(spark, sf_dir).filter(~F.col("mask").isin(1, 2) & (F.col("value") > 0))
    means = rows.groupBy("product_id", "x", "band").agg(F.avg("value").alias("v")).groupBy("product_id", "x")
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias("spectrum"))
    return ops.smile_shifts(means, SCALE, BANDS, ops.stand_in_lut(), AOT, CWV, SZA).select("x", F.round("shift", 6).alias("shift"))


@register("spectral_polishing")
def spectral_polishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains from the 25 lowest and 25 highest vegetation indices of all valid pixels, applied to all pixels."""
    rows = cube(spark, sf_dir).pixels.select(*correction.KEYS, valid_pixels().alias("valid"), ops.invert("radiance", SCALE, _T).alias("reflectance"))
    gains = correction.scene_gains(rows.filter("valid"), BANDS, _endmembers())
    out = rows.select(F.posexplode(ops.polished("reflectance", gains)).alias("pos", "v"))
    return out.groupBy((F.col("pos") + 1).alias("band")).agg(F.round(F.avg("v"), 8).alias("mean"))


@register("correct_atmosphere")
def correct_atmosphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole correction of the cube: optical thickness, smile, water vapour, inversion, adjacency, polishing.

    SQL can't express its solvers; compute_surface_reflectances is the inversion alone.
    """
    params = AtmosphereParams(adjacency=True, polishing=True, water_vapour_map=True)
    out = correction.surface_reflectances(cube(spark, sf_dir), SCALE, ops.stand_in_lut(), params, _endmembers(), _irradiances(spark)).pixels
    return out.select("x", "y", F.round("water_vapour", 6).alias("water_vapour"), F.transform("reflectance", lambda v: F.round(v, 8)).alias("reflectance"))


def _irradiances(spark: SparkSession) -> tuple[float, float]:
    from ..operators.reflectance import solar_stand_in

    solar = np.array([(r["x"], r["y"]) for r in solar_stand_in(spark).orderBy("x").collect()])
    used = [BANDS[nearest_index(BANDS, w) - 1] for w in (688.0, 780.0)]
    red, nir = ops.resampling_weights(solar[:, 0], used) @ solar[:, 1]
    return float(red), float(nir)


def _support_sql(members: tuple[int, ...], weight: float) -> str:
    """The unmixing in these endmembers alone (1 to 3), by Cramer's rule: their sum, and all but the first, are unknown."""
    one = members[0]
    columns = [{one: 1}] + [{m: 1, one: -1} for m in members[1:]]
    gram = [[" + ".join(f"{u * v} * g{min(p, q)}{max(p, q)}" for p, u in c.items() for q, v in d.items()) for d in columns] for c in columns]
    side = [" + ".join(f"{u} * d{p}" for p, u in c.items()) for c in columns]
    n = range(len(members))
    cells = ", ".join([f"{gram[i][j]} AS m{i}{j}" for i in n for j in n] + [f"{side[i]} AS r{i}" for i in n])
    full = [[f"(m{i}{j}{f' + {weight}' if i == j == 0 else ''})" for j in n] for i in n]
    right = [f"(r{i}{f' + {weight}' if i == 0 else ''})" for i in n]
    solved = ", ".join(f"{det([[right[i] if j == k else full[i][j] for j in n] for i in n])} / {det(full)} AS z{k}" for k in n)
    cost = " + ".join([f"z{i} * z{j} * m{i}{j}" for i in n for j in n] + [f"-2 * r{i} * z{i}" for i in n] + [f"{weight} * power(z0 - 1, 2)"])
    share = {m: f"z{k}" for k, m in enumerate(members) if k} | {one: " - ".join(f"z{k}" for k in n)}
    shares = ", ".join(f"{share.get(m, '0.0e0')} AS a{m}" for m in (1, 2, 3))
    return f"SELECT x, y, {shares}, {cost} AS cost FROM (SELECT *, {solved} FROM (SELECT x, y, {cells} FROM pixels, gram))"


_SUPPORTS = ((1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 2, 3))
#: All seven supports of three endmembers are solved; the cheapest without a negative share wins.
_UNMIX_SQL = f"""{_RHO_SQL}, ends AS (SELECT b::INTEGER AS band, 1.0e0 AS e1, 0.05e0 + 0.4e0 / (1 + exp(-(10 * (b - 1) - 315) / 15.0e0)) AS e2, 0.05e0 + 0.35e0 * 10 * (b - 1) / 630 AS e3 FROM range(1, 65) t(b)),
gram AS (SELECT {', '.join(f'sum(e{i} * e{j}) AS g{i}{j}' for i in (1, 2, 3) for j in range(i, 4))} FROM ends),
pixels AS (SELECT x, y, {', '.join(f'sum(rho * e{i}) AS d{i}' for i in (1, 2, 3))} FROM rho JOIN ends USING (band) GROUP BY x, y),
tried AS ({' UNION ALL '.join(_support_sql(m, 1e6) for m in _SUPPORTS)}),
best AS (SELECT x, y, arg_min({{'a1': a1, 'a2': a2, 'a3': a3}}, cost) AS a FROM tried WHERE a1 >= 0 AND a2 >= 0 AND a3 >= 0 GROUP BY x, y)"""


@register("fclsu_unmixing", f"WITH {_UNMIX_SQL} SELECT x, y, round(a.a1, 6) AS constant, round(a.a2, 6) AS vegetation, round(a.a3, 6) AS soil FROM best")
def fclsu_unmixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube(spark, sf_dir).pixels.select("product_id", "y", "x", ops.invert("radiance", SCALE, _T).alias("rho"))
    out = ops.abundances(rows, ("product_id", "y", "x"), "rho", _endmembers())
    return out.select("x", "y", *[F.round(F.get("abundance", F.lit(k)), 6).alias(n) for k, n in enumerate(("constant", "vegetation", "soil"))])


@register("roots_brent", "SELECT event_id, round(power(abs(value) + 1, 1 / 3e0), 8) AS root FROM events")
def roots_brent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube roots as roots of x^3 - v, all of an Arrow batch at once."""
    from ..sources.testdata import table

    @F.pandas_udf("double")
    def root(v: pd.Series) -> pd.Series:
        target = v.to_numpy()
        return pd.Series(numerics.roots(lambda x: x**3 - target, np.zeros(len(target)), target + 1))

    return table(spark, sf_dir, "events").select("event_id", F.round(root(F.abs("value") + 1), 8).alias("root"))


@register(
    "min_brack_min_brent_powell",
    "SELECT event_type, true AS bracketed, round(avg(value), 4) AS minimum, round(regr_slope(value, event_id % 100), 4) AS slope, round(regr_intercept(value, event_id % 100), 3) AS intercept FROM events GROUP BY event_type",
)
def minimisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of each event type's values by search: a bracket, its minimum, and a line by Powell's method.

    The sums of squares come from moments, so that a type of any size is a few numbers.
    """
    from ..sources.testdata import table

    names = ("n", "t", "v", "tt", "tv", "vv")
    e = table(spark, sf_dir, "events").select("event_type", F.lit(1.0).alias("n"), (F.col("event_id") % 100).cast("double").alias("t"), F.col("value").alias("v"))
    sums = e.groupBy("event_type").agg(*[F.sum(F.col(n[0]) * F.col(n[-1]) if len(n) > 1 else F.col(n)).alias(n) for n in names])

    def solve(batches):
        for rows in batches:
            n, t, v, tt, tv, vv = (rows[c].to_numpy() for c in names)
            flat = lambda x, k: vv[k] - 2 * x * v[k] + n[k] * x * x
            low, inner, high = numerics.brackets(flat, np.zeros(len(n)), np.ones(len(n)))
            inside = (flat(inner, slice(None)) <= flat(low, slice(None))) & (flat(inner, slice(None)) <= flat(high, slice(None)))
            at, _ = numerics.minima(flat, low, inner, high)

            def line(p, k):
                b, a = p[:, 0], p[:, 1]
                return vv[k] - 2 * b * tv[k] - 2 * a * v[k] + b * b * tt[k] + 2 * a * b * t[k] + a * a * n[k]

            p, _ = numerics.minima_powell(line, np.zeros((len(n), 2)), accuracy=1e-15)
            yield pd.DataFrame({"event_type": rows["event_type"], "bracketed": inside, "minimum": at, "slope": p[:, 0], "intercept": p[:, 1]})

    found = sums.mapInPandas(solve, "event_type string, bracketed boolean, minimum double, slope double, intercept double")
    digits = {"minimum": 4, "slope": 4, "intercept": 3}
    return found.select("event_type", "bracketed", *[F.round(c, d).alias(c) for c, d in digits.items()])


@register("minima_by_event", "SELECT event_id, round(abs(value) % 7, 4) AS minimum, round(abs(value) % 5, 3) AS x, round(abs(value) % 3, 3) AS y FROM events")
def minima_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minima, bracketed from afar, of a parabola and by Powell's method of a tilted bowl, whose places are the event's;
    all events of an Arrow batch are searched together."""
    from ..sources.testdata import table

    def solve(batches):
        for rows in batches:
            v = np.abs(rows["value"].to_numpy())
            one, a, b = v % 7, v % 5, v % 3
            f = lambda t, k: (t - one[k]) ** 2 + 0.25
            at, _ = numerics.minima(f, *numerics.brackets(f, np.full(len(v), 20.0), np.full(len(v), 21.0)))
            bowl = lambda p, k: (p[:, 0] - a[k]) ** 2 + 2 * (p[:, 1] - b[k]) ** 2 + (p[:, 0] - a[k]) * (p[:, 1] - b[k])
            p, _ = numerics.minima_powell(bowl, np.tile((-4.0, 9.0), (len(v), 1)), accuracy=1e-14)
            yield pd.DataFrame({"event_id": rows["event_id"], "minimum": at, "x": p[:, 0], "y": p[:, 1]})

    # Few bytes, but much to compute for each.
    spread = table(spark, sf_dir, "events").select("event_id", "value").repartition(spark.sparkContext.defaultParallelism)
    made = spread.mapInPandas(solve, "event_id long, minimum double, x double, y double")
    return made.select("event_id", F.round("minimum", 4).alias("minimum"), *[F.round(n, 3).alias(n) for n in ("x", "y")])


@register("numeric_constants", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value + value * 2.220446049250313e-16 > value) AS seen, count(*) FILTER (WHERE value + value * 1.4901161193847656e-08 * 1.4901161193847656e-08 / 4 > value) AS unseen FROM events GROUP BY event_type")
def numeric_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of how many values a relative step of the machine's epsilon is seen, and of how many a quarter of it."""
    from ..sources.testdata import table

    v = F.col("value")
    grown = lambda step: F.count_if(v + v * step > v)
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.count("*").alias("n"), grown(numerics.MACHINE_EPSILON).alias("seen"), F.count_if(v + v * numerics.SQRT_EPSILON * numerics.SQRT_EPSILON / 4 > v).alias("unseen"))


@register("wide_long_round_trip", f"WITH {CUBE_SQL} SELECT x, y, list_sum(radiance)::BIGINT AS total, list_sum(mask)::BIGINT AS faults FROM cube")
def wide_long_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..model import to_long, to_wide

    rows = to_wide(to_long(cube(spark, sf_dir).pixels.select("product_id", "y", "x", "radiance", "mask")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))
    return rows.select("x", "y", total("radiance").alias("total"), total("mask").alias("faults"))
