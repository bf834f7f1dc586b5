"""Queries: aerosol optical thickness of acquisition sets, and the table in all axes, on projections of the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import radiometry as r
from ..model import doubles
from ..operators import aerosol, radiative
from ..operators.atmosphere import resampling_weights
from ..registry import register
from ..sources.testdata import BANDS, table

#: Five views of a set, which stand at nodes of the table: view and relative azimuth angles.
VIEWS = ((0.0, 0.0), (20.0, 0.0), (40.0, 0.0), (20.0, 180.0), (40.0, 180.0))
PIXELS, SZA, ALT, CWV = 100, 40.0, 0.0, 1.0
SET = PIXELS * len(VIEWS)


def banded():
    """The stand-in table averaged to the bands."""
    t = radiative.stand_in_table()
    return t.in_bands(resampling_weights(t.axes["wavelength"], BANDS))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as pixels of sets of five views of 10 x 10: set_id, product_id, view, y, x, embedding."""
    i = F.col("vec_id") % SET
    view, pixel = i % len(VIEWS), F.floor(i / len(VIEWS))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / SET).alias("set_id"), F.floor(F.col("vec_id") / SET).cast("string").alias("set"), view.cast("int").alias("view"),
        F.floor(pixel / 10).cast("int").alias("y"), (pixel % 10).cast("int").alias("x"), "embedding",
    ).withColumn("product_id", F.concat_ws("_", "set", "view")).drop("set")


def _views(pixels: DataFrame) -> DataFrame:
    at = lambda k: F.get(doubles([v[k] for v in VIEWS]), F.col("view"))
    return pixels.select("set_id", "product_id", "view").distinct().select(
        "set_id", "product_id", at(0).alias("vza"), F.lit(SZA).alias("sza"), at(1).alias("ada"), F.lit(ALT).alias("alt"), F.lit(CWV).alias("cwv"), (F.col("view") * 0.0).alias("fza")
    )


def land_scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and views of sets simulated over mixtures of vegetation and soil, at a thickness of the set's own."""
    t = banded()
    vegetation, soil = aerosol.endmembers(BANDS)
    pixels = _placed(spark, sf_dir)
    views = _views(pixels)
    truth = 0.12 + 0.06 * (F.col("set_id") % 8)
    air = radiative.with_table(views, t, {n: F.col(n) for n in aerosol.ANGLES} | {"aot": truth}).select("set_id", "product_id", "lpw", "egl", "sab")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 2.5 * F.get("embedding", F.lit(0)).cast("double")))
    bare = (1 - share) * (0.7 + F.abs(F.get("embedding", F.lit(1)).cast("double")))
    surface = F.zip_with(doubles(vegetation[0]), doubles(soil), lambda v, s: share * v + bare * s)
    seen = pixels.join(air, ["set_id", "product_id"]).withColumn("rho", surface)
    toa = F.transform(F.arrays_zip("rho", "lpw", "egl", "sab"), lambda c: r.lambert_forward(c["rho"], 1.0, c["lpw"], c["egl"], c["sab"]))
    return seen.select("set_id", "product_id", "y", "x", toa.alias("radiance"), F.lit(True).alias("valid"), F.lit(True).alias("clear")), views


@register("aot_land_views")
def aot_land_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thickness of every view by the joint inversion of pixel sets; SQL can't express the search (see the tests)."""
    out = aerosol.land_thickness(*land_scenes(spark, sf_dir), banded(), BANDS)
    return out.select("set_id", "product_id", F.round("aot_max", 4).alias("aot_max"), F.round("aot550", 4).alias("aot550"), "origin", "sets")


def water_scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and views of sets over water, whose radiances spread about the path radiances of the table."""
    pixels = _placed(spark, sf_dir)
    fall = doubles([(b.wavelength / 500.0) ** -2.5 for b in BANDS])
    toa = F.zip_with("embedding", fall, lambda v, f: (0.5 + 0.3 * (F.col("set_id") % 3) + F.abs(v.cast("double"))) * f)
    return pixels.select("set_id", "product_id", "y", "x", toa.alias("radiance"), F.lit(True).alias("valid")), _views(pixels)


def _water_sql(joint: bool) -> str:
    group = "set_id" if joint else "set_id, view"
    need = aerosol.DARK if joint else aerosol.DARK // len(VIEWS)
    lo, hi = aerosol.VISIBLE["water"]
    views = ", ".join(f"({k}, {vza}::DOUBLE, {ada}::DOUBLE)" for k, (vza, ada) in enumerate(VIEWS))
    nodes = ", ".join(f"({k}, {v}::DOUBLE)" for k, v in enumerate(radiative.STAND_IN["aot"]))
    last = len(radiative.STAND_IN["aot"]) - 1
    return f"""
WITH views AS (SELECT * FROM (VALUES {views}) v(view, vza, ada)), nodes AS (SELECT * FROM (VALUES {nodes}) n(k, aot)),
bell AS (SELECT b::INTEGER AS band, 400.0e0 + 10 * (b - 1) AS centre, 6.0e0 - 4.0e0 * (b - 1) / 63 AS e FROM range(1, 65) t(b)),
wl AS (SELECT 390.0e0 + 5 * i AS wl FROM range(133) t(i)),
weights AS (SELECT band, centre, wl, exp(-power(abs(centre - wl) / (10 * power(1 / (power(2.0e0, e) * ln(2.0e0)), 1 / e)), e)) AS w FROM bell, wl WHERE abs(centre - wl) <= 20),
fall AS (SELECT band, sum(w * power(wl / 500, -2.5e0)) / sum(w) AS f FROM weights WHERE centre BETWEEN {lo} AND {hi} GROUP BY band),
path AS (SELECT view, band, k, aot, (0.3e0 + 1.2e0 * aot) * (2.0e0 - cos(radians(vza))) * (1 + 0.1e0 * cos(radians(ada))) * (1 - {SZA}e0 / 300) * f AS lpw FROM views, nodes, fall),
pixels AS (SELECT vec_id // {SET} AS set_id, vec_id % {SET} % 5 AS view, unnest(range(1, 65)) AS band, unnest(embedding)::DOUBLE AS e FROM embeddings),
cells AS (SELECT set_id, view, band, (0.5e0 + 0.3e0 * (set_id % 3) + abs(e)) * power((400.0e0 + 10 * (band - 1)) / 500, -2.5e0) AS value FROM pixels JOIN fall USING (band)),
dark AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id, view, band ORDER BY value) AS rank FROM cells) WHERE rank <= {need}),
whole AS (SELECT set_id, view FROM (SELECT set_id, view, band, count(*) AS n FROM dark GROUP BY ALL) GROUP BY ALL HAVING min(n) = {need}),
used AS (SELECT dark.* FROM dark JOIN whole USING (set_id, view)),
coarse AS (SELECT {group}, k FROM used JOIN path USING (view, band) WHERE value <= lpw GROUP BY {group}, k HAVING count(DISTINCT rank) = {need}),
ids AS (SELECT DISTINCT {group} FROM whole),
below AS (SELECT {group}, coalesce(min(k), {last}) - 1 AS k FROM ids LEFT JOIN coarse USING ({group}) GROUP BY {group}),
origin AS (SELECT {group}, aot FROM below JOIN nodes USING (k) WHERE k > 0),
grid AS (SELECT {group}, i, aot + i * {aerosol.STEP}e0 AS t FROM origin, range(1, 201) r(i) WHERE aot + i * {aerosol.STEP}e0 <= 1.0),
sloped AS (SELECT *, lead(aot) OVER w AS upper, lead(lpw) OVER w AS next FROM path WINDOW w AS (PARTITION BY view, band ORDER BY k)),
fine AS (SELECT {", ".join(f"g.{c.strip()}" for c in group.split(","))}, i FROM grid g JOIN used u USING ({group}) JOIN sloped s ON s.view = u.view AND s.band = u.band AND g.t >= s.aot AND (g.t < s.upper OR (s.upper = 1.0 AND g.t <= 1.0))
  WHERE value <= lpw + (next - lpw) * (g.t - s.aot) / (upper - s.aot) GROUP BY ALL HAVING count(DISTINCT rank) = {need}),
stop AS (SELECT {group}, min(i) AS i FROM fine GROUP BY {group}), ends AS (SELECT {group}, max(i) AS i FROM grid GROUP BY {group}),
found AS (SELECT {group}, aot + {aerosol.STEP}e0 * greatest(0, coalesce(stop.i, ends.i) - 1) AS aot FROM origin JOIN ends USING ({group}) LEFT JOIN stop USING ({group})
  UNION ALL SELECT {group}, {radiative.STAND_IN["aot"][0]} FROM below WHERE k <= 0)
SELECT v.set_id, v.set_id::VARCHAR || '_' || v.view::VARCHAR AS product_id, round(CASE WHEN whole.view IS NOT NULL THEN aot END, 4) AS aot550
FROM (SELECT DISTINCT vec_id // {SET} AS set_id, vec_id % {SET} % 5 AS view FROM embeddings) v LEFT JOIN whole USING (set_id, view) LEFT JOIN found USING ({group})"""


@register("aot_water_views", _water_sql(False))
def aot_water_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view its own thickness, from its share of the set's dark pixels."""
    out = aerosol.water_thickness(*water_scenes(spark, sf_dir), banded(), BANDS, joint=False)
    return out.select("set_id", "product_id", F.round("aot550", 4).alias("aot550"))


@register("aot_water_joint", _water_sql(True))
def aot_water_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thickness for all views of a set."""
    out = aerosol.water_thickness(*water_scenes(spark, sf_dir), banded(), BANDS, joint=True)
    return out.select("set_id", "product_id", F.round("aot550", 4).alias("aot550"))


# The table in all axes --------------------------------------------------------------------------------------

#: Place of each vector in the table's axes: lowest value, span, and the divisor that makes the axes differ.
_PLACES = {"vza": (0.0, 60.0, 1.0), "sza": (0.0, 60.0, 3.0), "ada": (0.0, 180.0, 5.0), "alt": (0.0, 2.0, 7.0), "aot": (0.05, 0.95, 11.0), "cwv": (0.3, 4.7, 13.0)}
_AT_NM = (500.0, 940.0)


def _lookup_sql() -> str:
    """Every vector meets the corners of its cell, two nodes an axis, and adds the formula's values by weight."""
    names = list(_PLACES)
    axes = ", ".join(
        f"{n}_axis AS (SELECT lo, hi FROM (SELECT v AS lo, lead(v) OVER (ORDER BY v) AS hi FROM (SELECT unnest({list(radiative.STAND_IN[n])})::DOUBLE AS v)) WHERE hi IS NOT NULL)" for n in names
    )
    places = ", ".join(f"{a}e0 + (abs(value) / {d}e0) % 1 * {s}e0 AS {n}" for n, (a, s, d) in _PLACES.items())
    corners = " ".join(
        f"JOIN (SELECT vec_id, unnest([lo, hi]) AS {n}, unnest([1 - f, f]) AS w_{n} FROM (SELECT vec_id, lo, hi, (p.{n} - lo) / (hi - lo) AS f FROM p JOIN {n}_axis ON p.{n} >= lo AND (p.{n} < hi OR hi = {radiative.STAND_IN[n][-1]}))) c_{n} USING (vec_id)"
        for n in names
    )
    air, fall = "exp(-alt / 8)", "(wl / 500)"
    weight = " * ".join(f"w_{n}" for n in names)
    trans = "exp(-0.25e0 * cwv * exp(-power((wl - 940) / 25, 2))) * (1 - 0.5e0 * exp(-power((wl - 760.5e0) / 3, 2)))"
    values = {
        "lpw": f"(0.3e0 * {air} + 1.2e0 * aot) * (2 - cos(radians(vza))) * (1 + 0.1e0 * cos(radians(ada))) * (1 - sza / 300) * power({fall}, -2.5e0)",
        "direct": f"120 * power({fall}, -1.2e0) * exp(-0.8e0 * aot * (1 + sza / 100)) * (1 - vza / 600) * {trans}",
        "diffuse": f"25 * power({fall}, -2.0e0) * (0.4e0 * {air} + aot) * (1 - sza / 200) * {trans}",
        "sab": f"(0.05e0 * {air} + 0.1e0 * aot) / {fall}",
        "rat": f"0.1e0 + 0.5e0 * aot * power({fall}, -0.5e0)",
    }
    sums = ", ".join(f"sum({weight} * ({v})) AS {n}" for n, v in values.items())
    return f"""
WITH q AS (SELECT vec_id, 1000 * embedding[1]::DOUBLE + vec_id % 89 AS value FROM embeddings), p AS (SELECT vec_id, {places} FROM q), {axes},
cells AS (SELECT vec_id, wl, {sums} FROM (SELECT p.vec_id FROM p) {corners}, (SELECT unnest({list(_AT_NM)})::DOUBLE AS wl) GROUP BY vec_id, wl)
SELECT vec_id, wl, round(lpw, 7) AS lpw, round(direct * cos(radians(sza)) + diffuse, 5) AS egl, round(sab, 8) AS sab, round(rat, 8) AS rat FROM cells JOIN p USING (vec_id)"""


@register("lut_interpolation", _lookup_sql())
def lut_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path radiance, flux, albedo and ratio at two wavelengths for every vector's own angles, altitude and atmosphere."""
    t = radiative.stand_in_table()
    two = np.array([[float(w == nm) for w in t.axes["wavelength"]] for nm in _AT_NM])
    at = {n: lo + (F.abs("value") / d) % 1 * span for n, (lo, span, d) in _PLACES.items()}
    found = radiative.with_table(table(spark, sf_dir, "embeddings").select("vec_id", (1000 * F.get("embedding", F.lit(0)).cast("double") + F.col("vec_id") % 89).alias("value")), t.in_bands(two), at)
    each = found.select("vec_id", F.explode(F.arrays_zip(doubles(_AT_NM).alias("wl"), "lpw", "egl", "sab", "rat")).alias("c"))
    digits = {"lpw": 7, "egl": 5, "sab": 8, "rat": 8}
    return each.select("vec_id", "c.wl", *[F.round(f"c.{n}", d).alias(n) for n, d in digits.items()])
