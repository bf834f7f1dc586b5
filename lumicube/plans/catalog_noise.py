"""Queries: dropout repair and destriping, stage by stage, on the test cube cut into two stacked products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.radiometry import round_half_up_int, slit_temperature
from ..operators import noise as ops
from ..operators.smoothing import with_lowess
from ..operators.statistics import window_sums
from ..params import DestripingParams, DropoutParams
from ..registry import register
from ..sources.testdata import CUBE_SQL, LARGE_SQL, LONG_SQL, WIDTH, cube, cube_long, large_raster, table
from .sql import lowess

MODE, TEMPERATURE, ORDER = "1", 5.0, 11
_GAIN, _SHIFT = slit_temperature(TEMPERATURE, ops.SLIT_GAIN, ops.SLIT_SHIFT)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as an acquisition set of two products, rows below and from 10."""
    return cube(spark, sf_dir).pixels.withColumns({"acq_set_id": F.lit("a"), "product_id": F.when(F.col("y") < 10, "p0").otherwise("p1")})


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).groupBy("acq_set_id", "product_id").agg(F.countDistinct("y").cast("int").alias("height"))


def slit_profile(spark: SparkSession) -> DataFrame:
    """Stand-in profile: a small ripple on a regular grid (not the instrument's table)."""
    position = F.col("id") * 0.25
    return spark.range(400).select(position.alias("position"), (1 + 0.01 * F.sin(position)).alias("factor"))


def slit(spark: SparkSession) -> DataFrame:
    return ops.slit_factors(slit_profile(spark), TEMPERATURE, WIDTH, MODE)


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = products(spark, sf_dir).join(F.broadcast(slit(spark)), "x")
    return joined.withColumn("spectrum", F.transform("radiance", lambda r: r / F.col("slit")))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.edge_angles(corrected(spark, sf_dir))


SLIT_SQL = f"""profile AS (SELECT i * 0.25e0 AS position, 1 + 0.01e0 * sin(i * 0.25e0) AS factor FROM range(400) t(i)),
slit AS (
  SELECT c AS x, coalesce(f, 1)::DOUBLE AS slit FROM (SELECT c::INTEGER AS c FROM range({WIDTH}) t(c)) LEFT JOIN (
    SELECT greatest(ceil((position - {_SHIFT!r}::DOUBLE - 0.5e0) / 2) - 1, 0)::INTEGER AS x, avg((factor - 1) * {_GAIN!r}::DOUBLE + 1) AS f
    FROM profile WHERE position - {_SHIFT!r}::DOUBLE > 0.5e0 GROUP BY 1) ON x = c)"""
_LAG_SQL = f"""{LONG_SQL}, {SLIT_SQL},
px AS (SELECT x, y, band, mask, CASE WHEN y < 10 THEN 'p0' ELSE 'p1' END AS product_id, value / slit AS v FROM long JOIN slit USING (x)),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY y, band ORDER BY x) AS lv FROM px)"""
_SAD_SQL = f"""{_LAG_SQL},
norms AS (SELECT x, y, any_value(product_id) AS product_id, sum(v * v) AS norm, sum(v * lv) AS product FROM lagged GROUP BY x, y),
sad AS (SELECT x, y, product_id, norm, product, CASE WHEN x = 0 THEN 0 ELSE acos(least(1, greatest(-1, product / sqrt(lag(norm) OVER (PARTITION BY y ORDER BY x)) / sqrt(norm)))) END AS sad FROM norms)"""
_THRESHOLD_SQL = f"""{_SAD_SQL},
ranked AS (SELECT x, sad, row_number() OVER (PARTITION BY x ORDER BY sad) - 1 AS rn, count(*) OVER (PARTITION BY x) AS h FROM sad WHERE x > 0),
stats AS (SELECT x, max(CASE WHEN rn = floor(h * 0.6e0) THEN sad END) AS t60, max(CASE WHEN rn = floor(h * 0.8e0) THEN sad END) AS t80 FROM ranked GROUP BY x),
threshold AS (SELECT least(greatest({ops.EDGE_THRESHOLDS[MODE]}e0, max(t60)), max(t80)) AS threshold FROM stats)"""
_EDGE_SQL = f"{_THRESHOLD_SQL}, edge AS (SELECT x, y, product_id, x > 0 AND sad > threshold AS edge FROM sad, threshold)"
_MEANS_SQL = f"""{_EDGE_SQL},
means AS (SELECT band, x, count(*) FILTER (WHERE ok) AS n, avg(ln(v / lv)) FILTER (WHERE ok) AS mean FROM (
  SELECT l.*, l.x > 0 AND NOT edge AND mask = 0 AS ok FROM lagged l JOIN edge e USING (x, y)) GROUP BY band, x)"""
_PROFILE_SQL = f"""{_MEANS_SQL},
carried AS (SELECT band, x, n, mean, last_value(CASE WHEN x = 0 THEN 0 ELSE mean END IGNORE NULLS) OVER (PARTITION BY band ORDER BY x ROWS UNBOUNDED PRECEDING) AS p FROM means),
integrated AS (SELECT *, sum(p) OVER (PARTITION BY band ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM carried)"""
_FACTORS_SQL = f"""{_PROFILE_SQL},
series AS (SELECT band, x AS i, c AS v FROM integrated),
{lowess("series", "band", "smooth", 2, ORDER, 2)},
factors AS (SELECT band, i AS x, exp(-((v - z) - avg(v - z) OVER (PARTITION BY band))) / slit AS factor FROM smooth JOIN slit ON slit.x = i)"""


@register("slit_temperature_model", f"SELECT event_id, round(value * {ops.SLIT_GAIN[0]!r}::DOUBLE + {ops.SLIT_GAIN[1]!r}::DOUBLE, 9) AS scale, round(value * {ops.SLIT_SHIFT[0]!r}::DOUBLE + {ops.SLIT_SHIFT[1]!r}::DOUBLE, 9) AS shift FROM events")
def slit_temperature_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and shift of the slit at the temperature of every event."""
    scale, shift = slit_temperature(F.col("value"), ops.SLIT_GAIN, ops.SLIT_SHIFT)
    return table(spark, sf_dir, "events").select("event_id", F.round(scale, 9).alias("scale"), F.round(shift, 9).alias("shift"))


#: A profile measured many times: every vector is a measurement at one of 400 places.
_MEASURED_SQL = SLIT_SQL.replace("SELECT i * 0.25e0 AS position, 1 + 0.01e0 * sin(i * 0.25e0) AS factor FROM range(400) t(i)", "SELECT vec_id % 400 * 0.25e0 AS position, 1 + 0.01e0 * embedding[1]::DOUBLE AS factor FROM embeddings")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(((F.col("vec_id") % 400) * 0.25).alias("position"), (1 + 0.01 * F.get("embedding", F.lit(0)).cast("double")).alias("factor"))


@register("rebin_mean", f"WITH {_MEASURED_SQL} SELECT x, round(slit, 9) AS slit FROM slit")
def rebin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.slit_factors(_measured(spark, sf_dir), TEMPERATURE, WIDTH, MODE).select("x", F.round("slit", 9).alias("slit"))


@register("join_rebin", f"WITH {_MEASURED_SQL} SELECT greatest(ceil((position - {_SHIFT!r}::DOUBLE - 0.5e0) / 2) - 1, 0)::INTEGER AS x, count(*) AS n FROM profile WHERE position - {_SHIFT!r}::DOUBLE > 0.5e0 GROUP BY 1")
def join_rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("position") - _SHIFT
    return _measured(spark, sf_dir).filter(p > 0.5).groupBy(F.greatest(F.ceil((p - 0.5) / 2) - 1, F.lit(0)).cast("int").alias("x")).agg(F.count("*").alias("n"))


@register("join_slit_profile", f"WITH {_LAG_SQL} SELECT band, round(sum(v), 6) AS total FROM px GROUP BY band")
def join_slit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected(spark, sf_dir).select(F.posexplode("spectrum").alias("pos", "v")).groupBy((F.col("pos") + 1).alias("band")).agg(F.round(F.sum("v"), 6).alias("total"))


@register("panorama_offset", "SELECT 'p0' AS product_id, 0 AS \"offset\" UNION ALL SELECT 'p1', 10")
def panorama_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.panorama(heights(spark, sf_dir)).select("product_id", "offset")


@register("lag_across_track", f"WITH {_LAG_SQL} SELECT x, y, CASE WHEN count(lv) > 0 THEN list(round(lv, 6) ORDER BY band) END AS left_spectrum FROM lagged GROUP BY x, y")
def lag_across_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left neighbour's spectrum, all bands; null in the first column."""
    return ops.across_track(corrected(spark, sf_dir)).select("x", "y", F.transform("left", lambda v: F.round(v, 6)).alias("left_spectrum"))


@register("spectral_norms", f"WITH {_SAD_SQL} SELECT x, y, round(norm / 1e6, 4) AS norm, round(product / 1e6, 4) AS product FROM sad")
def spectral_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.spectral_norms(ops.across_track(corrected(spark, sf_dir)))
    return rows.select("x", "y", F.round(F.col("norm") / 1e6, 4).alias("norm"), F.round(F.col("product") / 1e6, 4).alias("product"))


@register("spectral_angle", f"WITH {_SAD_SQL} SELECT x, y, round(sad, 8) AS sad FROM sad")
def spectral_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles(spark, sf_dir).select("x", "y", F.round("sad", 8).alias("sad"))


@register("column_order_statistics", f"WITH {_THRESHOLD_SQL} SELECT x, round(t60, 8) AS t60, round(t80, 8) AS t80 FROM stats")
def column_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.column_order_statistics(angles(spark, sf_dir))
    return out.select("x", F.round("t60", 8).alias("t60"), F.round("t80", 8).alias("t80"))


@register("nth_element", f"WITH {LARGE_SQL} SELECT band, value FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY value, y, x) - 1 AS rn, count(*) OVER (PARTITION BY band) AS n FROM large) WHERE rn = floor(n * 0.6e0)")
def nth_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    # percentile_disc would shift by one: the place is trunc(p * n), counted from 0.
    w = Window.partitionBy("band")
    rows = large_raster(spark, sf_dir).withColumn("rn", F.row_number().over(w.orderBy("value", "y", "x")) - 1).withColumn("n", F.count("*").over(w))
    return rows.filter(F.col("rn") == F.floor(F.col("n") * 0.6)).select("band", "value")


@register("adaptive_threshold", f"WITH {_THRESHOLD_SQL} SELECT round(threshold, 8) AS threshold FROM threshold")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ops.column_order_statistics(angles(spark, sf_dir))
    return ops.adaptive_threshold(stats, MODE).select(F.round("threshold", 8).alias("threshold"))


@register("edge_mask", f"WITH {_EDGE_SQL} SELECT x, y, edge FROM edge")
def edge_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = angles(spark, sf_dir)
    threshold = ops.adaptive_threshold(ops.column_order_statistics(a), MODE)
    return ops.edge_mask(a, threshold).select("x", "y", "edge")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = angles(spark, sf_dir)
    threshold = ops.adaptive_threshold(ops.column_order_statistics(a), MODE)
    edges = ops.edge_mask(a, threshold).select("product_id", "y", "x", "edge")
    rows = corrected(spark, sf_dir).join(edges, ["product_id", "y", "x"])
    rows = rows.select("acq_set_id", "product_id", "y", "x", "edge", F.posexplode(F.arrays_zip("spectrum", "mask")).alias("pos", "s"))
    rows = rows.select("acq_set_id", "product_id", "y", "x", "edge", (F.col("pos") + 1).alias("band"), F.col("s.spectrum").alias("value"), F.col("s.mask").alias("mask"))
    w = Window.partitionBy("product_id", "y", "band").orderBy("x")
    return ops.column_log_ratio_mean(rows.withColumns({"left_value": F.lag("value").over(w), "left_mask": F.lag("mask").over(w)}))


@register("column_log_ratio_mean", f"WITH {_MEANS_SQL} SELECT band, x, n, round(mean, 9) AS mean FROM means")
def column_log_ratio_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("band", "x", "n", F.round("mean", 9).alias("mean"))


@register("carry_forward", f"WITH {_PROFILE_SQL} SELECT band, x, round(p, 9) AS p FROM carried")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.carried_profile(_means(spark, sf_dir)).select("band", "x", F.round("p", 9).alias("p"))


@register("cumulative_profile", f"WITH {_PROFILE_SQL} SELECT band, x, round(c, 9) AS c FROM integrated")
def cumulative_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.integrated_profile(ops.carried_profile(_means(spark, sf_dir))).select("band", "x", F.round("c", 9).alias("c"))


_COLUMN_MEANS_SQL = f"{LARGE_SQL}, series AS (SELECT band, x AS i, avg(value) AS v FROM large GROUP BY band, x)"


def _smooth(degree: int, span: int, passes: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        means = large_raster(spark, sf_dir).groupBy("band", "x").agg(F.avg("value").alias("v"))
        series = means.groupBy("band").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("v"))
        out = with_lowess(series, "v", "z", degree, span, passes).select("band", F.posexplode("z").alias("i", "z"))
        return out.select("band", "i", F.round("z", 7).alias("z"))

    return run


for _name, _args in (("lowess", (2, 27, 2)), ("lowess_constant", (0, 9, 2)), ("lowess_linear", (1, 11, 1))):
    register(_name, f"WITH {_COLUMN_MEANS_SQL}, {lowess('series', 'band', 'smooth', *_args)} SELECT band, i, round(z, 7) AS z FROM smooth")(_smooth(*_args))


@register("mean_noise_removal", f"WITH {_COLUMN_MEANS_SQL} SELECT band, i AS x, round(v - avg(v) OVER (PARTITION BY band), 8) AS noise FROM series")
def mean_noise_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = large_raster(spark, sf_dir).groupBy("band", "x").agg(F.avg("value").alias("v"))
    return means.select("band", "x", F.round(F.col("v") - F.avg("v").over(Window.partitionBy("band")), 8).alias("noise"))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.destriping_factors(products(spark, sf_dir), MODE, DestripingParams(ORDER), slit(spark))


@register("compute_destriping_factors", f"WITH {_FACTORS_SQL} SELECT band, x, round(factor, 7) AS factor FROM factors")
def compute_destriping_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factors(spark, sf_dir).select("band", "x", F.round("factor", 7).alias("factor"))


_APPLIED_SQL = f"{_FACTORS_SQL}, applied AS (SELECT y, x, band, trunc(value * round(factor, 7) + 0.5e0)::INTEGER AS value FROM long JOIN factors USING (band, x))"


@register("apply_destriping_factors", f"WITH {_APPLIED_SQL} SELECT band, sum(value)::BIGINT AS total, min(value) AS least, max(value) AS most FROM applied GROUP BY band")
def apply_destriping_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = _factors(spark, sf_dir).withColumn("factor", F.round("factor", 7))
    out = ops.apply_destriping(products(spark, sf_dir), factors).select(F.posexplode("radiance").alias("pos", "value"))
    return out.groupBy((F.col("pos") + 1).alias("band")).agg(F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


@register(
    "join_factors",
    f"WITH {LARGE_SQL}, factors AS (SELECT b::INTEGER AS band, x::INTEGER AS x, 1 + 0.001e0 * ((x * 7 + b * 3) % 11 - 5) AS factor FROM range(1, 8) a(b), range(128) c(x)) "
    "SELECT band, sum(trunc(value * factor + 0.5e0))::BIGINT AS total FROM large JOIN factors USING (band, x) GROUP BY band",
)
def join_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(7 * 128).select((F.floor(F.col("id") / 128) + 1).cast("int").alias("band"), (F.col("id") % 128).cast("int").alias("x"))
    factors = grid.withColumn("factor", 1 + 0.001 * ((F.col("x") * 7 + F.col("band") * 3) % 11 - 5))
    joined = large_raster(spark, sf_dir).join(F.broadcast(factors), ["band", "x"])  # 128 columns by 7 bands
    return joined.groupBy("band").agg(F.sum(round_half_up_int(F.col("value") * F.col("factor"))).alias("total"))


@register("round_half_up_int16", f"WITH {LONG_SQL} SELECT band, sum(trunc(value * 1.37e0 + 0.5e0))::BIGINT AS total FROM long GROUP BY band")
def round_half_up_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_long(spark, sf_dir).groupBy("band").agg(F.sum(round_half_up_int(F.col("value") * 1.37, "smallint")).alias("total"))


# Dropouts ---------------------------------------------------------------------------------------------------

_OFFSETS_SQL = {k: "offsets AS (SELECT * FROM (VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx in v) + ") o(dy, dx))" for k, v in ops.NEIGHBOURS.items()}


def _dropout_sql(kind: str, n: int) -> str:
    return f"""WITH {LONG_SQL}, {_OFFSETS_SQL[kind]},
pairs AS (SELECT a.x, a.y, a.band, b.x AS nx, b.y AS ny, b.value AS v, b.mask AS k FROM long a, offsets JOIN long b ON b.x = a.x + dx AND b.y = a.y + dy AND b.band = a.band WHERE a.mask = 1 AND b.mask <> 1),
dist AS (SELECT p.x, p.y, p.band, nx, ny, any_value(p.v) AS v, any_value(p.k) AS k, sum(power(c.value - d.value, 2)) AS ss, count(d.value) AS n
  FROM pairs p LEFT JOIN long c ON c.x = p.x AND c.y = p.y AND c.band BETWEEN p.band - {n} AND p.band + {n} AND c.mask = 0
  LEFT JOIN long d ON d.x = nx AND d.y = ny AND d.band = c.band AND d.mask = 0 GROUP BY p.x, p.y, p.band, nx, ny),
weighted AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE 1 / greatest(sqrt(ss / n), {ops._EPS!r}::DOUBLE) END AS w FROM dist)
SELECT x, y, band, round(coalesce(sum(w * v) FILTER (WHERE k = 0) / sum(w) FILTER (WHERE k = 0), avg(v) FILTER (WHERE k = 2)), 6) AS value,
  CASE WHEN count(*) FILTER (WHERE k = 0) > 0 THEN 0 ELSE 2 END AS source FROM weighted GROUP BY x, y, band"""


def _dropouts(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ops.dropout_estimates(cube(spark, sf_dir).pixels, DropoutParams(5, kind))
        return out.select("x", "y", "band", F.round("value", 6).alias("value"), "source")

    return run


register("correct_dropouts", _dropout_sql("N4", 5))(_dropouts("N4"))
register("correct_dropouts_n8", _dropout_sql("N8", 5))(_dropouts("N8"))


@register(
    "join_neighbours",
    f"WITH {LONG_SQL}, {_OFFSETS_SQL['N8']} SELECT a.x, a.y, a.band, count(*) AS n, sum(b.value)::BIGINT AS total FROM long a, offsets JOIN long b ON b.x = a.x + dx AND b.y = a.y + dy AND b.band = a.band GROUP BY a.x, a.y, a.band",
)
def join_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sum of the eight neighbours of every pixel and band, by running frames along both axes."""
    v = F.col("value").cast("long")
    rows = window_sums(cube_long(spark, sf_dir), {"s": v, "n": (~F.col("_gap")).cast("long")}, 1, 1, columns=WIDTH)
    rows = rows.withColumns({"s": F.col("s") - F.coalesce(v, F.lit(0)), "n": F.col("n") - 1})
    return rows.filter("n > 0").select("x", "y", "band", "n", F.col("s").alias("total"))


@register(
    "neighbour_window_3x3",
    f"WITH {LONG_SQL} SELECT x, y, band, lag(value) OVER (PARTITION BY band, y ORDER BY x) AS w, lead(value) OVER (PARTITION BY band, y ORDER BY x) AS e, lag(value) OVER (PARTITION BY band, x ORDER BY y) AS n, lead(value) OVER (PARTITION BY band, x ORDER BY y) AS s FROM long",
)
def neighbour_window_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four next pixels of every pixel and band; whole spectra pass through the windows."""
    row, column = Window.partitionBy("product_id", "y").orderBy("x"), Window.partitionBy("product_id", "x").orderBy("y")
    ways = {"w": F.lag("radiance").over(row), "e": F.lead("radiance").over(row), "n": F.lag("radiance").over(column), "s": F.lead("radiance").over(column)}
    pixels = cube(spark, sf_dir).pixels.select("product_id", "x", "y", "radiance").withColumns(ways)
    each = pixels.select("x", "y", *ways, F.posexplode("radiance").alias("at", "v"))
    return each.select("x", "y", (F.col("at") + 1).alias("band"), *[F.get(k, F.col("at")).alias(k) for k in ways])


@register("spectral_neighbours", f"WITH {CUBE_SQL} SELECT x, y, list_sum(radiance[5:15])::BIGINT AS around_10, list_sum(radiance[1:7])::BIGINT AS around_2 FROM cube")
def spectral_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda b, n: F.aggregate(F.slice("radiance", max(1, b - n), min(64, b + n) - max(1, b - n) + 1), F.lit(0).cast("long"), lambda a, v: a + v)
    return cube(spark, sf_dir).pixels.select("x", "y", total(10, 5).alias("around_10"), total(2, 5).alias("around_2"))
