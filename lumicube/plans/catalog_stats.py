"""Queries: statistics, regressions, selections and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.finite import linear_regression, statistics
from ..operators import statistics as ops
from ..operators.correction import kernel_of
from ..registry import register
from ..sources.testdata import ATTRS, CUBE_SQL, LARGE_SQL, LONG_SQL, TELEMETRY_SQL, WIDTH, cube, cube_long, large_raster, table, telemetry
from .sql import det

_ODD_SQL = "odd AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM events), ok AS (SELECT * FROM odd WHERE isfinite(v))"


@register(
    "statistics",
    f"WITH {_ODD_SQL} SELECT event_type, count(*) AS n, round(avg(v), 8) AS mean, round(var_samp(v), 6) AS variance, round(stddev_samp(v), 7) AS sdev, round(min(v), 8) AS min, round(max(v), 8) AS max, round(stddev_samp(v) / avg(v), 7) AS cv, round(median(v), 8) AS median FROM ok GROUP BY event_type",
)
def count_mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    out = statistics(table(spark, sf_dir, "events").select("event_type", odd.alias("v")), ["event_type"], "v")
    digits = {"variance": 6, "sdev": 7, "cv": 7}
    return out.select("event_type", "n", *[F.round(c, digits.get(c, 8)).alias(c) for c in ("mean", "variance", "sdev", "min", "max", "cv", "median")])


@register(
    "simple_linear_regression",
    "SELECT l_returnflag, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 8) AS r2, round(s2, 1) AS sigma2, round(sqrt(s2 / sxx), 6) AS slope_error, round(sqrt(s2 * (1 / n + ax * ax / sxx)), 4) AS intercept_error FROM (SELECT *, (syy - slope * sxy) / (n - 2) AS s2 FROM (SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_avgx(l_extendedprice, l_quantity) AS ax FROM lineitem GROUP BY l_returnflag))",
)
def simple_linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linear_regression(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    digits = {"slope": 6, "intercept": 4, "r2": 8, "sigma2": 1, "slope_error": 6, "intercept_error": 4}
    return out.select("l_returnflag", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@register(
    "multi_regression",
    "WITH s AS (SELECT l_returnflag, sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) AS bb, sum(l_quantity * l_extendedprice) AS ac, sum(l_discount * l_extendedprice) AS bc FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, round((ac * bb - bc * ab) / (aa * bb - ab * ab), 5) AS c1, round((bc * aa - ac * ab) / (aa * bb - ab * ab), 3) AS c2 FROM s",
)
def multi_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.multi_regression(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice")
    return out.select("l_returnflag", *[F.round(F.get("coefficients", F.lit(k)), d).alias(n) for k, (n, d) in enumerate((("c1", 5), ("c2", 3)))])


_THREE = ("l_quantity", "l_discount", "l_tax")
_NORMAL_SQL = ", ".join([f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(_THREE) for j, b in enumerate(_THREE)] + [f"sum({a} * l_extendedprice) AS r{i}" for i, a in enumerate(_THREE)])


def _cramer(k: int) -> str:
    g = [[f"g{i}{j}" for j in range(3)] for i in range(3)]
    return f"{det([[f'r{i}' if j == k else g[i][j] for j in range(3)] for i in range(3)])} / {det(g)}"


@register(
    "multi_regression_dependent",
    f"WITH s AS (SELECT l_linestatus, count(*) AS n, {_NORMAL_SQL} FROM lineitem GROUP BY l_linestatus), c AS (SELECT l_linestatus, n, {', '.join(f'{_cramer(k)} AS c{k}' for k in range(3))} FROM s) "
    "SELECT l_linestatus, n, 3 AS rank, round(c0 / 5, 4) AS quantity, round(c1, 2) AS discount, round(c2, 2) AS tax, round(2 * c0 / 5, 4) AS doubled FROM c",
)
def multi_regression_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four predictors, of which one is twice another: the rank is three, and both share the coefficient."""
    rows = table(spark, sf_dir, "lineitem").withColumn("doubled", F.col("l_quantity") * 2)
    out = ops.multi_regression(rows, ["l_linestatus"], [*_THREE, "doubled"], "l_extendedprice")
    names = {"quantity": 4, "discount": 2, "tax": 2, "doubled": 4}
    return out.select("l_linestatus", "n", "rank", *[F.round(F.get("coefficients", F.lit(k)), d).alias(n) for k, (n, d) in enumerate(names.items())])


@register("calibration_slope", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS slope FROM lineitem GROUP BY ALL")
def calibration_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.slope_through_origin(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return out.withColumn("slope", F.round("slope", 6))


@register("distinct_consecutive", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def distinct_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.without_repeats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


_VALUE = "CASE WHEN mask <> 0 THEN 0 ELSE value - 9000 END"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_long(spark, sf_dir).withColumn("value", F.when(F.col("mask") != 0, 0).otherwise(F.col("value") - 9000))


#: Kernel of the cube's mode.
KERNEL = kernel_of(ATTRS["mode"])


_BOX_SQL = f"""WITH {LONG_SQL}, v AS (SELECT x, y, band, {_VALUE} AS value FROM long),
box AS (SELECT a.x, a.y, a.band, any_value(a.value) AS own, sum(b.value) AS s, count(*) FILTER (WHERE b.value <> 0) AS n FROM v a JOIN v b ON b.band = a.band AND b.x BETWEEN a.x - {KERNEL // 2} AND a.x + {KERNEL // 2 - 1} AND b.y BETWEEN a.y - {KERNEL // 2} AND a.y + {KERNEL // 2 - 1} GROUP BY a.x, a.y, a.band)"""


@register("box_mean", f"{_BOX_SQL} SELECT x, y, band, CASE WHEN own = 0 OR n = 0 THEN 0 ELSE trunc(s::DOUBLE / n)::INTEGER END AS mean FROM box")
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.box_mean(_masked(spark, sf_dir), "value", KERNEL, columns=WIDTH).select("x", "y", "band", F.col("box_mean").alias("mean"))


@register("box_window", f"{_BOX_SQL} SELECT band, sum(n)::BIGINT AS reads FROM box GROUP BY band")
def box_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = KERNEL // 2
    rows = ops.window_sums(_masked(spark, sf_dir), {"n": (F.col("value") != 0).cast("long")}, half, half - 1, columns=WIDTH)
    return rows.groupBy("band").agg(F.sum("n").alias("reads"))


@register("adjacency_correction", f"{_BOX_SQL} SELECT x, y, band, round(own * 1e-4 + (own * 1e-4 - (CASE WHEN own = 0 OR n = 0 THEN 0 ELSE trunc(s::DOUBLE / n) END) * 1e-4) * (0.1e0 + 0.01e0 * band), 8) AS reflectance FROM box")
def adjacency_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.radiometry import adjacency_term

    rows = ops.box_mean(_masked(spark, sf_dir), "value", KERNEL, columns=WIDTH)
    rho, mean = F.col("value") * 1e-4, F.col("box_mean") * 1e-4
    return rows.select("x", "y", "band", F.round(rho + adjacency_term(rho, mean, 0.1 + 0.01 * F.col("band")), 8).alias("reflectance"))


@register("dark_pixels_topk", f"WITH {LARGE_SQL} SELECT band, rank, value FROM (SELECT band, value, row_number() OVER (PARTITION BY band ORDER BY value, y, x) AS rank FROM large WHERE value > 0) WHERE rank <= 100")
def dark_pixels_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.smallest(large_raster(spark, sf_dir), ["band"], "value", 100, ["y", "x"]).select("band", "rank", "value")


_NDVI_SQL = f"{CUBE_SQL}, ref AS (SELECT x, y, nir, (nir - red) / (nir + red) AS ndvi FROM (SELECT x, y, radiance[30] / 40000.0e0 AS red, radiance[39] / 25000.0e0 AS nir FROM cube)), kept AS (SELECT * FROM ref WHERE ndvi > 0.1 AND nir > 0.2 AND nir <= 0.75)"


@register("spiky_pixels", f"WITH {_NDVI_SQL} SELECT x, y, CASE WHEN lo <= 25 THEN 'low' ELSE 'high' END AS \"end\" FROM (SELECT *, row_number() OVER (ORDER BY ndvi, y, x) AS lo, row_number() OVER (ORDER BY ndvi DESC, y DESC, x DESC) AS hi, count(*) OVER () AS n FROM kept) WHERE n > 50 AND (lo <= 25 OR hi <= 25)")
def spiky_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.radiometry import ndvi

    rows = cube(spark, sf_dir).pixels.select("product_id", "x", "y", (F.element_at("radiance", 30) / 40000.0).alias("red"), (F.element_at("radiance", 39) / 25000.0).alias("nir"))
    rows = rows.withColumn("ndvi", ndvi(F.col("nir"), F.col("red"))).filter("ndvi > 0.1 AND nir > 0.2 AND nir <= 0.75")
    return ops.extremes(rows, "ndvi", 25, ["y", "x"]).select("x", "y", "end")


_AOT_SQL = f"""WITH {LONG_SQL}, clean AS (SELECT x, y FROM long GROUP BY x, y HAVING max(mask) = 0),
dark AS (SELECT * FROM (SELECT band, value, row_number() OVER (PARTITION BY band ORDER BY value, y, x) AS rank FROM long JOIN clean USING (x, y) WHERE value > 0 AND band BETWEEN 3 AND 30) WHERE rank <= 100),
hits AS (SELECT i, count(DISTINCT rank) AS n FROM dark, range(1, 101) g(i) WHERE value < 5000 + 6000 * (i * 0.05e0) + 2 * band GROUP BY i)
SELECT round((coalesce(min(i), 101) - 1) * 0.05e0, 6) AS aot FROM hits WHERE n >= 100"""


@register("find_max_aot", _AOT_SQL)
def find_max_aot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..model import to_long
    from ..operators.bands import valid_pixels

    clean = cube(spark, sf_dir).pixels.filter(valid_pixels())
    dark = ops.smallest(to_long(clean.select("product_id", "y", "x", "radiance", "mask")).filter("band BETWEEN 3 AND 30"), ["product_id", "band"], "value", 100, ["y", "x"])
    out = ops.max_aot(dark, lambda aot, band: 5000 + 6000 * aot + 2 * band, 0.0, 0.05, 5.0, 100)
    return out.select(F.round("aot", 6).alias("aot"))


@register("mean_toa_per_column", f"WITH {LONG_SQL} SELECT x, band, round(avg(value), 6) AS mean FROM long WHERE mask NOT IN (1, 2) AND value > 0 GROUP BY x, band")
def mean_toa_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube_long(spark, sf_dir).filter(~F.col("mask").isin(1, 2) & (F.col("value") > 0))
    return rows.groupBy("x", "band").agg(F.round(F.avg("value"), 6).alias("mean"))


@register("wv_mean", "SELECT l_returnflag, round(coalesce(avg(l_tax) FILTER (WHERE l_quantity > 10), 0), 8) AS wv FROM lineitem GROUP BY l_returnflag")
def wv_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = F.when(F.col("l_quantity") > 10, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.coalesce(F.avg(land), F.lit(0.0)), 8).alias("wv"))


@register(
    "angular_velocity",
    f"""WITH {TELEMETRY_SQL}, p AS (SELECT user_id, event_id, t + event_id * 1e-6 AS t, signal AS x, signal * 0.5e0 + 1 AS y, 3.0e0 AS z FROM telemetry),
n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER f) AS p, coalesce(lead(y) OVER w, first(y) OVER f) AS q, coalesce(lead(z) OVER w, first(z) OVER f) AS r, coalesce(lead(t) OVER w, first(t) OVER f) AS nt FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, x * p + y * q + z * r AS cs, sqrt(power(y * r - z * q, 2) + power(z * p - x * r, 2) + power(x * q - y * p, 2)) AS sn FROM n)
SELECT event_id, round(CASE WHEN cs <> 0 AND sn <> 0 THEN atan2(sn, cs) ELSE 0 END / nullif(abs(nt - t), 0), 9) AS velocity FROM a""",
)
def angular_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("user_id", "event_id", (F.col("t") + F.col("event_id") * 1e-6).alias("t"), F.col("signal").alias("x"), (F.col("signal") * 0.5 + 1).alias("y"), F.lit(3.0).alias("z"))
    return ops.angular_velocity(rows, ["user_id"], "t", "x", "y", "z").select("event_id", F.round("velocity", 9).alias("velocity"))


@register("first_match_last_match", "SELECT user_id, min(event_id) FILTER (WHERE value >= 50) AS first_match, max_by(value, event_id) FILTER (WHERE event_type = 'click') AS last_value FROM events GROUP BY user_id")
def first_match_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(F.when(F.col("value") >= 50, F.col("event_id"))).alias("first_match"), F.max_by(F.when(click, F.col("value")), F.when(click, F.col("event_id"))).alias("last_value")
    )


@register("join_band_stack", f"WITH {LONG_SQL} SELECT x, y, a.value AS red, b.value AS nir, a.mask | b.mask AS mask FROM long a JOIN long b USING (x, y) WHERE a.band = 30 AND b.band = 39")
def join_band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube_long(spark, sf_dir)
    one = lambda b, name: rows.filter(F.col("band") == b).select("y", "x", F.col("value").alias(name), F.col("mask").alias(f"m_{name}"))
    return one(30, "red").join(one(39, "nir"), ["y", "x"]).select("x", "y", "red", "nir", F.col("m_red").cast("int").bitwiseOR(F.col("m_nir").cast("int")).alias("mask"))


@register("union_all_panorama", f"WITH {LONG_SQL} SELECT band, count(*) AS n, sum(value)::BIGINT AS total FROM long GROUP BY band")
def union_all_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube_long(spark, sf_dir)
    return rows.filter("y < 10").unionByName(rows.filter("y >= 10")).groupBy("band").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@register("union_distinct_set", "SELECT DISTINCT source FROM documents")
def union_distinct_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source")
    return rows.union(rows).distinct()
