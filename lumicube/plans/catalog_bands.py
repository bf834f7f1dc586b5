"""Queries: band selection, masks and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.finite import is_finite
from ..operators import bands as ops
from ..registry import register
from ..sources.testdata import BANDS, CUBE_SQL, LONG_SQL, PRODUCT_BANDS_SQL as BANDS_SQL, cube, cube_long, product_bands, table


@register("find_bands_by_prefix", f"WITH {BANDS_SQL} SELECT band, name, (row_number() OVER (ORDER BY band) - 1)::INTEGER AS place FROM bands WHERE starts_with(name, 'radiance_1')")
def find_bands_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_prefix(product_bands(spark, sf_dir), "radiance_1").select("band", "name", "place")


_TARGETS = (442.0, 444.9, 445.0, 555.0, 688.0, 780.0, 1200.0)


def _nearest_sql(found: str) -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in _TARGETS)
    return f"""WITH {BANDS_SQL}, targets AS (SELECT * FROM (VALUES {values}) v(target)),
      best AS (SELECT target, min({{'gap': abs(wl - target), 'band': band}}) AS b FROM targets, bands GROUP BY target)
      SELECT target, {found} AS band FROM best"""


@register("find_band_nearest_wavelength", _nearest_sql("CASE WHEN b.gap > 6 THEN -1 ELSE b.band END"))
def find_band_nearest_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([(t,) for t in _TARGETS], "target double")
    return ops.nearest_band(product_bands(spark, sf_dir), targets, 6.0)


def _bands(condition):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return product_bands(spark, sf_dir).filter(condition).select("band", "wavelength")

    return run


_SQL = f"WITH {BANDS_SQL} SELECT band, wl AS wavelength FROM bands WHERE "
_ANY = " OR ".join(f"(wl > {a} AND wl < {b})" for a, b in ops.ABSORPTION)
register("band_filter_inclusive", _SQL + "wl > 400 AND wl < 700")(lambda s, d: _bands(ops.inside(F.col("wavelength"), 400.0, 700.0))(s, d))
register("band_filter_inclusive_multi", _SQL + f"({_ANY})")(lambda s, d: _bands(ops.inside_any(F.col("wavelength"), ops.ABSORPTION))(s, d))
register("band_filter_exclusive_multi", _SQL + f"NOT ({_ANY})")(lambda s, d: _bands(~ops.inside_any(F.col("wavelength"), ops.ABSORPTION))(s, d))
register("band_filter_strict", _SQL + "wl - bw / 2 > 738 AND wl + bw / 2 < 788")(lambda s, d: _bands(ops.strictly_inside(F.col("wavelength"), F.col("bandwidth"), 738.0, 788.0))(s, d))


@register("band_sort_by_wavelength", f"WITH {BANDS_SQL} SELECT name, wl AS wavelength, row_number() OVER (ORDER BY wl DESC, band)::INTEGER AS place FROM bands")
def band_sort_by_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("wavelength"), "band")
    return product_bands(spark, sf_dir).select("name", "wavelength", F.row_number().over(w).alias("place"))


@register("categorize_bands", f"WITH {BANDS_SQL} SELECT band, CASE WHEN wl > 400 AND wl < 700 THEN 'vis' ELSE 'nir' END AS category FROM bands WHERE NOT ({_ANY})")
def categorize_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.categorize(product_bands(spark, sf_dir)).select("band", "category")


@register("min_max_bands", f"WITH {BANDS_SQL} SELECT (band // 1000)::INTEGER AS product, min(band) FILTER (WHERE wl >= 773) AS first_band, max(band) FILTER (WHERE wl <= 891) AS last_band FROM bands GROUP BY 1")
def min_max_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = product_bands(spark, sf_dir)
    return b.groupBy(F.floor(F.col("band") / 1000).cast("int").alias("product")).agg(F.min(F.when(F.col("wavelength") >= 773, F.col("band"))).alias("first_band"), F.max(F.when(F.col("wavelength") <= 891, F.col("band"))).alias("last_band"))


# Cluster sets: labels of the embeddings stand for cluster numbers.
_CLOUD, _IGNORED = (1, 4), (3,)


@register("index_filter_inclusive", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 4)")
def index_filter_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(i,) for i in _CLOUD], "label int")
    return table(spark, sf_dir, "embeddings").join(F.broadcast(wanted), "label", "left_semi").select("vec_id", "label")


@register("index_filter_exclusive", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (1, 3, 4)")
def index_filter_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = spark.createDataFrame([(i,) for i in _CLOUD + _IGNORED], "label int")
    return table(spark, sf_dir, "embeddings").join(F.broadcast(left_out), "label", "left_anti").select("vec_id", "label")


@register("semi_anti_cluster", "SELECT label, count(*) AS n, label IN (1, 4) AS cloud FROM embeddings WHERE label <> 3 GROUP BY label")
def semi_anti_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda ids: F.broadcast(spark.createDataFrame([(i,) for i in ids], "label int"))
    valid = table(spark, sf_dir, "embeddings").join(frame(_IGNORED), "label", "left_anti")
    cloud = valid.join(frame(_CLOUD), "label", "left_semi").withColumn("cloud", F.lit(True))
    earth = valid.join(frame(_CLOUD), "label", "left_anti").withColumn("cloud", F.lit(False))
    return cloud.unionByName(earth).groupBy("label", "cloud").agg(F.count("*").alias("n"))


# Masks ------------------------------------------------------------------------------------------------------


@register("valid_pixel_mask", f"WITH {CUBE_SQL} SELECT x, y, len(list_filter(mask, lambda m: (m & 3) <> 0)) = 0 AND radiance[1] / 20000.0 < 0.55 AS valid FROM cube")
def valid_pixel_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = F.element_at("radiance", 1) / 20000.0
    return cube(spark, sf_dir).pixels.select("x", "y", (ops.valid_pixels() & (cloud < 0.55)).alias("valid"))


@register("hyper_mask", f"WITH {CUBE_SQL} SELECT x, y, list_reduce(mask, lambda a, m: a | (m & 255))::INTEGER AS hyper FROM cube")
def hyper_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).pixels.select("x", "y", ops.hyper_mask().alias("hyper"))


@register("cloud_mask", f"WITH {CUBE_SQL} SELECT x, y, CASE WHEN radiance[1] / 20000.0 > 0.5 THEN 1 ELSE 0 END AS cloud FROM cube")
def cloud_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).pixels.select("x", "y", ops.cloud_mask(F.element_at("radiance", 1) / 20000.0, 0.5).alias("cloud"))


@register(
    "water_mask",
    f"WITH {CUBE_SQL} SELECT x, y, CASE WHEN radiance[30] > radiance[39] AND radiance[30] * 9e-6 > 0.01 AND radiance[39] * 9e-6 > 0.01 AND radiance[39] * 9e-6 < 0.1 THEN 1 ELSE 0 END AS water FROM cube",
)
def water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, nir = ops.nearest_index(BANDS, 688.0), ops.nearest_index(BANDS, 780.0)
    return cube(spark, sf_dir).pixels.select("x", "y", ops.water_mask(F.element_at("radiance", red), F.element_at("radiance", nir), 9e-6, 9e-6).alias("water"))


@register("zero_mask_source", f"WITH {CUBE_SQL} SELECT x, y, 0 AS zero FROM cube")
def zero_mask_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).pixels.select("x", "y", F.lit(0).alias("zero"))


_TYPE_SQL = "'CHRIS_M' || (o_orderkey % 7)::VARCHAR || ['', '_NR', '_NR_TOA_REFL', '_NR_AC', 'A', '0_NR'][o_orderkey % 6 + 1]"


@register(
    "product_type_filter",
    "SELECT t AS product_type, count(*) AS n, " + ", ".join(f"regexp_matches(t, '{p}') AS {k}" for k, p in ops.PRODUCT_TYPES.items()) + f" FROM (SELECT {_TYPE_SQL} AS t FROM orders) GROUP BY t",
)
def product_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages accept the products that the orders stand for, by type."""
    k = F.col("o_orderkey")
    end = F.get(F.array(*[F.lit(x) for x in ("", "_NR", "_NR_TOA_REFL", "_NR_AC", "A", "0_NR")]), (k % 6).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("CHRIS_M"), (k % 7).cast("string"), end).alias("product_type")).groupBy("product_type").agg(F.count("*").alias("n"))
    return rows.select("product_type", "n", *[F.col("product_type").rlike(p).alias(k) for k, p in ops.PRODUCT_TYPES.items()])


_ODD = "CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END"


@register("validity_nan_inf", f"SELECT event_type, count(*) FILTER (WHERE isfinite(v)) AS n_valid, count(*) FILTER (WHERE NOT isfinite(v)) AS n_invalid FROM (SELECT event_type, {_ODD} AS v FROM events) GROUP BY event_type")
def validity_nan_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    ok = is_finite(F.col("v"))
    return table(spark, sf_dir, "events").select("event_type", odd.alias("v")).groupBy("event_type").agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


# Projections ------------------------------------------------------------------------------------------------


@register("band_passthrough", f"WITH {CUBE_SQL} SELECT x, y, radiance[3]::INTEGER AS radiance_3, mask[3]::INTEGER AS mask_3 FROM cube")
def band_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).pixels.select("x", "y", F.element_at("radiance", 3).alias("radiance_3"), F.element_at("mask", 3).cast("int").alias("mask_3"))


@register("rename_bands", f"WITH {BANDS_SQL} SELECT replace(name, 'radiance', 'toa_refl') AS toa, replace(name, 'radiance', 'reflectance') AS boa, replace(name, 'radiance', 'vs_corr') AS factor FROM bands")
def rename_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = lambda new: F.replace("name", F.lit("radiance"), F.lit(new))
    return product_bands(spark, sf_dir).select(to("toa_refl").alias("toa"), to("reflectance").alias("boa"), to("vs_corr").alias("factor"))


@register("scale_unscale", f"WITH {LONG_SQL} SELECT band, sum(trunc(value * 1e-4 / 2e-4 + 0.5e0))::BIGINT AS raw, round(sum(value * 1e-4), 6) AS physical FROM long GROUP BY band")
def scale_unscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ops.scale(F.col("value"), 0.0001)
    return cube_long(spark, sf_dir).groupBy("band").agg(F.sum(ops.unscale(v, 0.0002)).alias("raw"), F.round(F.sum(v), 6).alias("physical"))


@register("column_pruning_by_feature_selection", f"WITH {CUBE_SQL} SELECT x, y, radiance[2] AS brightness_vis, radiance[5] AS whiteness_vis, radiance[7] AS brightness_nir, radiance[11] AS whiteness_nir, radiance[13] AS wv FROM cube")
def column_pruning_by_feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"brightness": 1, "brightness_vis": 2, "whiteness": 3, "whiteness_vis": 5, "brightness_nir": 7, "whiteness_nir": 11, "wv": 13, "o2": 17}
    frame = cube(spark, sf_dir).pixels.select("x", "y", *[F.element_at("radiance", i).alias(n) for n, i in at.items()])
    return frame.select("x", "y", *ops.feature_names("1", use_nir=True, use_water_vapour=True))


@register("rgb_projection", f"WITH {CUBE_SQL} SELECT x, y, radiance[26] AS red, radiance[16] AS green, radiance[6] AS blue FROM cube")
def rgb_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"red": 650.0, "green": 550.0, "blue": 450.0}
    return cube(spark, sf_dir).pixels.select("x", "y", *[F.element_at("radiance", ops.nearest_index(BANDS, w)).alias(n) for n, w in at.items()])
