"""Queries: scenes written and read as band files, and bands of stored scenes replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import doubles
from ..registry import register
from ..sources import band_files, band_store
from ..sources.testdata import BANDS, CUBE_SQL, LONG_SQL, cube_long

#: Value of places where the cube's last line has no pixel.
FILL = -1.0


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's radiances and masks as image lines."""
    wavelength = F.get(doubles([b.wavelength for b in BANDS]), F.col("band") - 1)
    cells = cube_long(spark, sf_dir).withColumn("wavelength", wavelength)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, c in (("radiance", "value"), ("mask", "mask")))))
    return band_files.to_lines(cells.select("product_id", "band", "wavelength", "y", "x", each.alias("k")).select("product_id", "k.kind", "band", "wavelength", "y", "x", "k.value"), FILL)


@register("scan_product", f"WITH {LONG_SQL} SELECT band, 400.0e0 + 10 * (band - 1) AS wavelength, y, x, value FROM long WHERE mask IN (0, 1, 2)")
def scan_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every radiance of the scene's band files; the files of the masks aren't opened."""
    path = band_files.shared_folder(spark, "scene")
    band_files.write_lines(_lines(spark, sf_dir), path)
    cells = band_files.to_cells(band_files.scan_lines(spark, path, band_files.Choice(kinds=["radiance"])))
    return cells.filter(F.col("value") != FILL).select("band", "wavelength", "y", "x", F.col("value").cast("int").alias("value"))


@register(
    "sink_product",
    f"WITH {CUBE_SQL}, scaled AS (SELECT y, x, unnest(range(1, 65))::INTEGER AS band, unnest(radiance) AS v FROM cube) "
    "SELECT band, 400.0e0 + 10 * (band - 1) AS wavelength, (max(y) OVER () + 1)::INTEGER AS lines, y, sum(round(v / 4.0) * 4)::BIGINT AS total, count(*) AS n FROM scaled GROUP BY band, y",
)
def sink_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene as scaled 16-bit integers, written, then replaced by itself, and read back by line."""
    path = band_files.shared_folder(spark, "scene")
    for again in (False, True):
        radiance = _lines(spark, sf_dir).filter("kind = 'radiance'")
        stored = radiance.withColumn("samples", F.transform("samples", lambda v: F.when(v == FILL, -4.0).otherwise(F.floor(v / 4 + 0.5) * 4)))
        band_files.write_lines(stored, path, overwrite=again, dataType="2", gain="4.0")
    back = band_files.scan_lines(spark, path)
    lines = back.agg((F.max("y") + 1).alias("lines"))  # one row
    kept = F.filter("samples", lambda v: v >= 0)
    sums = back.select("band", "wavelength", "y", F.aggregate(kept, F.lit(0.0), lambda s, v: s + v).cast("long").alias("total"), F.size(kept).cast("long").alias("n"))
    return sums.withColumn("lines", F.lit(lines.first()["lines"]).cast("int")).select("band", "wavelength", "lines", "y", "total", "n")


@register("sink_band_into_product", f"WITH {CUBE_SQL} SELECT x, y, round(radiance[1] / 20000.0, 6) AS cloud_product FROM cube")
def sink_band_into_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band added to a stored scene and then replaced by one made of the stored radiances."""
    path = band_files.shared_folder(spark, "store")
    lines = _lines(spark, sf_dir)
    band_store.write_bands(lines, path)
    first = band_store.read_bands(spark, path).filter("kind = 'radiance' AND band = 1").withColumns({"kind": F.lit("cloud_product"), "wavelength": F.lit(None).cast("double")})
    band_store.put_bands(first.withColumn("samples", F.transform("samples", lambda v: v * 0)), path)
    band_store.put_bands(first.withColumn("samples", F.transform("samples", lambda v: F.when(v == FILL, FILL).otherwise(v / 20000))), path)
    made = band_files.to_cells(band_store.read_bands(spark, path).filter("kind = 'cloud_product'"))
    return made.filter(F.col("value") != FILL).select("x", "y", F.round("value", 6).alias("cloud_product"))


@register("copy_product", f"WITH {CUBE_SQL} SELECT x, y, radiance::INTEGER[] AS radiance, mask::SMALLINT[] AS mask FROM cube")
def copy_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene with all its bands, through its stored form and back to pixels."""
    path = band_files.shared_folder(spark, "store")
    band_store.write_bands(_lines(spark, sf_dir), path)
    pixels = band_files.to_pixels(band_store.read_bands(spark, path), {"radiance": "int", "mask": "smallint"})
    return pixels.filter(F.get("radiance", F.lit(0)) != int(FILL)).select("x", "y", "radiance", "mask")
