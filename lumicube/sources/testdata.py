"""Projections of the relational test tables into the data model, in Spark and in DuckDB SQL.

Both use integer arithmetic only, so that the two engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import Band, Scene

WIDTH = 25
BANDS = tuple(Band(b, f"radiance_{b}", 400.0 + 10.0 * (b - 1), 10.0) for b in range(1, 65))
#: Scene attributes: literals of the test projection.
ATTRS = {"mode": "1", "solar_zenith": "35.0", "view_zenith": "20.0", "temperature": "5.0", "day_of_year": "162"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> Scene:
    """Spectral cube of the embeddings: 25 columns, 64 bands."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    radiance = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 10000).cast("int"))
    fault = F.transform(
        F.sequence(F.lit(1), F.lit(64)),
        lambda b: F.when((i * 7 + b * 13) % 97 == 0, 1).when((i * 11 + b * 5) % 89 == 0, 2).otherwise(0).cast("short"),
    )
    pixels = e.select(
        F.lit("cube").alias("product_id"), F.floor(i / WIDTH).cast("int").alias("y"), (i % WIDTH).cast("int").alias("x"), radiance.alias("radiance"), fault.alias("mask"), "label", "vec_id"
    )
    return Scene(pixels, BANDS, dict(ATTRS))


def cube_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, band, value, mask of the cube."""
    from ..model import to_long

    return to_long(cube(spark, sf_dir).pixels.select("product_id", "y", "x", "radiance", "mask"))


def product_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band descriptors of the products that the labels of the embeddings stand for, with wavelengths of each one's own.

    ``band`` counts from 1000 times the label; ``n`` is the number of the product's spectra that have the band.
    """
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    b = e.groupBy("label", "at").agg(F.count("*").alias("n"))
    return b.select(
        (F.col("label") * 1000 + F.col("at") + 1).cast("int").alias("band"), F.concat(F.lit("radiance_"), (F.col("at") + 1).cast("string")).alias("name"),
        (400.0 + 10.0 * F.col("at") + F.col("label") * 0.5).alias("wavelength"), F.lit(10.0).alias("bandwidth"), F.lit(1.0).alias("scale"), F.lit("").alias("unit"), "n",
    )


def large_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster of the line items: 128 columns, 7 bands, int values; the largest projection."""
    rows = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_orderkey") % 128).cast("int"), F.floor(F.col("l_orderkey") / 128).cast("int")
    return rows.groupBy(F.lit("large").alias("product_id"), y.alias("y"), x.alias("x"), F.col("l_linenumber").alias("band")).agg(F.sum("l_quantity").cast("int").alias("value"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t (seconds), event_id, signal of the events."""
    return table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"), "event_id", F.col("value").alias("signal"))


#: DuckDB: wide cube, long cube, large raster, telemetry.
CUBE_SQL = """cube AS (
  SELECT vec_id, label, (vec_id % 25)::INTEGER AS x, (vec_id // 25)::INTEGER AS y,
    list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 10000)::INTEGER) AS radiance,
    list_transform(range(1, 65), lambda b: CASE WHEN (vec_id * 7 + b * 13) % 97 = 0 THEN 1 WHEN (vec_id * 11 + b * 5) % 89 = 0 THEN 2 ELSE 0 END) AS mask
  FROM embeddings
)"""
LONG_SQL = """long AS (
  SELECT (vec_id % 25)::INTEGER AS x, (vec_id // 25)::INTEGER AS y, vec_id, b::INTEGER AS band, floor((embedding[b]::DOUBLE + 1) * 10000)::INTEGER AS value,
    CASE WHEN (vec_id * 7 + b * 13) % 97 = 0 THEN 1 WHEN (vec_id * 11 + b * 5) % 89 = 0 THEN 2 ELSE 0 END AS mask
  FROM (SELECT *, unnest(range(1, 65)) AS b FROM embeddings)
)"""
LARGE_SQL = """large AS (
  SELECT (l_orderkey % 128)::INTEGER AS x, (l_orderkey // 128)::INTEGER AS y, l_linenumber AS band, sum(l_quantity)::INTEGER AS value
  FROM lineitem GROUP BY ALL
)"""
BANDS_SQL = """bands AS (
  SELECT b::INTEGER AS band, 400.0::DOUBLE + 10 * (b - 1) AS wl, 10.0::DOUBLE AS bw, 'radiance_' || b AS name FROM range(1, 65) t(b)
)"""
PRODUCT_BANDS_SQL = """bands AS (
  SELECT (label * 1000 + b)::INTEGER AS band, 400.0e0 + 10 * (b - 1) + label * 0.5e0 AS wl, 10.0::DOUBLE AS bw, 'radiance_' || b AS name, count(*) AS n
  FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS b FROM embeddings) GROUP BY label, b
)"""
TELEMETRY_SQL = """telemetry AS (
  SELECT user_id, epoch(date_trunc('second', ts))::DOUBLE AS t, event_id, value AS signal FROM events
)"""
