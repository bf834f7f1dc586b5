"""Scenes stored as Parquet by product, kind and band, so that bands can be read, added and replaced one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ("product_id", "kind", "band")
COLUMNS = (*KEYS, "wavelength", "y", "samples")
SCHEMA = "wavelength double, y int, samples array<double>, product_id string, kind string, band int"


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Image lines; filters on product_id, kind and band prune the store's folders."""
    return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)


def write_bands(lines: DataFrame, path: str) -> None:
    """A new store of image lines; an existing one is refused.  A band's lines go to one file, in order."""
    _sorted(lines).write.mode("errorifexists").partitionBy(*KEYS).parquet(path)


def put_bands(lines: DataFrame, path: str) -> None:
    """Replace the bands that ``lines`` have, or add them; all other bands keep their files.

    The new files are written beside the old ones and take their place when the job commits, so that a job that fails
    changes nothing, and ``lines`` may be derived from the store itself.  A band that has no line in ``lines`` stays; null
    product_id or kind are stored as such; no lines change nothing.
    """
    _sorted(lines).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def _sorted(lines: DataFrame) -> DataFrame:
    rows = lines.select("product_id", "kind", F.col("band").cast("int").alias("band"), F.col("wavelength").cast("double").alias("wavelength"), F.col("y").cast("int").alias("y"), F.col("samples").cast("array<double>").alias("samples"))
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "y")
