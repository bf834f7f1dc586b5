"""Scenes stored as a folder of band files with text headers, as pixels and bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .products import decode_samples, parse_envi_header

_FIELDS = ("samples", "lines", "data type", "byte order", "wavelength")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """stem, kind, band, samples, lines, code, byte_order, wavelength of every header; stems are `kind_band`."""
    texts = spark.read.text(f"{folder}/*.hdr", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    field = {n: F.regexp_replace(F.try_element_at("fields", F.lit(n)), r"[{}]", "") for n in _FIELDS}
    stem = F.regexp_extract("path", r"([^/]+)\.hdr$", 1)
    rows = parse_envi_header(texts).select(stem.alias("stem"), *[F.trim(c).alias(n.replace(" ", "_")) for n, c in field.items()])
    return rows.select(
        "stem",
        F.regexp_extract("stem", r"^(.*)_\d+$", 1).alias("kind"),
        F.regexp_extract("stem", r"_(\d+)$", 1).try_cast("int").alias("band"),
        *[F.col(n).try_cast("int").alias(n) for n in ("samples", "lines")],
        F.col("data_type").alias("code"),
        F.coalesce(F.col("byte_order").try_cast("int"), F.lit(0)).alias("byte_order"),
        F.col("wavelength").try_cast("double").alias("wavelength"),
    )


def read_bands(spark: SparkSession, folder: str) -> DataFrame:
    """kind, band, y, x, value of all band files of a scene; a task decodes one file, which holds one band."""
    images = spark.read.format("binaryFile").load(f"{folder}/*.img").select(F.regexp_extract("path", r"([^/]+)\.img$", 1).alias("stem"), "content")
    named = images.join(read_headers(spark, folder), "stem").select("kind", "band", "samples", "lines", "code", "byte_order", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                image = decode_samples(r["content"], r["samples"], r["lines"], r["code"], r["byte_order"])
                for y, row in enumerate(image):
                    n = r["samples"]
                    cols = [pa.array([r["kind"]] * n), *[pa.array(np.full(n, v, np.int32)) for v in (r["band"], y)], pa.array(np.arange(n, dtype=np.int32)), pa.array(row.astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", "band", "y", "x", "value"])

    return named.mapInArrow(run, "kind string, band int, y int, x int, value double")


def read_scene(spark: SparkSession, folder: str, product_id: str) -> DataFrame:
    """product_id, y, x, radiance, mask of a scene's folder, the arrays by band; a scene without masks has zeros."""
    rows = read_bands(spark, folder).groupBy("y", "x", "band").agg(
        F.max(F.when(F.col("kind") == "radiance", F.col("value"))).alias("radiance"), F.max(F.when(F.col("kind") == "mask", F.col("value"))).alias("mask")
    )
    ordered = F.array_sort(F.collect_list(F.struct("band", "radiance", F.coalesce("mask", F.lit(0.0)).alias("mask"))))
    pixels = rows.groupBy("y", "x").agg(ordered.alias("b"))  # as many values a pixel as bands
    part = lambda n, kind: F.transform("b", lambda s: s[n].cast(kind)).alias(n)
    return pixels.select(F.lit(product_id).alias("product_id"), "y", "x", part("radiance", "int"), part("mask", "short"))
