"""Queries: binary tables, time-table choice, text forms, and the mixture with full covariances."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import formats
from ..operators import mixture
from ..registry import register
from ..sources import binary_tables, time_tables
from ..sources.testdata import table
from .catalog_cluster import FEATURES, points
from .catalog_cluster import _POINTS_SQL as POINTS_SQL


def _xy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table a vector: wavelengths against components, in the file's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column(1).to_pylist():
                made.append(struct.pack(">i", len(v)) + (400.0 + 10.0 * np.arange(len(v))).astype(">f8").tobytes() + np.asarray(v).astype(">f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["name", "content"])

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "name string, content binary")


@register("scan_xy_table", "SELECT vec_id::VARCHAR AS name, (b - 1)::INTEGER AS i, 400.0e0 + 10 * (b - 1) AS x, round(embedding[b]::DOUBLE, 9) AS y FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS b FROM embeddings)")
def scan_xy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_tables.xy_rows(_xy_files(spark, sf_dir)).select("name", "i", "x", F.round("y", 9).alias("y"))


_AXES = {"wavelength": [400.0, 500.0, 600.0], "vza": [0.0, 10.0], "sza": [20.0, 40.0], "alt": [0.0, 1.0], "aot": [0.125, 0.25], "ada": [0.0, 90.0], "cwv": [0.5, 1.0, 2.0]}


def rtc_stand_in() -> binary_tables.RtcTable:
    """A small table whose values number the places of its blocks."""
    axes = {k: np.array(v) for k, v in _AXES.items()}
    blocks = {}
    for k, names in binary_tables.BLOCK_AXES.items():
        shape = [len(axes[n]) for n in (*names, "wavelength")] + [1 if k == "A" else 4]
        block = np.arange(np.prod(shape), dtype=np.float64).reshape(shape) / 1024
        block[..., : 1 if k == "A" else 2] *= binary_tables.SCALE
        blocks[k] = block
    return binary_tables.RtcTable(axes, blocks)


def _rtc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each label of the vectors: the stand-in's stored values, plus the number of the label's vectors."""
    t = rtc_stand_in()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n in batch.column(1).to_pylist():
                blocks = {k: b + n * np.where(np.arange(b.shape[-1]) < (1 if k == "A" else 2), binary_tables.SCALE, 1.0) for k, b in t.blocks.items()}
                made.append(binary_tables.encode_rtc(binary_tables.RtcTable(t.axes, blocks)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["name", "content"])

    counts = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("name")).agg((F.count("*") % 1000).alias("n"))
    return counts.mapInArrow(run, "name string, content binary")


def _rtc_sql(block: str, values: int) -> str:
    names = binary_tables.BLOCK_AXES[block]
    axes = ", ".join(f"(SELECT unnest(range({len(_AXES[n])})) AS i{k}, unnest({_AXES[n]})::DOUBLE AS v{k})" for k, n in enumerate((*names, "wavelength")))
    place = "0"
    for k, n in enumerate((*names, "wavelength")):
        place = f"({place} * {len(_AXES[n])} + i{k})"
    scaled = 1 if block == "A" else 2
    return (
        f"SELECT name, '{block}' AS block, v0 AS vza, v1 AS sza, v2 AS alt, v3 AS aot, v4 AS last, v5 AS wavelength, p::INTEGER AS value_index, "
        f"(({place} * {values} + p) / 1024.0e0 + n) * CASE WHEN p < {scaled} THEN 10000 ELSE 1 END AS value FROM {axes}, range({values}) q(p), (SELECT label::VARCHAR AS name, count(*) % 1000 AS n FROM embeddings GROUP BY 1)"
    )


@register("scan_rtc_lut", f"{_rtc_sql('A', 1)} UNION ALL {_rtc_sql('B', 4)}")
def scan_rtc_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the tables with its place on the seven axes."""
    rows = binary_tables.rtc_rows(_rtc_files(spark, sf_dir)).select("name", "block", "vza", "sza", "alt", "aot", "last", F.posexplode("values").alias("pos", "value"))
    n = F.when(F.col("block") == "A", 1).otherwise(4)
    wavelength = F.get(F.array(*[F.lit(w) for w in _AXES["wavelength"]]), F.floor(F.col("pos") / n).cast("int"))
    return rows.select("name", "block", "vza", "sza", "alt", "aot", "last", wavelength.alias("wavelength"), (F.col("pos") % n).cast("int").alias("value_index"), "value")


_FILES_SQL = "files AS (SELECT event_type AS name, CASE WHEN event_id % 3 = 0 AND event_type <> (SELECT min(event_type) FROM events) THEN 'user' ELSE 'bundled' END AS origin, event_id::VARCHAR AS path, ts AS modified FROM events), now AS (SELECT max(ts) AS t FROM events)"


@register(
    "update_time_tables",
    f"WITH {_FILES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (origin = 'user') DESC, modified DESC, path) AS n FROM files) "
    "SELECT name, path, NOT (origin = 'user' AND epoch_us(t) - epoch_us(modified) <= 604800000000) AS outdated FROM ranked, now WHERE n = 1",
)
def update_time_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which copy of each table is read, and whether it is outdated, the events being copies of tables."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.max("ts").alias("now"), F.min("event_type").alias("first")).first()
    origin = F.when((F.col("event_id") % 3 == 0) & (F.col("event_type") != ends["first"]), "user").otherwise("bundled")
    files = e.select(F.col("event_type").alias("name"), origin.alias("origin"), F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modified"))
    return time_tables.chosen_tables(files, F.lit(ends["now"]))


@register("merge_time_tables", "WITH a AS (SELECT vec_id AS k, label::DOUBLE AS v FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS k, label + 0.5e0 AS v FROM embeddings WHERE vec_id % 3 = 0) SELECT k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (k)")
def merge_time_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    old = rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("k"), F.col("label").cast("double").alias("v"))
    new = rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("k"), (F.col("label") + 0.5).alias("v"))
    return time_tables.updated(old, new, "k", "v")


@register("three_decimals", "SELECT event_id, printf('%.3f', value) AS text FROM events")
def three_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", formats.three_decimals(F.col("value")).alias("text"))


_LAT, _LON = "(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 125.0e0 END)", "(c_acctbal / 60.0e0)"


def _dms(v: str, ends: str) -> str:
    s = f"round(abs({v}) * 3600)::BIGINT"
    return f"""printf('%d°%02d''%02d"', {s} // 3600, {s} // 60 % 60, {s} % 60) || CASE WHEN {v} < 0 THEN ' {ends[1]}' ELSE ' {ends[0]}' END"""


@register("geographic_coordinates", f"SELECT c_custkey, CASE WHEN {_LAT} IS NULL THEN 'not available' ELSE {_dms(_LAT, 'NS')} || ', ' || {_dms(_LON, 'EW')} END AS text FROM customer")
def geographic_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 125.0)
    return table(spark, sf_dir, "customer").select("c_custkey", formats.coordinates(lat, F.col("c_acctbal") / 60.0, F.lit("not available")).alias("text"))


_SCALED = ", ".join(f"({f} - min({f}) OVER ()) / CASE WHEN max({f}) OVER () > min({f}) OVER () THEN max({f}) OVER () - min({f}) OVER () ELSE 1 END AS {f}" for f in FEATURES)
_SCALED_SQL = f"{POINTS_SQL}, scaled AS (SELECT vec_id, {_SCALED} FROM points)"


@register("normalise_features", f"WITH {_SCALED_SQL} SELECT vec_id, {', '.join(f'round({f}, 9) AS {f}' for f in FEATURES)} FROM scaled")
def normalise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.normalised(points(spark, sf_dir), FEATURES).select("vec_id", *[F.round(f, 9).alias(f) for f in FEATURES])


#: Clusters and iterations of the k-means query; its first centres are the pixels with the smallest numbers.
CLUSTERS, STEPS = 4, 3


def _kmeans_sql() -> str:
    ctes = [f"k0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS k, {', '.join(FEATURES)} FROM scaled ORDER BY vec_id LIMIT {CLUSTERS})"]
    away = " + ".join(f"(s.{f} - c.{f}) * (s.{f} - c.{f})" for f in FEATURES)
    for n in range(1, STEPS + 1):
        ctes.append(f"n{n} AS (SELECT s.vec_id, arg_min(c.k, {away}) AS k FROM scaled s, k{n - 1} c GROUP BY s.vec_id)")
        ctes.append(f"k{n} AS (SELECT c.k, {', '.join(f'coalesce(m.{f}, c.{f}) AS {f}' for f in FEATURES)} FROM k{n - 1} c LEFT JOIN (SELECT k, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM n{n} JOIN scaled USING (vec_id) GROUP BY k) m ON m.k = c.k)")
    return ", ".join(ctes)


@register("kmeans_start", f"WITH {_SCALED_SQL}, {_kmeans_sql()} SELECT k, {', '.join(f'round({f}, 8) AS {f}' for f in FEATURES)} FROM k{STEPS}")
def kmeans_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.normalised(points(spark, sf_dir), FEATURES)
    first = np.array(rows.orderBy("vec_id").limit(CLUSTERS).select(*FEATURES).collect())
    made = mixture.kmeans(rows, FEATURES, first, STEPS)
    out = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(made)], "k int, " + ", ".join(f"{f} double" for f in FEATURES))
    return out.select("k", *[F.round(f, 8).alias(f) for f in FEATURES])


@register("find_full_mixture")
def find_full_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors, means and covariances after k-means and expectation-maximisation; iterative, held against numpy in the tests."""
    rows = mixture.normalised(points(spark, sf_dir), FEATURES)
    found = mixture.find_mixture(rows, FEATURES, ["vec_id"], CLUSTERS, 10, 20)
    out = [(k, float(g.prior), g.mean.tolist(), g.covariance.ravel().tolist()) for k, g in enumerate(found)]
    return spark.createDataFrame(out, "k int, prior double, mean array<double>, covariance array<double>")
