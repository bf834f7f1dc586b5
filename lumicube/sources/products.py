"""Readers and writers: products, band headers, telemetry, control points, and metadata helpers.

All readers go through Spark's file sources, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Columns of the GPS telemetry (x, y, z, week, seconds, velocity) and of the image-centre times.
GPS_COLUMNS = {"x": 3, "y": 5, "z": 7, "week": 9, "seconds": 11, "vx": 13, "vy": 15, "vz": 17}
ICT_COLUMNS = {"ict1": 5, "ict2": 7, "ict3": 9, "ict4": 11, "ict5": 13}
ICT_PACKET = "+G:29494"
#: Lines that are put in order in one group.
BLOCK_LINES = 1 << 16
#: ENVI type codes.
ENVI_TYPES = {"1": "u1", "2": "i2", "3": "i4", "4": "f4", "5": "f8", "12": "u2"}


# Telemetry --------------------------------------------------------------------------------------------------


def telemetry_fields(lines: DataFrame, order: str) -> DataFrame:
    """``order`` and the trimmed tab-separated fields of lines (value) that are neither blank nor start with TIME."""
    kept = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("TIME"))
    return kept.select(order, F.transform(F.split("value", "\t", -1), lambda f: F.trim(f)).alias("fields"))


def parse_gps(lines: DataFrame, order: str = "line") -> DataFrame:
    """line, x, y, z (m), week, seconds, vx, vy, vz (m/s); a record whose seconds repeat those before it is dropped."""
    at = lambda i: F.get("fields", F.lit(i))
    rows = telemetry_fields(lines, order).withColumn("_block", F.floor(F.col(order) / BLOCK_LINES))
    seconds = F.struct(at(GPS_COLUMNS["seconds"]).alias("s"))
    # Within a block the record before, and for a block's first the last one of the block before: a row a block.
    ends = rows.groupBy("_block").agg(F.max_by(seconds, order).alias("_end"))
    ends = ends.select("_block", F.lag("_end").over(Window.orderBy("_block")).alias("_end"))
    rows = rows.withColumn("_own", F.lag(seconds).over(Window.partitionBy("_block").orderBy(order))).join(F.broadcast(ends), "_block")
    rows = rows.filter(~F.coalesce("_own", "_end")["s"].eqNullSafe(at(GPS_COLUMNS["seconds"])))
    return rows.select(order, *[at(i).try_cast("int" if n == "week" else "double").alias(n) for n, i in GPS_COLUMNS.items()])


def parse_ict(lines: DataFrame, order: str = "line") -> DataFrame:
    """One row with ict1 to ict5: the last record whose first packet field starts with the packet's name."""
    rows = telemetry_fields(lines, order).filter(F.get("fields", F.lit(4)).startswith(ICT_PACKET))
    last = rows.agg(F.max_by("fields", order).alias("fields")).filter("fields IS NOT NULL")
    return last.select(*[F.get("fields", F.lit(i)).try_cast("double").alias(n) for n, i in ICT_COLUMNS.items()])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value of one small text file."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n", -1)).alias("line", "value"))
    return text


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    return parse_gps(numbered_lines(spark, path))


def read_ict(spark: SparkSession, path: str) -> DataFrame:
    return parse_ict(numbered_lines(spark, path))


def telemetry_patterns(target: str, date: str) -> str:
    """Pattern of the centre-time file of a target and image date (yyyy-mm-dd); group 1 is the reference number."""
    return rf"Pass\d+\.{re.escape(target)}_(\d+)_CHRIS_center_times_{date.replace('-', '')}_\d+"


def telemetry_pairs(files: DataFrame, target: str, date: str) -> DataFrame:
    """ict, gps: file names (name) that belong together by the reference number."""
    ref = F.regexp_extract("name", telemetry_patterns(target, date), 1)
    ict = files.select(F.col("name").alias("ict"), ref.alias("ref")).filter("ref <> ''")
    gps = files.select(F.col("name").alias("gps"), F.regexp_extract("name", r"CHRIS_(\d+)_\d+_PROBA1_GPS_Data", 1).alias("ref")).filter("ref <> ''")
    return ict.join(gps, "ref").select("ict", "gps")


def match_telemetry(files: DataFrame, target: str, date: str) -> DataFrame:
    """The first pair by name."""
    return telemetry_pairs(files, target, date).orderBy("ict", "gps").limit(1)


def find_telemetry(spark: SparkSession, folder: str, target: str, date: str) -> DataFrame:
    """The same over a folder and its subfolders; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return match_telemetry(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")), target, date)


# Control points ---------------------------------------------------------------------------------------------


def parse_altitude(description: Column, default: Column) -> Column:
    """Altitude (km) of a description with `(alt... = v)`; values above 10 are metres; else the default."""
    v = F.regexp_extract(description, r"\(\s*alt[^=]*=\s*([-+0-9.eE]+)\s*\)", 1).try_cast("double")
    return F.when(v.isNull(), default).when(v > 10, v / 1000.0).otherwise(v)


def control_points(placemarks: DataFrame, target_altitude: float) -> DataFrame:
    """name, x, y, lon, lat, alt of placemarks (name, lat, lon, pixel_x, pixel_y, description); incomplete ones go."""
    alt = parse_altitude(F.col("description"), F.lit(target_altitude))
    out = placemarks.select("name", F.col("pixel_x").alias("x"), F.col("pixel_y").alias("y"), "lon", "lat", alt.alias("alt"))
    return out.dropna()


def parse_placemarks(texts: DataFrame) -> DataFrame:
    """Placemarks of XML texts (value): name, lat, lon, pixel_x, pixel_y, description."""
    item = texts.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark\b.*?</Placemark>"), F.lit(0))).alias("p"))
    tag = lambda t: F.regexp_extract("p", rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1)
    name = F.regexp_extract("p", r'<Placemark\b[^>]*\bname="([^"]*)"', 1)
    n = lambda t: tag(t).try_cast("double")
    return item.select(name.alias("name"), n("LATITUDE").alias("lat"), n("LONGITUDE").alias("lon"), n("PIXEL_X").alias("pixel_x"), n("PIXEL_Y").alias("pixel_y"), tag("DESCRIPTION").alias("description"))


# Bands and tables -------------------------------------------------------------------------------------------


def parse_envi_header(texts: DataFrame) -> DataFrame:
    """path, fields (map of lower-case names) of header texts (path, value)."""
    lines = F.filter(F.split("value", "\r?\n", -1), lambda s: s.contains("="))
    pair = lambda s: F.struct(F.lower(F.trim(F.substring_index(s, "=", 1))), F.trim(F.regexp_replace(s, r"^[^=]*=", "")))
    return texts.select("path", F.map_from_entries(F.transform(lines, pair)).alias("fields"))


def decode_samples(data: bytes, samples: int, lines: int, code: str, byte_order: int) -> np.ndarray:
    """(lines, samples) of one band's raw bytes."""
    kind = np.dtype((">" if byte_order else "<") + ENVI_TYPES[code])
    return np.frombuffer(data, dtype=kind, count=samples * lines).reshape(lines, samples)


def read_envi_band(spark: SparkSession, header: str, image: str) -> DataFrame:
    """y, x, value of one band file; a task decodes one file, which holds one band of one scene."""
    text = spark.read.text(header, wholetext=True).select(F.lit(header).alias("path"), "value")
    f = parse_envi_header(text).first()["fields"]
    samples, lines, code, order = int(f["samples"]), int(f["lines"]), f["data type"], int(f.get("byte order", "0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for y, row in enumerate(decode_samples(raw.as_py(), samples, lines, code, order)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(samples, y, np.int32)), pa.array(np.arange(samples, dtype=np.int32)), pa.array(row.astype(np.float64))], names=["y", "x", "value"]
                    )

    return spark.read.format("binaryFile").load(image).select("content").mapInArrow(run, "y int, x int, value double")


def decode_xy_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Abscissae and ordinates of a table: big-endian count, then both columns as doubles."""
    (n,) = struct.unpack(">i", data[:4])
    both = np.frombuffer(data, dtype=">f8", count=2 * n, offset=4).astype(np.float64)
    return both[:n], both[n:]


def parse_endmembers(lines: DataFrame) -> DataFrame:
    """wavelength (nm), vegetation, soil of lines (value) with three columns, the first in micrometres."""
    f = F.split(F.trim("value"), r"\s+", -1)
    out = lines.select(*[F.get(f, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("wavelength", "vegetation", "soil"))])
    return out.dropna().withColumn("wavelength", F.col("wavelength") * 1000.0)


# Products ---------------------------------------------------------------------------------------------------


def same_set(name: Column, other: str) -> Column:
    """Product names of one acquisition set: the `_`-separated fields 0, 1, 2 and 4 agree."""
    f, g = F.split(name, "_", 5), other.split("_", 4)
    out = F.size(f) == 5
    for k in (0, 1, 2, 4):
        out &= F.get(f, F.lit(k)) == (g[k] if k < len(g) else "")
    return out


def acquisition_set(products: DataFrame, name: str, kind: str) -> DataFrame:
    """Distinct products (name, type) of the set of a product, sorted by name."""
    return products.filter(same_set(F.col("name"), name) & (F.col("type") == kind)).dropDuplicates(["name"]).orderBy("name")


def validate_set(names: list[str], kinds: list[str], most: int = 5) -> None:
    """Raise unless the products are at most ``most``, unique, of one accepted type and of one set."""
    from ..operators.bands import accepts

    if len(names) > most:
        raise ValueError(f"an acquisition set has {most} products at most")
    if len(set(names)) < len(names):
        raise ValueError("a product is there twice")
    if any(not accepts("noise_reduction", k) for k in kinds) or len(set(kinds)) > 1:
        raise ValueError("products must have one type that noise reduction accepts")
    keys = {tuple(n.split("_", 4)[k] for k in (0, 1, 2, 4)) for n in names if n.count("_") >= 4}
    if len(keys) != 1 or any(n.count("_") < 4 for n in names):
        raise ValueError("products must belong to one acquisition set")


def target_path(template: str, source: str) -> str:
    """A path template with ${sourceName} filled in."""
    return template.replace("${sourceName}", source)


def write_product(pixels: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, one folder a product; an existing path is refused unless it may be overwritten."""
    pixels.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("product_id").parquet(path)


def read_product(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Metadata ---------------------------------------------------------------------------------------------------


def annotation(attrs: str, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.col(attrs), F.lit(name)), F.lit(default))


def annotation_double(attrs: str, name: str, default: float | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.col(attrs), F.lit(name)).try_cast("double"), F.lit(default))


def annotation_int(attrs: str, name: str, start: int = 0, end: int | None = None) -> Column:
    """Integer in a part of the text, from ``start`` (0) to before ``end``."""
    v = F.try_element_at(F.col(attrs), F.lit(name))
    part = F.substring(v, start + 1, (end - start) if end is not None else 1 << 20)
    return F.trim(part).try_cast("int")


def with_annotation(attrs: str, name: str, value: Column) -> Column:
    """The map with one entry set."""
    kept = F.map_filter(F.col(attrs), lambda k, _: k != name)
    return F.map_concat(kept, F.create_map(F.lit(name), value))
