"""Readers of binary tables: two columns, and the radiative-transfer table with its seven axes.

A table is one file of a bounded size and is decoded in one task; contents arrive as a binary column, so that they
may come from any store that Spark reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.atmosphere import Rtc
from ..operators.lookups import multilinear
from .products import decode_xy_table

#: Axes of the radiative-transfer table in the file's order, and those of its two blocks, slow to fast.
AXES = ("wavelength", "vza", "sza", "alt", "aot", "ada", "cwv")
BLOCK_AXES = {"A": ("vza", "sza", "alt", "aot", "ada"), "B": ("vza", "sza", "alt", "aot", "cwv")}
#: Fixed value: factor of path radiances (block A) and of direct and diffuse fluxes (the first two values of block B).
SCALE = 1.0e4


def contents(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the files at a path."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS name", "content")


def xy_rows(files: DataFrame) -> DataFrame:
    """name, i (from 0), x, y of tables (name, content): a big-endian count, then both columns as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x, y = decode_xy_table(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x), pa.array(y)], names=["name", "i", "x", "y"])

    return files.select("name", "content").mapInArrow(run, "name string, i int, x double, y double")


def read_xy_table(spark: SparkSession, path: str) -> DataFrame:
    return xy_rows(contents(spark, path))


@dataclass(frozen=True)
class RtcTable:
    """Axes by name, and the blocks: A has path radiances, B direct and diffuse flux, albedo and ratio; a block's axes
    are those of BLOCK_AXES, then wavelength and value."""

    axes: dict[str, np.ndarray]
    blocks: dict[str, np.ndarray]

    def at(self, vza: float, sza: float, alt: float, aot: float, ada: float, cwv: float) -> Rtc:
        """By wavelength, interpolated linearly in all axes and held to them."""
        point = {"vza": vza, "sza": sza, "alt": alt, "aot": aot, "ada": ada, "cwv": cwv}
        a, b = (multilinear(self.blocks[k], [self.axes[n] for n in names], [point[n] for n in names]) for k, names in BLOCK_AXES.items())
        return Rtc(a[:, 0], b[:, 0] * np.cos(np.radians(sza)) + b[:, 1], b[:, 2], b[:, 3])

    def many(self, points: dict[str, np.ndarray]) -> Rtc:
        """``at`` for many points at once; arrays are (points, wavelengths).  Points are held to the axes; NaN gives NaN."""
        places = {n: _between(self.axes[n], np.asarray(v, dtype=np.float64)) for n, v in points.items()}
        a, b = (_corners(self.blocks[k], [places[n] for n in names]) for k, names in BLOCK_AXES.items())
        sun = np.cos(np.radians(np.asarray(points["sza"], dtype=np.float64)))[:, None]
        return Rtc(a[..., 0], b[..., 0] * sun + b[..., 1], b[..., 2], b[..., 3])

    def parts(self, points: dict[str, np.ndarray]) -> np.ndarray:
        """(value, points, wavelengths) of block B: direct and diffuse flux, albedo and ratio, as stored."""
        b = _corners(self.blocks["B"], [_between(self.axes[n], np.asarray(points[n], dtype=np.float64)) for n in BLOCK_AXES["B"]])
        return np.moveaxis(b, 2, 0)

    def in_bands(self, weights: np.ndarray) -> RtcTable:
        """The table with its wavelengths averaged to bands, by the rows of ``weights``."""
        blocks = {k: np.einsum("bw,...wv->...bv", weights, v) for k, v in self.blocks.items()}
        return RtcTable(self.axes | {"wavelength": np.arange(1.0, len(weights) + 1)}, blocks)


def _between(nodes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower node and fraction of each value; an axis of one node has fraction 0."""
    if len(nodes) == 1:
        return np.zeros(len(v), dtype=int), v * 0.0
    i = np.clip(np.searchsorted(nodes, v, side="right") - 1, 0, len(nodes) - 2)
    return i, np.clip((v - nodes[i]) / (nodes[i + 1] - nodes[i]), 0.0, 1.0)


def _corners(block: np.ndarray, places: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Multilinear values at many places: the weighted sum of each place's corner cells."""
    out: np.ndarray | float = 0.0
    for corner in range(1 << len(places)):
        weight, cell = np.ones(len(places[0][0])), []
        for k, (i, f) in enumerate(places):
            up = corner >> k & 1
            weight = weight * (f if up else 1 - f)
            cell.append(np.minimum(i + up, block.shape[k] - 1))
        out = out + weight[:, None, None] * block[tuple(cell)]
    return out


def decode_rtc(data: bytes) -> RtcTable:
    """Little-endian: each axis as a 16-bit count and floats, the blocks' numbers of values, then the blocks' floats."""
    at = 0

    def count() -> int:
        nonlocal at
        at += 2
        return int(np.frombuffer(data, "<i2", 1, at - 2)[0])

    def floats(n: int) -> np.ndarray:
        nonlocal at
        at += 4 * n
        return np.frombuffer(data, "<f4", n, at - 4 * n)

    axes = {name: floats(count()).astype(np.float64) for name in AXES}
    values = {"A": count(), "B": count()}
    blocks = {}
    for k, names in BLOCK_AXES.items():
        shape = [len(axes[n]) for n in (*names, "wavelength")] + [values[k]]
        block = floats(int(np.prod(shape))).reshape(shape).astype(np.float64)
        block[..., : 1 if k == "A" else 2] *= SCALE
        blocks[k] = block
    return RtcTable(axes, blocks)


def encode_rtc(table: RtcTable) -> bytes:
    """The inverse of ``decode_rtc``."""
    out = [struct.pack("<h", len(table.axes[n])) + table.axes[n].astype("<f4").tobytes() for n in AXES]
    out += [struct.pack("<h", table.blocks[k].shape[-1]) for k in BLOCK_AXES]
    for k in BLOCK_AXES:
        block = table.blocks[k].copy()
        block[..., : 1 if k == "A" else 2] /= SCALE
        out.append(block.astype("<f4").tobytes())
    return b"".join(out)


def rtc_rows(files: DataFrame) -> DataFrame:
    """name, block, vza, sza, alt, aot, last (ada in block A, cwv in block B) and the values by wavelength, value fastest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = decode_rtc(raw.as_py())
                for k, names in BLOCK_AXES.items():
                    grid = [g.ravel() for g in np.meshgrid(*[table.axes[n] for n in names], indexing="ij")]
                    values = table.blocks[k].reshape(len(grid[0]), -1)
                    for lo in range(0, len(values), 1000):
                        part = values[lo : lo + 1000]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                        cols = [pa.array([name] * len(part), pa.string()), pa.array([k] * len(part)), *[pa.array(g[lo : lo + 1000]) for g in grid], lists]
                        yield pa.RecordBatch.from_arrays(cols, names=["name", "block", "vza", "sza", "alt", "aot", "last", "values"])

    return files.select("name", "content").mapInArrow(run, "name string, block string, vza double, sza double, alt double, aot double, last double, values array<double>")


def read_rtc(spark: SparkSession, path: str) -> DataFrame:
    return rtc_rows(contents(spark, path))


def load_rtc(spark: SparkSession, path: str) -> RtcTable:
    """The table itself, for plans that interpolate in it; one file, read by the driver through Spark."""
    return decode_rtc(bytes(contents(spark, path).first()["content"]))
