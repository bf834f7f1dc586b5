"""Radiative-transfer tables in all their axes: values for the angles, altitude and atmosphere of each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..sources.binary_tables import AXES, RtcTable
from .atmosphere import Lut

#: Nodes of the stand-in table.
STAND_IN = {
    "vza": (0.0, 20.0, 40.0, 60.0),
    "sza": (0.0, 20.0, 40.0, 60.0),
    "alt": (0.0, 0.5, 2.0),
    "aot": (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0),
    "ada": (0.0, 60.0, 120.0, 180.0),
    "cwv": (0.3, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0),
}


def stand_in_table(lo: float = 390.0, hi: float = 1050.0, step: float = 5.0) -> RtcTable:
    """A smooth analytic table in all seven axes, with lines at 940 and 760.5 nm."""
    axes = {n: np.array(v) for n, v in STAND_IN.items()} | {"wavelength": np.arange(lo, hi + step / 2, step)}
    wl = axes["wavelength"] / 500.0

    def grid(*names: str) -> list[np.ndarray]:
        return [g[..., None] for g in np.meshgrid(*(axes[n] for n in names), indexing="ij")]

    vza, sza, alt, aot, ada = grid("vza", "sza", "alt", "aot", "ada")
    air = np.exp(-alt / 8.0)
    lpw = (0.3 * air + 1.2 * aot) * (2.0 - np.cos(np.radians(vza))) * (1 + 0.1 * np.cos(np.radians(ada))) * (1 - sza / 300.0) * wl**-2.5
    vza, sza, alt, aot, cwv = grid("vza", "sza", "alt", "aot", "cwv")
    air = np.exp(-alt / 8.0)
    line = np.exp(-(((axes["wavelength"] - 940.0) / 25.0) ** 2))
    oxygen = 1 - 0.5 * np.exp(-(((axes["wavelength"] - 760.5) / 3.0) ** 2))
    trans = np.exp(-0.25 * cwv * line) * oxygen
    direct = 120.0 * wl**-1.2 * np.exp(-0.8 * aot * (1 + sza / 100.0)) * (1 - vza / 600.0) * trans
    diffuse = 25.0 * wl**-2.0 * (0.4 * air + aot) * (1 - sza / 200.0) * trans
    sab = (0.05 * air + 0.1 * aot) / wl + 0 * trans
    rat = 0.1 + 0.5 * aot * wl**-0.5 + 0 * trans
    return RtcTable(axes, {"A": lpw[..., None], "B": np.stack((direct, diffuse, sab, rat), axis=-1)})


def lut_at(table: RtcTable, vza: float, ada: float, alt: float, sza: float) -> Lut:
    """The table of one scene, over thickness and water vapour, at its angles and altitude: what the correction reads."""
    aot, cwv = table.axes["aot"], table.axes["cwv"]
    a, v = (g.ravel() for g in np.meshgrid(aot, cwv, indexing="ij"))
    point = {"vza": vza, "sza": sza, "ada": ada, "alt": alt}
    at = table.parts({n: np.full(len(a), x) for n, x in point.items()} | {"aot": a, "cwv": v})
    shape = (len(aot), len(cwv), -1)
    path = table.many({n: np.full(len(aot), x) for n, x in point.items()} | {"aot": aot, "cwv": np.full(len(aot), cwv[0])}).lpw
    return Lut(table.axes["wavelength"], tuple(map(float, aot)), tuple(map(float, cwv)), path, np.stack([p.reshape(shape) for p in at]))


def with_table(rows: DataFrame, table: RtcTable, at: dict[str, Column]) -> DataFrame:
    """``rows`` with lpw, egl, sab and rat (arrays over the table's wavelengths or bands) at each row's own place.

    ``at`` gives the six axes; places are held to the axes.  A null or NaN anywhere gives arrays of NaN.  The table is a
    broadcast of fixed size, averaged to bands where it can be; all rows of an Arrow batch are interpolated at once, in
    pieces whose corner values stay small.
    """
    names = [n for n in AXES if n != "wavelength"]
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kept = rows.columns
    placed = rows.select(*kept, *[at[n].cast("double").alias(f"_{n}") for n in names])
    values = ("lpw", "egl", "sab", "rat")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + "".join(f", {v} array<double>" for v in values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.axes["wavelength"])
        piece = max(1, 200_000 // size)
        for batch in batches:
            for lo in range(0, batch.num_rows, piece):
                part = batch.slice(lo, piece)
                points = {n: np.asarray(part.column(len(kept) + k).to_numpy(zero_copy_only=False), dtype=np.float64) for k, n in enumerate(names)}
                good = np.all([np.isfinite(v) for v in points.values()], axis=0)
                found = shared.value.many({n: np.where(good, v, 0.0) for n, v in points.items()})
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.where(good[:, None], getattr(found, v), np.nan).ravel())) for v in values]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *lists], names=[*kept, *values])

    return placed.mapInArrow(run, schema)
