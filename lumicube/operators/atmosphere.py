"""Atmospheric correction: radiative-transfer tables, retrievals, inversion and polishing.

Tables are small and dense, so they are interpolated with numpy when a plan is built, and what remains of them, a few
numbers a band, enters the plan as literals.  Only the water-vapour retrieval needs a root a pixel; it runs on Arrow
batches, all pixels of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import radiometry as r
from ..functions.radiometry import shape_exponents
from ..model import Band, doubles
from ..numerics import minimum, roots, unmix
from .lookups import multilinear
from .smoothing import lowess

#: Nodes of the stand-in tables; of the original axes only the water-vapour nodes' number and ends are known.
CWV_NODES = (0.3, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
AOT_NODES = (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)
#: Fixed values (nm): windows of the water-vapour retrieval, the smile search, oxygen lines and the red edge.
WV_FIT, WV_END = (770.0, 890.0), 921.0
SMILE_WINDOW = (749.0, 779.0)
O2_LINES = (760.5, 687.5)
RED_EDGE = (694.7, 772.5)


@dataclass(frozen=True)
class Rtc:
    """Path radiance, global flux, spherical albedo and diffuse-to-direct ratio by band or wavelength."""

    lpw: np.ndarray
    egl: np.ndarray
    sab: np.ndarray
    rat: np.ndarray

    def resampled(self, weights: np.ndarray) -> Rtc:
        return Rtc(*(weights @ v for v in (self.lpw, self.egl, self.sab, self.rat)))


@dataclass(frozen=True)
class Lut:
    """Tables over (aot, cwv) and wavelength: path radiance, direct and diffuse flux, albedo, ratio."""

    wavelengths: np.ndarray
    aot: tuple[float, ...]
    cwv: tuple[float, ...]
    lpw: np.ndarray  # (aot, wavelength)
    parts: np.ndarray  # (4, aot, cwv, wavelength): direct, diffuse, albedo, ratio

    def at(self, aot: float, cwv: float, solar_zenith: float) -> Rtc:
        lpw = multilinear(self.lpw, (self.aot,), (aot,))
        direct, diffuse, sab, rat = (multilinear(p, (self.aot, self.cwv), (aot, cwv), log=(1,)) for p in self.parts)
        return Rtc(lpw, direct * math.cos(math.radians(solar_zenith)) + diffuse, sab, rat)


def stand_in_lut(lo: float = 390.0, hi: float = 1050.0) -> Lut:
    """Smooth analytic tables with a water-vapour line at 940 nm and an oxygen line at 760.5 nm."""
    wl = np.arange(lo, hi + 1.0)
    aot, cwv = np.array(AOT_NODES)[:, None, None], np.array(CWV_NODES)[None, :, None]
    line = np.exp(-(((wl - 940.0) / 25.0) ** 2))
    oxygen = 1 - 0.5 * np.exp(-(((wl - 760.5) / 3.0) ** 2))
    trans = np.exp(-0.25 * cwv * line) * oxygen
    direct = 120.0 * (wl / 500.0) ** -1.2 * np.exp(-0.8 * aot) * trans
    diffuse = 25.0 * (wl / 500.0) ** -2.0 * (0.4 + aot) * trans
    sab = (0.05 + 0.1 * aot) * (wl / 500.0) ** -1.0 + 0 * cwv
    rat = 0.1 + 0.5 * aot * (wl / 500.0) ** -0.5 + 0 * cwv
    lpw = (0.3 + 1.2 * aot[:, 0]) * (wl / 500.0) ** -2.5
    return Lut(wl, AOT_NODES, CWV_NODES, lpw, np.stack((direct, diffuse, sab, rat)))


def resampling_weights(table: np.ndarray, bands: Sequence[Band], shift: float = 0.0) -> np.ndarray:
    """(bands, table) weights, normalised by band, of a table's wavelengths for bands that are shifted."""
    e = np.array(shape_exponents(len(bands)))[:, None]
    width = np.array([b.bandwidth for b in bands])[:, None]
    c = (1.0 / (2.0**e * math.log(2.0))) ** (1.0 / e)
    delta = np.abs(np.array([b.wavelength for b in bands])[:, None] + shift - table[None, :])
    w = np.where(delta <= 2 * width, np.exp(-((delta / (width * c)) ** e)), 0.0)
    total = w.sum(axis=1, keepdims=True)
    return w / np.where(total > 0, total, 1.0)


def invert(radiance: str | Column, scale: float, table: Rtc, correction: Sequence[float] | None = None) -> Column:
    """Array of surface reflectances of an array of radiances."""
    lpw = table.lpw - (np.asarray(correction) if correction is not None else 0.0)
    coefficients = F.arrays_zip(doubles(lpw).alias("l"), doubles(table.egl).alias("e"), doubles(table.sab).alias("s"))
    return F.zip_with(radiance, coefficients, lambda v, c: r.lambert_inverse(v.cast("double"), scale, c["l"], c["e"], c["s"]))


def forward(reflectance: str | Column, scale: float, table: Rtc) -> Column:
    coefficients = F.arrays_zip(doubles(table.lpw).alias("l"), doubles(table.egl).alias("e"), doubles(table.sab).alias("s"))
    return F.zip_with(reflectance, coefficients, lambda v, c: r.lambert_forward(v, scale, c["l"], c["e"], c["s"]))


def interpolate_oxygen(reflectance: str, bands: Sequence[Band], tolerance: float = 1.5) -> Column:
    """Bands at an oxygen line are replaced by the linear interpolation of their neighbours."""
    out = F.col(reflectance)
    for line in O2_LINES:
        for k in range(1, len(bands) - 1):
            b = bands[k]
            if abs(b.wavelength - line) < tolerance:
                f = (b.wavelength - bands[k - 1].wavelength) / (bands[k + 1].wavelength - bands[k - 1].wavelength)
                value = (1 - f) * F.element_at(reflectance, k) + f * F.element_at(reflectance, k + 2)
                out = _replaced(out, k, value)
    return out


def _replaced(array: Column, at: int, value: Column) -> Column:
    return F.transform(array, lambda v, i: F.when(i == at, value).otherwise(v))


def path_radiance_correction(aot: float, least: float, view_zenith: float, lpw: Sequence[float], dark_means: Sequence[float]) -> list[float]:
    """What to subtract from the path radiance when the retrieval is stuck at its least value in an oblique view."""
    if aot > least or abs(view_zenith) < 55.0:
        return [0.0] * len(lpw)
    return [max(0.0, a - b) for a, b in zip(lpw, dark_means, strict=True)]


def _window(bands: Sequence[Band], lo: float, hi: float) -> np.ndarray:
    return np.array([k for k, b in enumerate(bands) if lo <= b.wavelength <= hi], dtype=int)


def between_nodes(nodes: Sequence[Rtc], cwv: Sequence[float], w: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of each pixel's water vapour (pixels, bands ``at``), linear in its logarithm between the nodes."""
    log, x = np.log(np.asarray(cwv)), np.log(np.clip(w, cwv[0], cwv[-1]))
    i = np.clip(np.searchsorted(log, x, side="right") - 1, 0, len(log) - 2)
    f = np.clip((x - log[i]) / (log[i + 1] - log[i]), 0, 1)[:, None]
    stacked = {n: np.stack([getattr(t, n)[at] for t in nodes]) for n in ("lpw", "egl", "sab")}
    return {n: (1 - f) * v[i] + f * v[i + 1] for n, v in stacked.items()}


def retrieve_water_vapour(radiance: np.ndarray, scale: float, bands: Sequence[Band], nodes: Sequence[Rtc], cwv: Sequence[float], initial: float) -> np.ndarray:
    """Water vapour of each pixel (pixels, bands): the value at which simulated and measured radiances of the line's
    bands have the same sum; the reflectance there continues a line fitted beside it.  Held within the nodes."""
    wl = np.array([b.wavelength for b in bands])
    fit, used = _window(bands, *WV_FIT), _window(bands, WV_FIT[0], WV_END)
    line = used[wl[used] > WV_FIT[1]]
    if len(fit) < 2 or not len(line):
        raise ValueError("no bands at or beside the water vapour line")
    t = between_nodes(nodes, cwv, np.full(len(radiance), initial), fit)
    a = np.pi * (radiance[:, fit] * scale - t["lpw"]) / t["egl"]
    rho = a / (1 + a * t["sab"])
    x = wl[fit] - wl[fit].mean()
    slope = (rho * x).sum(axis=1) / (x * x).sum()
    surface = rho.mean(axis=1)[:, None] + slope[:, None] * (wl[line] - wl[fit].mean())
    measured = (radiance[:, line] * scale).sum(axis=1)

    def difference(w: np.ndarray) -> np.ndarray:
        c = between_nodes(nodes, cwv, w, line)
        return measured - (c["lpw"] + surface * c["egl"] / (np.pi * (1 - c["sab"] * surface))).sum(axis=1)

    return roots(difference, np.full(len(radiance), cwv[0]), np.full(len(radiance), cwv[-1]))


def with_water_vapour(pixels: DataFrame, scale: float, bands: Sequence[Band], lut: Lut, aot: float, solar_zenith: float, initial: float, keys: Sequence[str] = ("product_id", "y", "x")) -> DataFrame:
    """keys, water_vapour of pixels (keys, radiance), all pixels of an Arrow batch at once."""
    weights = resampling_weights(lut.wavelengths, bands)
    nodes = [lut.at(aot, w, solar_zenith).resampled(weights) for w in lut.cwv]
    schema = ", ".join(f"{n} {t}" for n, t in pixels.select(*keys).dtypes) + ", water_vapour double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(len(keys)).flatten(), dtype=np.float64).reshape(-1, len(bands))
            found = retrieve_water_vapour(flat, scale, bands, nodes, lut.cwv, initial) if len(flat) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found)], names=[*keys, "water_vapour"])

    return pixels.select(*keys, "radiance").mapInArrow(run, schema)


def smile_shift(mean: np.ndarray, scale: float, bands: Sequence[Band], lut: Lut, aot: float, cwv: float, solar_zenith: float, most: float = 10.0, correction: np.ndarray | None = None) -> float:
    """Wavelength shift of one detector column under which its mean reflectance about the oxygen line is smoothest."""
    at = _window(bands, *SMILE_WINDOW)
    near = np.arange(max(0, at[0] - 4), min(len(bands), at[-1] + 5))
    use = [bands[k] for k in near]
    table = lut.at(aot, cwv, solar_zenith)
    less = np.asarray(correction)[near] if correction is not None else 0.0

    def roughness(shift: float) -> float:
        t = table.resampled(resampling_weights(lut.wavelengths, use, shift))
        a = np.pi * (mean[near] * scale - t.lpw + less) / t.egl
        rho = a / (1 + a * t.sab)
        smooth = lowess(rho, 0, min(9, len(rho)), 2)
        inner = np.isin(near, at)
        return float(((smooth - rho)[inner] ** 2).sum())

    return minimum(roughness, -most, 0.0, most)


def smile_shifts(column_means: DataFrame, scale: float, bands: Sequence[Band], lut: Lut, aot: float, cwv: float, solar_zenith: float, correction: np.ndarray | None = None) -> DataFrame:
    """product_id, x, shift of the columns' mean spectra (product_id, x, spectrum); the scene's shift is their median."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [smile_shift(np.asarray(v.as_py(), dtype=np.float64), scale, bands, lut, aot, cwv, solar_zenith, correction=correction) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["product_id", "x", "shift"])

    return column_means.select("product_id", "x", "spectrum").mapInArrow(run, "product_id string, x int, shift double")


def polishing_gains(spectra: np.ndarray, endmembers: np.ndarray, wavelengths: Sequence[float]) -> np.ndarray:
    """Gain of each band that takes reference spectra (pixels, bands) to their smooth counterparts.

    A smooth counterpart is the best combination of the endmembers (bands, 3); the gain of a band is one over the
    slope of the spectra against it.  In the red edge, the gain keeps only its deviation from a smooth curve.
    """
    c = np.linalg.lstsq(endmembers, spectra.T, rcond=None)[0]
    smooth = (endmembers @ c).T
    slope = (spectra * smooth).sum(axis=0) / (smooth * smooth).sum(axis=0)
    gains = 1.0 / slope
    wl = np.asarray(wavelengths)
    edge = (wl >= RED_EDGE[0]) & (wl <= RED_EDGE[1])
    if edge.sum() >= 5:
        gains[edge] = 1.0 + gains[edge] - lowess(gains[edge], 0, 5, 0)  # of the red edge alone
    return gains


def polished(reflectance: str, gains: Sequence[float]) -> Column:
    return F.zip_with(reflectance, doubles(gains), lambda v, g: v * g)


def abundances(rows: DataFrame, keys: Sequence[str], spectrum: str, endmembers: np.ndarray) -> DataFrame:
    """keys, abundance (array): fully constrained unmixing of each row's spectrum.

    A null spectrum has a null abundance, one with a null or another value that isn't finite has NaN.
    """
    schema = ", ".join(f"{n} {t}" for n, t in rows.select(*keys).dtypes) + ", abundance array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.flatnonzero(np.asarray(batch.column(len(keys)).is_valid()))
            flat = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            found = np.full(batch.num_rows, None, dtype=object)
            for row, shares in zip(there, unmix(flat.reshape(-1, len(endmembers)), endmembers), strict=True):
                found[row] = shares
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.list_(pa.float64()))], names=[*keys, "abundance"])

    return rows.select(*keys, spectrum).mapInArrow(run, schema)
