"""The atmospheric correction of one scene: optical thickness, smile, water vapour, inversion, adjacency, polishing.

The steps' results that the next ones depend on are single numbers (optical thickness, shift, mean water vapour) or at
most fifty spectra, so each is collected; pixels stay in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import radiometry as r
from ..model import Band, Scene, doubles, to_long, to_wide
from ..params import AtmosphereParams
from . import atmosphere as a
from .bands import nearest_index, valid_pixels, water_mask
from .lookups import bracket
from .statistics import box_mean, extremes, max_aot, smallest
from .tables import cut

KEYS = ("product_id", "y", "x")
#: Visible range of the dark pixels (nm), their number a band, steps of the optical thickness, scale of
#: the integers that box means are made of, first wavelengths of the bands of the vegetation index, references an end.
VISIBLE, DARK, COARSE, FINE_LAND, FINE_WATER = (420.0, 690.0), 100, 0.05, 0.005, 0.001
REFLECTANCE_SCALE, INDEX_RED, INDEX_NIR, SPIKY = 1e-4, 670.0, 785.0, 25


@dataclass(frozen=True)
class Corrected:
    """pixels: keys, reflectance and, if asked for, water_vapour; both 0 where a pixel is masked."""

    pixels: DataFrame
    aot: float
    smile_shift: float
    water_vapour: float  # mean over land, 0 if none was retrieved
    gains: np.ndarray


def kernel_of(mode: str) -> int:
    return 27 if mode == "1" else 59


def optical_thickness(rows: DataFrame, scale: float, bands: Sequence[Band], lut: a.Lut, fine: float, fly_by_zenith: float, sea: bool) -> tuple[float, np.ndarray]:
    """The scene's optical thickness and what to subtract from the path radiance; rows have keys and radiance."""
    nodes = lut.lpw @ a.resampling_weights(lut.wavelengths, bands).T  # (aot, band)
    values = F.array(*[doubles(v / scale) for v in nodes])

    def path_radiance(aot: Column, band: Column) -> Column:
        i, f = bracket(aot, lut.aot)
        at = lambda k: F.get(F.get(values, k), band - 1)
        return at(i) * (1 - f) + at(i + 1) * f

    dark = smallest(to_long(rows.select(*KEYS, "radiance"), {"radiance": "value"}), ["product_id", "band"], "value", DARK, ["y", "x"])
    visible = [b.index for b in bands if VISIBLE[0] <= b.wavelength <= VISIBLE[1]]
    found = max_aot(dark.filter(F.col("band").isin(visible)), path_radiance, lut.aot[0], COARSE, lut.aot[-1], DARK, fine=fine).first()
    aot = found["aot"] if found else lut.aot[-1]
    if aot > lut.aot[0] or abs(fly_by_zenith) < 55.0:
        return aot, np.zeros(len(bands))
    means = {x["band"]: x["mean"] * scale for x in dark.groupBy("band").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= DARK).collect()}
    wrong = np.array([nodes[0][k] - means.get(k + 1, np.inf) for k in range(len(bands))])
    if sea and np.isfinite(wrong).all():
        wl = np.array([b.wavelength for b in bands])
        terms = np.polynomial.legendre.legvander(wl, 3)
        terms = terms / np.abs(terms).max(axis=0)  # spans the same polynomials
        wrong = terms @ np.linalg.lstsq(terms, wrong, rcond=None)[0]
    return aot, np.maximum(wrong, 0.0)


def scene_shift(rows: DataFrame, scale: float, bands: Sequence[Band], lut: a.Lut, aot: float, cwv: float, solar_zenith: float, correction: np.ndarray) -> float:
    """Median of the columns' wavelength shifts; 0 without a column that has all bands."""
    means = to_long(rows.select(*KEYS, "radiance"), {"radiance": "value"}).filter("value > 0").groupBy("product_id", "x", "band").agg(F.avg("value").alias("v"))
    spectra = means.groupBy("product_id", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias("spectrum"))
    shifts = a.smile_shifts(spectra.filter(F.size("spectrum") == len(bands)), scale, bands, lut, aot, cwv, solar_zenith, correction)
    return shifts.agg(F.median("shift")).first()[0] or 0.0


def _with_vapour(rows: DataFrame, scale: float, bands: Sequence[Band], nodes: Sequence[a.Rtc], cwv: Sequence[float], initial: float) -> DataFrame:
    """``rows`` (keys, radiance, land, water) with water_vapour and reflectance where land is true, else null."""
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", water_vapour double, reflectance array<double>"
    names, count = [*rows.columns, "water_vapour", "reflectance"], len(bands)
    at, on = names.index("radiance"), names.index("land")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            land = np.asarray(batch.column(on).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            vapour, spectra = [None] * len(land), [None] * len(land)
            if land.any():
                flat = np.asarray(batch.column(at).filter(pa.array(land)).flatten(), dtype=np.float64).reshape(-1, count)
                found = a.retrieve_water_vapour(flat, scale, bands, nodes, cwv, initial)
                t = a.between_nodes(nodes, cwv, found, np.arange(count))
                rho = np.pi * (flat * scale - t["lpw"]) / t["egl"]
                rho = rho / (1 + rho * t["sab"])
                for k, w, s in zip(np.flatnonzero(land), found, rho, strict=True):
                    vapour[k], spectra[k] = float(w), s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vapour, pa.float64()), pa.array(spectra, pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, schema)


def adjacent(rows: DataFrame, ratio: Sequence[float], kernel: int) -> DataFrame:
    """``rows`` (keys, reflectance, ...) with the light scattered in from the neighbourhood taken out, in every band."""
    cells = to_long(rows.select(*KEYS, "reflectance"), {"reflectance": "rho"}).withColumn("value", (F.col("rho") / REFLECTANCE_SCALE).cast("int"))
    cells = box_mean(cells, "value", kernel)
    term = r.adjacency_term(F.col("rho"), F.col("box_mean") * REFLECTANCE_SCALE, F.get(doubles(ratio), F.col("band") - 1))
    cells = cells.select(*KEYS, "band", (F.col("rho") + term).alias("rho"))
    return rows.drop("reflectance").join(to_wide(cells, {"rho": "reflectance"}, KEYS), list(KEYS))


def reference_spectra(rows: DataFrame, bands: Sequence[Band], n: int = SPIKY) -> np.ndarray:
    """Spectra (at most 2 n) of the lowest and highest vegetation indices among all rows (keys, reflectance); none if
    no more than 2 n pixels qualify."""
    first = lambda least: next(k for k, b in enumerate(bands) if b.wavelength >= least)
    red, nir = F.get("reflectance", F.lit(first(INDEX_RED))), F.get("reflectance", F.lit(first(INDEX_NIR)))
    marked = rows.select(*KEYS, "reflectance", nir.alias("nir"), r.ndvi(nir, red).alias("ndvi")).filter("ndvi > 0.1 AND nir > 0.2 AND nir <= 0.75")
    chosen = extremes(marked, "ndvi", n, ["y", "x"]).collect()
    return np.array([x["reflectance"] for x in chosen]).reshape(-1, len(bands))


def scene_gains(rows: DataFrame, bands: Sequence[Band], endmembers: np.ndarray) -> np.ndarray:
    """Polishing gain of each band; 1 where the scene has too few reference pixels."""
    reference = reference_spectra(rows, bands)
    return a.polishing_gains(reference, endmembers, [b.wavelength for b in bands]) if len(reference) else np.ones(len(bands))


def surface_reflectances(
    scene: Scene,
    scale: float,
    lut: a.Lut,
    params: AtmosphereParams,
    endmembers: np.ndarray | None = None,
    irradiances: tuple[float, float] | None = None,
    cloud: str | None = None,
) -> Corrected:
    """All steps in order, for the pixels of one scene.

    ``irradiances`` of the sun at 688 and 780 nm tell water from land (without them all is land); ``cloud`` names a
    column of cloudiness.  An optical thickness or water vapour of 0 in ``params`` asks for the scene's own.
    """
    mode, sza, bands = scene.attrs["mode"], float(scene.attrs["solar_zenith"]), scene.bands
    if len(bands) < 18:
        raise ValueError("the correction needs 18 bands")
    if mode == "2" and irradiances is None:
        raise ValueError("mode 2 needs irradiances to find water")
    polishing = params.polishing and mode in ("1", "5")
    if polishing and endmembers is None:
        raise ValueError("polishing needs endmembers")
    initial = params.initial_water_vapour or (2.0 - 0.5) * math.sin(int(scene.attrs["day_of_year"]) // 365) + 0.5
    water = F.lit(False)
    if irradiances is not None:
        at = [F.element_at("radiance", nearest_index(bands, w)) for w in (688.0, 780.0)]
        factors = [scale * math.pi / (math.cos(math.radians(sza)) * e) for e in irradiances]
        water = water_mask(*at, *factors) == 1
    clear = F.coalesce(F.col(cloud) <= params.cloud_threshold, F.lit(True)) if cloud else F.lit(True)
    rows = scene.pixels.withColumns({"valid": valid_pixels(), "water": water, "clear": clear}).select(*KEYS, "radiance", "valid", "clear", "water")
    usable = F.col("valid") & F.col("clear")

    aot, correction = params.aot550, np.zeros(len(bands))
    if aot == 0.0:
        sea = mode == "2"
        dark = rows.filter(F.col("valid") & F.col("water") if sea else F.col("valid"))
        aot, correction = optical_thickness(dark, scale, bands, lut, FINE_WATER if sea else FINE_LAND, float(scene.attrs.get("fly_by_zenith", 0.0)), sea)
    shift = scene_shift(rows.filter(usable), scale, bands, lut, aot, initial, sza, correction) if mode in ("1", "5") else 0.0
    weights = a.resampling_weights(lut.wavelengths, bands, shift)

    def table(cwv: float) -> a.Rtc:
        t = lut.at(aot, min(max(cwv, lut.cwv[0]), lut.cwv[-1]), sza).resampled(weights)
        return a.Rtc(t.lpw - correction, t.egl, t.sab, t.rat)

    none, mean = F.array_repeat(F.lit(0.0), len(bands)), 0.0
    if mode in ("1", "3", "5"):
        marked = rows.select(*KEYS, "radiance", (usable & ~F.col("water")).alias("land"), (usable & F.col("water")).alias("water"))
        # Read by the mean, by both sides of the adjacency join and by the gains: solved once, and written.
        solved = cut(_with_vapour(marked, scale, bands, [table(w) for w in lut.cwv], lut.cwv, initial))
        mean = solved.agg(F.avg("water_vapour")).first()[0] or 0.0
        rt = table(mean)
        out = solved.select(
            *KEYS,
            F.coalesce("water_vapour", F.when(F.col("water"), F.lit(mean)), F.lit(0.0)).alias("water_vapour"),
            F.coalesce("reflectance", F.when(F.col("water"), a.invert("radiance", scale, rt)), none).alias("reflectance"),
        )
    else:
        rt = table(initial)
        out = rows.select(*KEYS, F.lit(0.0).alias("water_vapour"), F.when(usable, a.invert("radiance", scale, rt)).otherwise(none).alias("reflectance"))
        out = out.withColumn("reflectance", a.interpolate_oxygen("reflectance", bands))
    if params.adjacency:
        out = adjacent(out, rt.rat, kernel_of(mode))
    gains = scene_gains(out, bands, endmembers) if polishing else np.ones(len(bands))
    if polishing:
        out = out.withColumn("reflectance", a.polished("reflectance", gains))
    return Corrected(out.select(*KEYS, "reflectance", *["water_vapour"] * params.water_vapour_map), aot, shift, mean, gains)
