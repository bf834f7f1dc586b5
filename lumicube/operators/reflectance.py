"""Top-of-atmosphere reflectance and the features for cloud screening."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import radiometry as r
from ..model import Band, Scene, doubles, picked
from .bands import categorized

#: Reflectances are stored as 16-bit integers of this size.
REFLECTANCE_SCALE = 1e-4
#: Fixed values (nm): absorption line, the interval of its band, and the intervals of the bands beside it.
OXYGEN = (760.625, 755.0, 770.0, 738.0, 755.0, 770.0, 788.0)
WATER_VAPOUR = (944.376, 895.0, 960.0, 865.0, 890.0, 985.0, 1100.0)


def band_averages(table: DataFrame, bands: DataFrame) -> DataFrame:
    """band, average of a table (x, y) over each band with bell weights within one bandwidth.

    A range join with at most 62 broadcast bands; the sums are partial aggregates.
    """
    delta = F.col("x") - F.col("wavelength")
    near = table.join(F.broadcast(bands.select("band", "wavelength", "bandwidth")), (delta > -F.col("bandwidth")) & (delta <= F.col("bandwidth")))
    w = r.bell_weight(delta, F.col("bandwidth"))
    return near.groupBy("band").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("average"))


def toa_factors(irradiances: DataFrame, solar_zenith: float, day_of_year: int) -> DataFrame:
    """band, factor from radiance to reflectance; ``irradiances`` has band and average."""
    corrected = F.col("average") * r.solar_irradiance_correction(F.lit(day_of_year))
    return irradiances.select("band", r.toa_factor(solar_zenith, corrected).alias("factor"))


def toa_reflectances(scene: Scene, solar: DataFrame, bands: DataFrame, copy_radiance: bool = False) -> DataFrame:
    """Pixels with toa_refl (array of 16-bit integers, times 1e-4), mask and, if asked for, radiance.

    The factors, one number a band, are hoisted into the plan.  What 16 bits can't hold becomes null.
    """
    attrs = scene.attrs
    rows = toa_factors(band_averages(solar, bands), float(attrs["solar_zenith"]), int(attrs["day_of_year"])).collect()
    factors = dict((x["band"], x["factor"]) for x in rows)
    ordered = doubles([factors[b.index] for b in scene.bands])
    refl = F.zip_with("radiance", ordered, lambda v, f: r.round_half_up_int(v * f / REFLECTANCE_SCALE, "smallint"))
    keep = [c for c in scene.pixels.columns if c not in ("radiance", "mask")]
    return scene.pixels.select(*keep, refl.alias("toa_refl"), "mask", *(["radiance"] if copy_radiance else []))


def with_surface_features(rows: DataFrame, values: str, bands: Sequence[Band]) -> DataFrame:
    """``rows`` with brightness and whiteness over all, visible and near-infrared absorption-free bands of an array.

    Only the bands of a group enter it.  Spectra, then brightness, then whiteness are projections of their own, as
    each is used many times by the next.
    """
    keep, groups = rows.columns, (("all", ""), ("vis", "_vis"), ("nir", "_nir"))
    of = categorized(bands)
    wl = {g: [b.wavelength for b in of[g]] for g, _ in groups}
    if any(len(w) < 2 for w in wl.values()):
        raise ValueError("a group needs two bands")
    rows = rows.withColumns({f"_v{s}": F.transform(picked(values, [b.index for b in of[g]]), lambda x: x * REFLECTANCE_SCALE) for g, s in groups})
    rows = rows.withColumns({f"brightness{s}": r.brightness(wl[g], F.col(f"_v{s}")) for g, s in groups})
    rows = rows.withColumns({f"whiteness{s}": r.whiteness(wl[g], F.col(f"_v{s}"), F.col(f"brightness{s}")) for g, s in groups})
    return rows.select(*keep, *[f"{n}{s}" for _, s in groups for n in ("brightness", "whiteness")])


def _strict(bands: Sequence[Band], lo: float, hi: float) -> list[Band]:
    return [b for b in bands if b.wavelength - b.bandwidth / 2 > lo and b.wavelength + b.bandwidth / 2 < hi]


class Interpolator:
    """The band of an absorption line and the linear interpolation between the bands beside it."""

    def __init__(self, bands: Sequence[Band], spec: tuple[float, ...]):
        inner = _strict(bands, spec[1], spec[2])
        self.inf, self.sup = _strict(bands, spec[3], spec[4]), _strict(bands, spec[5], spec[6])
        if not inner or not self.inf and not self.sup:
            raise ValueError(f"no bands at or beside {spec[0]} nm")
        self.inner = min(inner, key=lambda b: (abs(b.wavelength - spec[0]), b.index))
        mean = lambda of: sum(b.wavelength for b in of) / len(of)
        self.weight = (self.inner.wavelength - mean(self.inf)) / (mean(self.sup) - mean(self.inf)) if self.inf and self.sup else 0.0

    def value(self, values: str) -> Column:
        mean = lambda of: sum((F.element_at(values, b.index) for b in of), F.lit(0.0)) / len(of)
        if not self.inf:
            return mean(self.sup)
        if not self.sup:
            return mean(self.inf)
        return (1.0 - self.weight) * mean(self.inf) + self.weight * mean(self.sup)


def atmospheric_features(values: str, bands: Sequence[Band], transmittance: dict[int, float], solar_zenith: float, view_zenith: float) -> dict[str, Column]:
    """Optical paths of oxygen (o2) and water vapour (wv); ``transmittance`` is by band index."""
    mu = r.air_mass(solar_zenith, view_zenith)
    out = {}
    for name, spec in (("o2", OXYGEN), ("wv", WATER_VAPOUR)):
        at = Interpolator(bands, spec)
        out[name] = r.optical_path(F.element_at(values, at.inner.index), at.value(values), mu, transmittance[at.inner.index])
    return out


def solar_stand_in(spark) -> DataFrame:
    """x (nm), y: spectrum of a black body of 5772 K, a stand-in for the solar irradiance table."""
    x = (F.col("id") + 200).cast("double")
    return spark.range(2201).select(x.alias("x"), (8.6e18 / (x * x * x * x * x) / (F.exp(2492.7 / x) - 1)).alias("y"))


def transmittance_stand_in(spark) -> DataFrame:
    """x (nm), y: two absorption dips, a stand-in for the transmittance table."""
    x = 600 + F.col("id") * 0.5
    dip = lambda depth, at, width: depth * F.exp(-((x - at) / width) * ((x - at) / width))
    return spark.range(1201).select(x.alias("x"), (1 - dip(0.6, 760.6, 6.0) - dip(0.4, 944.4, 20.0)).alias("y"))


HALF_PI = math.pi / 2
