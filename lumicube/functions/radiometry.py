"""Radiometric column functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def solar_irradiance_correction(day_of_year: Column) -> Column:
    """1 / d^2 with the Earth-Sun distance d in astronomical units."""
    d = 1.0 - 0.01673 * F.cos(F.radians((day_of_year - 4) * 0.9856))
    return 1.0 / (d * d)


def azimuthal_difference(a: Column, b: Column) -> Column:
    """|a - b| folded to at most 180 degrees."""
    d = F.abs(a - b)
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def toa_factor(solar_zenith: Column | float, irradiance: Column) -> Column:
    """Radiance to top-of-atmosphere reflectance."""
    sza = F.lit(float(solar_zenith)) if isinstance(solar_zenith, int | float) else solar_zenith
    return math.pi / (F.cos(F.radians(sza)) * 1000.0 * irradiance)


def bell_weight(delta: Column, width: Column) -> Column:
    """1 / (1 + |2 delta / width|)^4 for -width < delta <= width, else 0."""
    w = 1.0 / F.pow(1.0 + F.abs(2.0 * delta / width), F.lit(4.0))
    return F.when((delta > -width) & (delta <= width), w).otherwise(0.0)


def shape_exponents(bands: int) -> list[float]:
    """Exponents of the resampling weight by band: from 6 down to 2."""
    return [6.0 - 4.0 * i / (bands - 1) if bands > 1 else 6.0 for i in range(bands)]


def resample_weight(delta: Column, width: Column, exponent: Column) -> Column:
    """exp(-(delta / (width c))^e), c = (1 / (2^e ln 2))^(1/e), within two widths; delta is absolute."""
    c = F.pow(1.0 / (F.pow(F.lit(2.0), exponent) * math.log(2.0)), 1.0 / exponent)
    return F.when(delta <= 2.0 * width, F.exp(-F.pow(delta / (width * c), exponent))).otherwise(0.0)


def lambert_inverse(radiance: Column, scale: Column | float, lpw: Column, egl: Column, sab: Column) -> Column:
    """Surface reflectance of a Lambertian surface from radiance."""
    a = math.pi * (radiance * scale - lpw) / egl
    return a / (1.0 + a * sab)


def lambert_forward(reflectance: Column, scale: Column | float, lpw: Column, egl: Column, sab: Column) -> Column:
    """Radiance of a Lambertian surface."""
    return (lpw + reflectance * egl / (math.pi * (1.0 - sab * reflectance))) / scale


def adjacency_term(reflectance: Column, mean: Column, ratio: Column) -> Column:
    return (reflectance - mean) * ratio


def global_flux(direct: Column, diffuse: Column, solar_zenith: Column) -> Column:
    return direct * F.cos(F.radians(solar_zenith)) + diffuse


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def round_half_up_int(value: Column, kind: str = "int") -> Column:
    """(value + 0.5) cut toward zero; what the type can't hold becomes null instead of wrapping around."""
    return (value + 0.5).try_cast(kind)


def slit_temperature(temperature: float, gain: tuple[float, float], shift: tuple[float, float]) -> tuple[float, float]:
    """Scale and shift of the slit profile at a temperature."""
    return gain[0] * temperature + gain[1], shift[0] * temperature + shift[1]


def _constants(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def trapezoid(wavelengths: Sequence[float], values: Column) -> Column:
    """Integral of an array over fixed abscissae; weights are folded when the plan is built.

    One array function, whatever the number of bands: unrolled by band, the expression takes longer to plan and to
    compile than to run.
    """
    n = len(wavelengths)
    weights = [0.5 * (wavelengths[min(i + 1, n - 1)] - wavelengths[max(i - 1, 0)]) for i in range(n)]
    return _total(F.zip_with(values, _constants(weights), lambda v, w: v * w))


def brightness(wavelengths: Sequence[float], values: Column) -> Column:
    return trapezoid(wavelengths, values) / (wavelengths[-1] - wavelengths[0])


def whiteness(wavelengths: Sequence[float], values: Column, level: Column) -> Column:
    """Mean absolute deviation from ``level`` by trapezoids that are split where the curve crosses it."""
    n = len(wavelengths)
    off = F.transform(values, lambda v: v - level)
    steps = _constants([wavelengths[i] - wavelengths[i - 1] for i in range(1, n)])

    def area(a: Column, b: Column) -> Column:
        # Two triangles about the crossing have the area (a^2 + b^2) / (2 |a - b|) dx.
        split = (a * a + b * b) / F.nullif(F.abs(a - b), F.lit(0.0))
        return F.when(a * b >= 0, F.abs(a) + F.abs(b)).otherwise(split)

    areas = F.zip_with(F.slice(off, 1, n - 1), F.slice(off, 2, n - 1), area)
    return 0.5 * _total(F.zip_with(steps, areas, lambda dx, v: dx * v)) / (wavelengths[-1] - wavelengths[0])


def optical_path(inner: Column, interpolated: Column, mu: float, transmittance: float) -> Column:
    return (mu / math.log(transmittance)) * F.ln(inner / interpolated)


def air_mass(solar_zenith: float, view_zenith: float) -> float:
    """Inverse two-way air mass."""
    return 1.0 / (1.0 / math.cos(math.radians(solar_zenith)) + 1.0 / math.cos(math.radians(view_zenith)))


def spectral_angle(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Angle from the scalar product and the squared norms of two spectra; null where one of them is."""
    c = product / F.sqrt(norm_a) / F.sqrt(norm_b)
    # least and greatest pass over nulls, so a null has to be kept apart.
    return F.when(c.isNotNull(), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))))


def legendre(x: Column, degree: int) -> list[Column]:
    """Legendre polynomials of degrees 0 to ``degree``."""
    out = [F.lit(1.0), x][: degree + 1]
    for n in range(1, degree):
        out.append(((2 * n + 1) * x * out[n] - n * out[n - 1]) / (n + 1))
    return out


def int_power(x: Column, n: int) -> Column:
    """x to a small integer power, by repeated squaring in plain multiplications."""
    if n == 1:
        return x
    half = int_power(x, n // 2)
    return half * half * x if n % 2 else half * half


def log_density(y: Column, mean: Column, variance: Column) -> Column:
    """Log density of a normal distribution with diagonal covariance."""
    log_det = F.aggregate(variance, F.lit(0.0), lambda a, v: a + F.ln(v))
    dist = F.aggregate(F.zip_with(F.zip_with(y, mean, lambda p, q: (p - q) * (p - q)), variance, lambda d, v: d / v), F.lit(0.0), lambda a, v: a + v)
    return -0.5 * (F.size(y) * math.log(2 * math.pi) + log_det) - 0.5 * dist
