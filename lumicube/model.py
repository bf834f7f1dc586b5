"""Data model: scenes as DataFrames of pixels.

A scene has one row per pixel with array-valued spectra (``wide``), or one row per pixel and band (``long``).  Band
descriptors are few (62 at most) and known when a plan is built, so they are plain Python values that enter plans
as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

PIXELS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("radiance", T.ArrayType(T.IntegerType())),
        T.StructField("mask", T.ArrayType(T.ShortType())),
    ]
)

#: Mask values.
VALID, DROPOUT, SATURATED = 0, 1, 2


@dataclass(frozen=True)
class Band:
    """Descriptor of one spectral band; ``index`` counts from 1."""

    index: int
    name: str
    wavelength: float  # nm
    bandwidth: float  # nm
    scale: float = 1.0
    unit: str = ""


@dataclass(frozen=True)
class Mode:
    """Constants of an acquisition mode (fixed values of the instrument)."""

    columns: int
    rows: int
    integration_time: float  # s a line
    field_of_view: float  # degrees

    #: Added to the integration time of every line.
    FRAME_TRANSFER = 1.2096e-3

    @property
    def time_per_line(self) -> float:
        return self.integration_time + self.FRAME_TRANSFER

    @property
    def instantaneous_field_of_view(self) -> float:
        return self.field_of_view / self.columns


#: Acquisition modes by name; other names behave like mode 2.
MODES = {
    "0": Mode(744, 1010, 11.4912e-3, 1.28570),
    "1": Mode(372, 374, 24.1899e-3, 1.29261),
    "2": Mode(744, 748, 11.4912e-3, 1.28570),
    "3": Mode(744, 748, 11.4912e-3, 1.28570),
    "4": Mode(744, 748, 11.4912e-3, 1.28570),
    "5": Mode(370, 748, 11.4912e-3, 0.63939),
    "20": Mode(744, 1024, 11.4912e-3, 1.28570),
}


def mode_of(name: str) -> Mode:
    return MODES.get(name, MODES["2"])


@dataclass(frozen=True)
class Scene:
    """Pixels with their band descriptors and product attributes."""

    pixels: DataFrame
    bands: tuple[Band, ...]
    attrs: dict[str, str] = field(default_factory=dict)

    def with_pixels(self, pixels: DataFrame, bands: Sequence[Band] | None = None, **attrs: str) -> Scene:
        return Scene(pixels, tuple(bands if bands is not None else self.bands), self.attrs | attrs)

    @property
    def wavelengths(self) -> list[float]:
        return [b.wavelength for b in self.bands]


def to_long(pixels: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """One row per pixel and band (from 1) with the named array columns' elements; arrays must be equally long."""
    values = values or {"radiance": "value", "mask": "mask"}
    keys = [c for c in pixels.columns if c not in values]
    zipped = F.arrays_zip(*[F.col(c) for c in values])
    out = pixels.select(*keys, F.posexplode(zipped).alias("pos", "item"))
    return out.select(*keys, (F.col("pos") + 1).alias("band"), *[F.col(f"item.{c}").alias(name) for c, name in values.items()])


def to_wide(rows: DataFrame, values: dict[str, str] | None = None, keys: Sequence[str] = ("product_id", "y", "x")) -> DataFrame:
    """The inverse of ``to_long``; bands come in ascending order."""
    values = values or {"value": "radiance", "mask": "mask"}
    items = F.array_sort(F.collect_list(F.struct("band", *values)))
    grouped = rows.groupBy(*keys).agg(items.alias("items"))
    return grouped.select(*keys, *[_field("items", c).alias(name) for c, name in values.items()])


def _field(items: str, name: str) -> Column:
    return F.transform(items, lambda i: i[name])


def doubles(values: Sequence[float]) -> Column:
    """An array literal of doubles."""
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def picked(array: str | Column, indices: Sequence[int]) -> Column:
    """The elements at the band indices (from 1), as an array: prunes a spectrum before any arithmetic."""
    col = F.col(array) if isinstance(array, str) else array
    return F.array(*[F.element_at(col, i) for i in indices])
