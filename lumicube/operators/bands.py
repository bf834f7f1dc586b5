"""Band selection on descriptor frames and masks on pixel frames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.radiometry import round_half_up_int
from ..model import Band

#: Open absorption intervals (nm) left out of the surface features.
ABSORPTION = (
    (400.0, 440.0),
    (590.0, 600.0),
    (630.0, 636.0),
    (648.0, 658.0),
    (686.0, 709.0),
    (792.0, 799.0),
    (756.0, 775.0),
    (808.0, 840.0),
    (885.0, 985.0),
    (985.0, 1010.0),
)
VISIBLE = (400.0, 700.0)
#: Product types that each stage accepts.
PRODUCT_TYPES = {
    "noise_reduction": r"^CHRIS_M[12345][0A]?$",
    "toa_reflectance": r"^CHRIS_M.*$",
    "cloud_screening": r"^CHRIS_M[12345][0A]?_NR$",
    "atmospheric_correction": r"^CHRIS_M[12345].*_NR$",
    "geometric_correction": r"^CHRIS_M[012345][0A]?(_NR)?(_TOA_REFL)?(_AC)?$",
}
#: Suffix that a stage adds to the product type, as its lineage.
SUFFIXES = {"noise_reduction": "_NR", "toa_reflectance": "_TOA_REFL", "features": "_FEAT", "classify": "_CLASS", "atmospheric_correction": "_AC", "geometric_correction": "_GC"}


def bands_frame(spark: SparkSession, bands: Sequence[Band]) -> DataFrame:
    rows = [(b.index, b.name, b.wavelength, b.bandwidth, b.scale, b.unit) for b in bands]
    return spark.createDataFrame(rows, "band int, name string, wavelength double, bandwidth double, scale double, unit string")


def by_prefix(bands: DataFrame, prefix: str) -> DataFrame:
    """Bands whose name starts with ``prefix``, with their place among them (from 0)."""
    return bands.filter(F.col("name").startswith(prefix)).withColumn("place", F.row_number().over(Window.orderBy("band")) - 1)


def nearest_band(bands: DataFrame, targets: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Per target wavelength the band nearest to it, the first of equals; -1 beyond the tolerance.

    ``bands`` has 62 rows at most, so it is broadcast.
    """
    gap = F.abs(F.col("wavelength") - F.col("target"))
    near = targets.join(F.broadcast(bands), F.lit(True)).groupBy("target").agg(F.min(F.struct(gap.alias("gap"), "band")).alias("best"))
    found = F.col("best.band") if tolerance is None else F.when(F.col("best.gap") > tolerance, -1).otherwise(F.col("best.band"))
    return near.select("target", found.alias("band"))


def nearest_index(bands: Sequence[Band], wavelength: float) -> int:
    """The same at plan time, for literals."""
    return min(bands, key=lambda b: (abs(b.wavelength - wavelength), b.index)).index


def inside(wavelength: Column, lo: float, hi: float) -> Column:
    return (wavelength > lo) & (wavelength < hi)


def inside_any(wavelength: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    out = F.lit(False)
    for lo, hi in intervals:
        out = out | inside(wavelength, lo, hi)
    return out


def strictly_inside(wavelength: Column, bandwidth: Column, lo: float, hi: float) -> Column:
    return (wavelength - bandwidth / 2 > lo) & (wavelength + bandwidth / 2 < hi)


def categorize(bands: DataFrame) -> DataFrame:
    """Absorption-free bands with their group, vis or nir."""
    kept = bands.filter(~inside_any(F.col("wavelength"), ABSORPTION))
    return kept.withColumn("category", F.when(inside(F.col("wavelength"), *VISIBLE), "vis").otherwise("nir"))


def categorized(bands: Sequence[Band]) -> dict[str, list[Band]]:
    """all, vis and nir bands at plan time; none may be empty."""
    free = [b for b in bands if not any(lo < b.wavelength < hi for lo, hi in ABSORPTION)]
    out = {"all": free, "vis": [b for b in free if VISIBLE[0] < b.wavelength < VISIBLE[1]]}
    out["nir"] = [b for b in free if b not in out["vis"]]
    for name, of in out.items():
        if not of:
            raise ValueError(f"no absorption-free bands: {name}")
    return out


def edges(bands: Sequence[Band], lo: float, hi: float) -> tuple[int, int]:
    """First band with wavelength >= lo and last with wavelength <= hi."""
    return min(b.index for b in bands if b.wavelength >= lo), max(b.index for b in bands if b.wavelength <= hi)


def accepts(stage: str, product_type: str) -> bool:
    return re.match(PRODUCT_TYPES[stage], product_type) is not None


def with_suffix(stage: str, product_type: str) -> str:
    """The product type after a stage; raises if the stage doesn't accept it."""
    if stage in PRODUCT_TYPES and not accepts(stage, product_type):
        raise ValueError(f"{stage} does not accept products of type {product_type}")
    return product_type + SUFFIXES[stage]


# Masks ------------------------------------------------------------------------------------------------------


def valid_pixels(mask: str = "mask") -> Column:
    """No band has a dropout or saturation bit."""
    return F.forall(mask, lambda m: m.bitwiseAND(F.lit(3).cast("short")) == 0)


def hyper_mask(mask: str = "mask") -> Column:
    """Bitwise union of the bands' masks, as an unsigned byte."""
    return F.aggregate(mask, F.lit(0), lambda a, m: a.bitwiseOR(m.cast("int").bitwiseAND(F.lit(255))))


def cloud_mask(cloud_product: Column, threshold: float) -> Column:
    return F.when(cloud_product > threshold, 1).otherwise(0)


def water_mask(red: Column, nir: Column, red_scale: float, nir_scale: float) -> Column:
    """Red above near infrared, and both reflectances within the range of water."""
    r, n = red * red_scale, nir * nir_scale
    return F.when((red > nir) & (r > 0.01) & (n > 0.01) & (n < 0.1), 1).otherwise(0)


def scale(raw: Column, factor: float) -> Column:
    return raw * factor


def unscale(value: Column, factor: float) -> Column:
    return round_half_up_int(value / factor)


def feature_names(mode: str, use_nir: bool = True, use_water_vapour: bool = False, use_oxygen: bool = False) -> list[str]:
    """Feature columns for clustering: the visible pair always, optical paths only in modes that have them."""
    out = ["brightness_vis", "whiteness_vis"]
    if use_nir:
        out += ["brightness_nir", "whiteness_nir"]
    if mode in ("1", "5"):
        out += ["wv"] * use_water_vapour + ["o2"] * use_oxygen
    return out
