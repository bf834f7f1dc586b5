"""Text forms of numbers for annotations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def three_decimals(value: Column) -> Column:
    """A point and three decimals, as retrieved optical thicknesses are annotated."""
    return F.format_string("%.3f", value)


def _sexagesimal(value: Column, positive: str, negative: str) -> Column:
    seconds = F.round(F.abs(value) * 3600.0).cast("long")
    text = F.format_string("%d°%02d'%02d\"", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return F.concat(text, F.lit(" "), F.when(value < 0, negative).otherwise(positive))


def coordinates(lat: Column, lon: Column, default: Column) -> Column:
    """Latitude and longitude in degrees, minutes and seconds with their hemispheres; the default without numbers."""
    both = F.concat_ws(", ", _sexagesimal(lat, "N", "S"), _sexagesimal(lon, "E", "W"))
    return F.when(lat.isNotNull() & lon.isNotNull(), both).otherwise(default)
