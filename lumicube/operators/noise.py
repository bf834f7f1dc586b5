"""Noise reduction: dropout repair and across-track destriping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.radiometry import round_half_up_int, slit_temperature, spectral_angle
from ..model import DROPOUT, SATURATED, VALID
from ..params import DestripingParams, DropoutParams
from .smoothing import with_lowess

#: Neighbour offsets (dy, dx).
NEIGHBOURS = {
    "N4": ((-1, 0), (0, -1), (0, 1), (1, 0)),
    "N8": ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
}
#: Edge-detection thresholds by mode.
EDGE_THRESHOLDS = {"1": 0.08, "2": 0.05, "3": 0.08, "30": 0.08, "3A": 0.08, "4": 0.08, "5": 0.08}
#: Gain and shift of the slit profile as linear functions of temperature.
SLIT_GAIN, SLIT_SHIFT = (0.13045510094294, 0.28135856882126), (-0.12107994955864, 0.65034734426230)
_EPS = 2.220446049250313e-16


def neighbour_offsets(kind: str) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEIGHBOURS[kind]])


def dropout_estimates(pixels: DataFrame, params: DropoutParams = DropoutParams()) -> DataFrame:
    """product_id, y, x, band, value, source (0 from valid, 2 from saturated neighbours, null if there are none).

    Only pixels with a dropout meet their neighbours, by an equality join on the shifted position, and only the
    spectra around a dropout are compared.  A valid neighbour weighs one over the RMS distance over the bands that
    are valid in both (machine epsilon at least), or one if the pixel or the pair has no such band.
    """
    n = params.neighbour_bands
    bad = pixels.filter(F.exists("mask", lambda m: m == DROPOUT)).select("product_id", "y", "x", F.col("radiance").alias("r0"), F.col("mask").alias("m0"), F.explode(neighbour_offsets(params.neighbourhood)).alias("o"))
    bad = bad.withColumns({"ny": F.col("y") + F.col("o.dy"), "nx": F.col("x") + F.col("o.dx")}).drop("o")
    near = pixels.select("product_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("radiance").alias("r1"), F.col("mask").alias("m1"))
    pairs = bad.join(near, ["product_id", "ny", "nx"])
    dropped = F.filter(F.sequence(F.lit(1), F.size("m0")), lambda b: (F.element_at("m0", b) == DROPOUT) & F.element_at("m1", b).isin(VALID, SATURATED))
    pairs = pairs.withColumn("band", F.explode(dropped))
    lo = F.greatest(F.col("band") - n, F.lit(1))
    size = F.least(F.col("band") + n, F.size("m0")) - lo + 1
    part = lambda c: F.slice(c, lo, size)
    items = F.filter(F.arrays_zip(part("r0").alias("r0"), part("r1").alias("r1"), part("m0").alias("m0"), part("m1").alias("m1")), lambda i: (i["m0"] == VALID) & (i["m1"] == VALID))
    pairs = pairs.withColumn("common", items)
    squares = F.aggregate("common", F.lit(0.0), lambda a, i: a + (i["r0"] - i["r1"]).cast("double") * (i["r0"] - i["r1"]))
    distance = F.sqrt(F.try_divide(squares, F.size("common")))
    weight = F.when(F.size("common") == 0, 1.0).otherwise(1.0 / F.greatest(distance, F.lit(_EPS)))
    value, kind = F.element_at("r1", F.col("band")).cast("double"), F.element_at("m1", F.col("band"))
    pairs = pairs.select("product_id", "y", "x", "band", value.alias("v"), kind.alias("k"), weight.alias("w"))
    ok, sat = F.col("k") == VALID, F.col("k") == SATURATED
    sums = pairs.groupBy("product_id", "y", "x", "band").agg(
        F.sum(F.when(ok, F.col("w"))).alias("ws"), F.sum(F.when(ok, F.col("w") * F.col("v"))).alias("wv"), F.avg(F.when(sat, F.col("v"))).alias("sv")
    )
    return sums.select(
        "product_id", "y", "x", "band", F.coalesce(F.col("wv") / F.col("ws"), F.col("sv")).alias("value"), F.when(F.col("ws").isNotNull(), VALID).when(F.col("sv").isNotNull(), SATURATED).alias("source")
    )


def correct_dropouts(pixels: DataFrame, params: DropoutParams = DropoutParams()) -> DataFrame:
    """``pixels`` with dropouts replaced; a dropout without usable neighbours keeps its value.

    The mask keeps 1 where valid neighbours repaired the sample and becomes 2 where saturated ones did.
    """
    fixes = dropout_estimates(pixels, params).groupBy("product_id", "y", "x").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("value", "source").alias("f")))).alias("fix"))
    at = lambda i: F.try_element_at(F.col("fix"), i + 1)
    joined = pixels.join(fixes, ["product_id", "y", "x"], "left")
    radiance = F.transform("radiance", lambda r, i: F.coalesce(round_half_up_int(at(i)["value"]), r))
    mask = F.transform("mask", lambda m, i: F.when(at(i)["source"] == SATURATED, F.lit(SATURATED).cast("short")).otherwise(m))
    some = F.col("fix").isNotNull()
    return joined.withColumns({"radiance": F.when(some, radiance).otherwise(F.col("radiance")), "mask": F.when(some, mask).otherwise(F.col("mask"))}).select(*pixels.columns)


# Destriping -------------------------------------------------------------------------------------------------


def slit_factors(profile: DataFrame, temperature: float, columns: int, mode: str) -> DataFrame:
    """x, slit: the slit profile (position, factor) at a temperature, averaged over detector pixels; 1 where empty."""
    gain, shift = slit_temperature(temperature, SLIT_GAIN, SLIT_SHIFT)
    per_column = 2 if mode == "1" else 1
    position = F.col("position") - shift
    x = F.greatest(F.ceil((position - 0.5) / per_column) - 1, F.lit(0)).cast("int")
    scaled = (F.col("factor") - 1.0) * gain + 1.0
    means = profile.filter(position > 0.5).select(x.alias("x"), scaled.alias("f")).filter(F.col("x") < columns).groupBy("x").agg(F.avg("f").alias("f"))
    every = profile.sparkSession.range(columns).select(F.col("id").cast("int").alias("x"))
    return every.join(means, "x", "left").select("x", F.coalesce("f", F.lit(1.0)).alias("slit"))


def panorama(products: DataFrame) -> DataFrame:
    """product_id, offset: first row of each product (acq_set_id, product_id, height) when stacked by name."""
    w = Window.partitionBy("acq_set_id").orderBy("product_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return products.select("acq_set_id", "product_id", (F.sum("height").over(w) - F.col("height")).cast("int").alias("offset"))


def across_track(pixels: DataFrame) -> DataFrame:
    """``pixels`` with the left neighbour's spectrum, as null in the first column of a row."""
    return pixels.withColumn("left", F.lag("spectrum").over(Window.partitionBy("product_id", "y").orderBy("x")))


def spectral_norms(pixels: DataFrame) -> DataFrame:
    """Squared norm of each spectrum and its scalar product with the left neighbour's."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return pixels.withColumns({"norm": dot("spectrum", "spectrum"), "product": dot("spectrum", "left"), "left_norm": dot("left", "left")})


def edge_angles(pixels: DataFrame) -> DataFrame:
    """acq_set_id, product_id, y, x, sad: spectral angle to the left neighbour, 0 in the first column."""
    rows = spectral_norms(across_track(pixels))
    return rows.select("acq_set_id", "product_id", "y", "x", F.coalesce(spectral_angle(F.col("product"), F.col("left_norm"), F.col("norm")), F.lit(0.0)).alias("sad"))


def column_order_statistics(angles: DataFrame) -> DataFrame:
    """Per set and column the values at places trunc(0.6 H) and trunc(0.8 H), counted from 0, of the stacked rows.

    H is the number of rows that have the column: where the last row is short, columns differ by one.
    """
    column = Window.partitionBy("acq_set_id", "x")
    rows = angles.filter("x > 0").withColumns({"rank": F.row_number().over(column.orderBy("sad")) - 1, "h": F.count("*").over(column)})
    at = lambda p: F.max(F.when(F.col("rank") == F.floor(F.col("h") * p), F.col("sad")))
    return rows.groupBy("acq_set_id", "x").agg(at(0.60).alias("t60"), at(0.80).alias("t80"))


def adaptive_threshold(statistics: DataFrame, mode: str) -> DataFrame:
    """Per set: the nominal threshold held between the largest 60 % and 80 % values of the columns."""
    nominal = F.lit(EDGE_THRESHOLDS[mode])
    ends = statistics.groupBy("acq_set_id").agg(F.greatest(F.max("t60"), F.lit(0.0)).alias("lo"), F.greatest(F.max("t80"), F.lit(0.0)).alias("hi"))
    return ends.select("acq_set_id", F.least(F.greatest(nominal, "lo"), "hi").alias("threshold"))


def edge_mask(angles: DataFrame, threshold: DataFrame) -> DataFrame:
    """``angles`` with the flag edge; one threshold row a set is broadcast."""
    return angles.join(F.broadcast(threshold), "acq_set_id").withColumn("edge", (F.col("x") > 0) & (F.col("sad") > F.col("threshold")))


def column_log_ratio_mean(rows: DataFrame, strict: bool = False) -> DataFrame:
    """acq_set_id, band, x, n, mean of ln(r / r_left) over valid samples off the edges.

    ``rows`` has acq_set_id, product_id, y, x, band, value, left_value, mask, left_mask, edge.
    """
    ok = (F.col("x") > 0) & ~F.col("edge") & (F.col("mask") == VALID)
    if strict:
        ok &= F.col("left_mask") == VALID
    ratio = F.when(ok, F.ln(F.col("value") / F.col("left_value")))
    return rows.groupBy("acq_set_id", "band", "x").agg(F.count(ratio).alias("n"), F.avg(ratio).alias("mean"))


def carried_profile(means: DataFrame) -> DataFrame:
    """``means`` with p: the mean, in the first column 0, and where a column has none that of the columns before."""
    w = Window.partitionBy("acq_set_id", "band").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("x") == 0, 0.0).otherwise(F.col("mean"))
    return means.withColumn("p", F.last(own, ignorenulls=True).over(w))


def integrated_profile(profile: DataFrame) -> DataFrame:
    w = Window.partitionBy("acq_set_id", "band").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return profile.withColumn("c", F.sum("p").over(w))


def destriping_factors(pixels: DataFrame, mode: str, params: DestripingParams, slit: DataFrame | None = None) -> DataFrame:
    """acq_set_id, band, x, factor of stacked products.

    ``pixels`` has acq_set_id, product_id, y, x, radiance, mask; ``slit`` has x and slit.  Scenes are as wide as a
    detector line, so that everything after the column means is one short array a set and band.
    """
    if params.slit_correction:
        if slit is None:
            raise ValueError("slit correction needs the slit factors")
        pixels = pixels.join(F.broadcast(slit), "x")
        divisor = F.col("slit")
    else:
        divisor = F.lit(1.0)
    pixels = pixels.withColumn("divisor", divisor).withColumn("spectrum", F.transform("radiance", lambda r: r / F.col("divisor")))
    shifted = spectral_norms(across_track(pixels)).withColumn("left_mask", F.lag("mask").over(Window.partitionBy("product_id", "y").orderBy("x")))
    shifted = shifted.withColumn("sad", F.coalesce(spectral_angle(F.col("product"), F.col("left_norm"), F.col("norm")), F.lit(0.0)))
    threshold = adaptive_threshold(column_order_statistics(shifted.select("acq_set_id", "x", "sad")), mode)
    flagged = edge_mask(shifted, threshold).filter("x = 0 OR NOT edge")
    zipped = F.arrays_zip(F.col("spectrum").alias("value"), F.coalesce("left", "spectrum").alias("left_value"), F.col("mask").alias("mask"), F.coalesce("left_mask", "mask").alias("left_mask"))
    rows = flagged.select("acq_set_id", "x", "edge", F.posexplode(zipped).alias("pos", "s")).select("acq_set_id", "x", "edge", (F.col("pos") + 1).alias("band"), "s.*")
    means = column_log_ratio_mean(rows, params.strict_mask)
    every = pixels.select("acq_set_id", "x", F.size("radiance").alias("bands")).groupBy("acq_set_id", "x").agg(F.max("bands").alias("bands"))
    every = every.select("acq_set_id", "x", F.explode(F.sequence(F.lit(1), "bands")).alias("band"))
    profile = integrated_profile(carried_profile(every.join(means, ["acq_set_id", "band", "x"], "left")))
    series = profile.groupBy("acq_set_id", "band").agg(F.array_sort(F.collect_list(F.struct("x", "c"))).alias("xs"))
    series = series.select("acq_set_id", "band", F.transform("xs", lambda s: s["x"]).alias("xs"), F.transform("xs", lambda s: s["c"]).alias("c"))
    series = with_lowess(series, "c", "smooth", 2, params.smoothing_order, 2)
    noise = F.zip_with("c", "smooth", lambda a, b: a - b)
    series = series.withColumn("noise", noise).withColumn("level", F.aggregate("noise", F.lit(0.0), lambda a, v: a + v) / F.size("noise"))
    out = series.select("acq_set_id", "band", F.explode(F.arrays_zip("xs", "noise")).alias("e"), "level").select("acq_set_id", "band", F.col("e.xs").alias("x"), F.exp(-(F.col("e.noise") - F.col("level"))).alias("factor"))
    if params.slit_correction:
        out = out.join(F.broadcast(slit), "x").withColumn("factor", F.col("factor") / F.col("slit"))
    return out.select("acq_set_id", "band", "x", "factor")


def apply_destriping(pixels: DataFrame, factors: DataFrame) -> DataFrame:
    """Radiances times their column's factors, cut after adding a half.

    Factors of a column are one array of as many numbers as bands, and a set has as many rows as columns; they are
    broadcast.
    """
    per_column = factors.groupBy("acq_set_id", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "factor"))), lambda s: s["factor"]).alias("factors"))
    joined = pixels.join(F.broadcast(per_column), ["acq_set_id", "x"])
    return joined.withColumn("radiance", F.zip_with("radiance", "factors", lambda r, f: round_half_up_int(r * f))).select(*pixels.columns)
