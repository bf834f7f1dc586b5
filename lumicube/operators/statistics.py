"""Selections, regressions and neighbourhood means."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def smallest(rows: DataFrame, keys: Sequence[str], value: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` smallest positive values of each key, ranked from 1; the limit is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, *ties))
    return rows.filter(F.col(value) > 0).withColumn("rank", rank).filter(F.col("rank") <= n)


def extremes(rows: DataFrame, value: str, n: int, ties: Sequence[str], keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """The ``n`` lowest and highest rows of each key that has more than 2 n, with the column end.

    Both ends are cut to ``n`` rows a key and task before they are shuffled, and the count is a partial aggregate, so no
    task sees all rows of a key.
    """
    w = Window.partitionBy(*keys)

    def end(name: str, order: list) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(w.orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank").withColumn("end", F.lit(name))

    both = end("low", [F.asc(value), *map(F.asc, ties)]).unionByName(end("high", [F.desc(value), *map(F.desc, ties)]))
    many = rows.groupBy(*keys).agg(F.count("*").alias("_total")).filter(F.col("_total") > 2 * n).drop("_total")
    return both.join(many, list(keys), "left_semi")


def with_gaps(rows: DataFrame, keys: Sequence[str], before: int, after: int, columns: int | None = None) -> DataFrame:
    """``rows`` (keys, y, x, ...) and, flagged by _gap, the places without a pixel in their row that lie at most ``before``
    left or ``after`` right of one of its pixels; other columns are null there.

    An image whose last row is short has no pixel there to carry the row's sums on to the rows above.  No places are made
    left of 0 or, if ``columns`` is given, from that column on, where no pixels may stand.
    """
    w, x = Window.partitionBy(*keys, "y").orderBy("x"), F.col("x")
    rows = rows.withColumns({"_last": F.lag("x").over(w), "_next": F.lead("x").over(w)})
    # The gap before a pixel belongs to it, but for what the pixel before reaches.
    low = F.greatest(x - before, F.lit(0), F.coalesce(F.col("_last") + after + 1, F.lit(0)))
    high = F.least(x + after, F.coalesce(F.col("_next") - 1, F.lit((1 << 30) if columns is None else columns - 1)))
    own = F.array(F.struct(x.cast("int").alias("x"), F.lit(False).alias("gap")))
    span = lambda a, b: F.when(a <= b, F.transform(F.sequence(a.cast("int"), b.cast("int")), lambda v: F.struct(v.alias("x"), F.lit(True).alias("gap")))).otherwise(F.array().cast("array<struct<x:int,gap:boolean>>"))
    filled = F.when((low < x) | (high > x), F.concat(own, span(low, x - 1), span(x + 1, high))).otherwise(own)
    places = rows.withColumn("_place", F.explode(filled)).drop("_last", "_next")
    gap, kept = F.col("_place.gap"), {*keys, "y", "x", "_place"}
    values = [c if c in kept else F.when(~gap, F.col(c)).alias(c) for c in places.columns if c not in ("x", "_place")]
    return places.select(*values, F.col("_place.x").cast(dict(rows.dtypes)["x"]).alias("x"), gap.alias("_gap"))


def window_sums(rows: DataFrame, sums: dict[str, Column], before: int, after: int, keys: Sequence[str] = ("product_id", "band"), columns: int | None = None) -> DataFrame:
    """``rows`` (keys, y, x, ...) with the sums of expressions over the pixels that stand from ``before`` left and above to
    ``after`` right and below: two passes of running frames, along x and then along y, over images with or without gaps."""
    row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-before, after)
    column = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-before, after)
    # A place sees ``before`` to its left: a pixel reaches as far to its right.
    out = with_gaps(rows, keys, after, before, columns)
    out = out.withColumns({n: F.sum(c).over(row) for n, c in sums.items()})
    return out.withColumns({n: F.sum(n).over(column) for n in sums}).filter(~F.col("_gap")).drop("_gap")


def box_mean(rows: DataFrame, value: str, kernel: int, keys: Sequence[str] = ("product_id", "band"), columns: int | None = None) -> DataFrame:
    """``rows`` (keys, y, x, value) with box_mean: mean of the non-zero values in [-k/2, k/2) about the pixel, cut to an
    integer; 0 where the pixel's own value is 0.  ``columns``: as for ``with_gaps``.
    """
    half, v = kernel // 2, F.col(value).cast("long")
    out = window_sums(rows, {"_s": v, "_n": (v != 0).cast("long")}, half, half - 1, keys, columns)
    mean = F.when(v == 0, 0).otherwise(F.coalesce(F.try_divide(F.col("_s"), F.col("_n")), F.lit(0.0)).cast("int"))
    return out.withColumn("box_mean", mean).drop("_s", "_n")


#: Keys whose factors a task holds at most before it hands them on, and parts that the factors of a key are first met in.
HELD_KEYS, PARTS = 10_000, 64


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows (predictors, then the response), with as many rows as columns at most."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def multi_regression(rows: DataFrame, keys: Sequence[str], predictors: Sequence[str], response: str) -> DataFrame:
    """keys, n, rank, coefficients, singular_values, residual: least squares of the response on any number of predictors
    without intercept, for each key.

    Every task reduces its rows to a triangular factor a key, factors of a key meet in PARTS parts and then in one row, so
    that a key of any size is never gathered.  Singular values of the last factor up to rounding are cut off, as far as
    the decomposition of all rows would: where predictors depend on each other, the coefficients are the smallest that
    fit.  ``residual`` is the sum of squares that is left.  Rows with a null or another value that isn't finite are left
    out, and keys without other rows; null keys are a key; an empty table gives no rows.
    """
    names, width = [*predictors, response], len(predictors) + 1
    finite = [F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False)) for c in names]
    used = rows.select(*keys, F.array(*[F.col(c).cast("double") for c in names]).alias("_row")).filter(functools.reduce(lambda p, q: p & q, finite))
    kinds = ", ".join(f"`{n}` {t}" for n, t in used.select(*keys).dtypes)
    at = len(keys)

    def packed(held: dict[tuple, tuple[int, np.ndarray]], key_types: list[pa.DataType]) -> pa.RecordBatch:
        own = list(held)
        cols = [pa.array([k[i] for k in own], t) for i, t in enumerate(key_types)]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array([held[k][0] for k in own], pa.int64()), pa.array([held[k][1].ravel().tolist() for k in own], pa.list_(pa.float64()))], names=[*keys, "_n", "_r"]
        )

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        key_types: list[pa.DataType] = []
        for batch in batches:
            key_types = [batch.column(i).type for i in range(at)]
            if not batch.num_rows:
                continue
            many = batch.num_columns > at + 1  # factors, not rows
            own = list(zip(*(batch.column(i).to_pylist() for i in range(at)), strict=True)) if keys else [()] * batch.num_rows
            place: dict[tuple, list[int]] = {}
            for r, k in enumerate(own):
                place.setdefault(k, []).append(r)
            values = batch.column(at + 1 if many else at)
            flat, ends = np.asarray(values.flatten()), np.asarray(values.value_lengths()).cumsum()
            counts = np.asarray(batch.column(at)) if many else np.ones(batch.num_rows, np.int64)
            for k, rs in place.items():
                x = np.concatenate([flat[(ends[r - 1] if r else 0) : ends[r]] for r in rs]).reshape(-1, width)
                n, before = held.get(k, (0, np.zeros((0, width))))
                held[k] = n + int(counts[rs].sum()), _factor(np.concatenate((before, x)))
            if len(held) > HELD_KEYS:
                yield packed(held, key_types)
                held = {}
        if held:
            yield packed(held, key_types)

    schema = f"{kinds}{', ' if keys else ''}_n long, _r array<double>"
    parts = used.mapInArrow(reduced, schema).withColumn("_part", F.pmod(F.xxhash64("_r"), F.lit(PARTS)))
    met = parts.repartition(*keys, "_part").drop("_part").mapInArrow(reduced, schema)
    last = (met.repartition(*keys) if keys else met.coalesce(1)).mapInArrow(reduced, schema)
    whole = last.groupBy(*keys).agg(F.sum("_n").alias("n"), F.flatten(F.collect_list("_r")).alias("_r"))  # HELD_KEYS aside, one factor a key

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, list[float], list[float], float]] = []
            for n, raw in zip(batch.column(at).to_pylist(), batch.column(at + 1), strict=True):
                r = np.asarray(raw.values).reshape(-1, width)
                a, y = r[:, :-1], r[:, -1]
                u, s, vt = np.linalg.svd(a, full_matrices=False)
                rank = int((s > max(n, width - 1) * s.max(initial=0.0) * np.finfo(float).eps).sum())
                c = vt[:rank].T @ ((u[:, :rank].T @ y) / s[:rank])
                out.append((rank, c.tolist(), s.tolist(), float(((y - a @ c) ** 2).sum())))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], *cols], names=[*keys, "n", "rank", "coefficients", "singular_values", "residual"])

    return whole.filter("n IS NOT NULL").mapInArrow(solved, f"{kinds}{', ' if keys else ''}n long, rank int, coefficients array<double>, singular_values array<double>, residual double")


def slope_through_origin(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"))


def without_repeats(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_b", before).filter(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def angular_velocity(rows: DataFrame, keys: Sequence[str], time: str, x: str, y: str, z: str) -> DataFrame:
    """Angle to the next position over the time to it; the last position is held against the first.

    As in the reference, the angle is 0 where the scalar or the vector product vanishes.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lead(time).over(w).isNull()
    nxt = {c: F.when(last, F.first(c).over(first)).otherwise(F.lead(c).over(w)) for c in (x, y, z, time)}
    out = rows.withColumns({f"_{k}": c for k, c in zip("xyzt", (nxt[x], nxt[y], nxt[z], nxt[time]), strict=True)})
    a, b, c, p, q, r = (F.col(n) for n in (x, y, z, "_x", "_y", "_z"))
    dot = a * p + b * q + c * r
    cross = F.sqrt((b * r - c * q) * (b * r - c * q) + (c * p - a * r) * (c * p - a * r) + (a * q - b * p) * (a * q - b * p))
    angle = F.when((dot != 0) & (cross != 0), F.atan2(cross, dot)).otherwise(0.0)
    gap = F.abs(F.col("_t") - F.col(time))
    return out.withColumn("velocity", F.try_divide(angle, gap)).drop("_x", "_y", "_z", "_t")


def max_aot(dark: DataFrame, path_radiance, start: float, step: float, most: float, count: int, keys: Sequence[str] = ("product_id",), fine: float | None = None) -> DataFrame:
    """Per key the largest grid value start + i step (at most ``most``) before ``count`` dark columns fall below the
    path radiance in some band; with ``fine``, the search goes on from there in steps of ``fine``.

    ``dark`` has keys, rank, band, value; ``path_radiance(aot, band)`` is a column.  The grid is exploded against
    the few dark pixels (count times bands).
    """
    found = _aot_pass(dark.withColumn("_from", F.lit(start)), path_radiance, step, most, count, keys, None)
    if fine is None:
        return found
    again = dark.join(F.broadcast(found.withColumnRenamed("aot", "_from")), list(keys))  # a row a scene
    return _aot_pass(again, path_radiance, fine, most, count, keys, int(step / fine + 1e-9))


def _aot_pass(dark: DataFrame, path_radiance, step: float, most: float, count: int, keys: Sequence[str], steps: int | None) -> DataFrame:
    """One pass from the column _from; ``steps`` bounds it where the value after so many is known to be too large."""
    n = F.floor((most - F.col("_from")) / step + 1e-9).cast("int")
    n = n if steps is None else F.least(n, F.lit(steps))
    grid = dark.withColumn("n", n).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("aot", F.col("_from") + F.col("i") * step)
    hit = grid.filter(F.col("value") < path_radiance(F.col("aot"), F.col("band"))).groupBy(*keys, "i").agg(F.countDistinct("rank").alias("hits"))
    stop = hit.filter(F.col("hits") >= count).groupBy(*keys).agg(F.min("i").alias("stop"))
    every = dark.select(*keys, "_from", n.alias("n")).distinct()
    return every.join(stop, list(keys), "left").select(*keys, (F.col("_from") + (F.coalesce("stop", F.col("n") + 1) - 1) * step).alias("aot"))
