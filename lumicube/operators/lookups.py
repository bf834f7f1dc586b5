"""As-of, interpolating and nearest lookups in ordered tables, as equality joins on buckets of the key.

A table's span is cut into as many buckets as it has rows; each interval between two rows is listed under the buckets
that it touches, some two a row in all, and a looked-up value meets the few intervals of its bucket.  Tables of up to
MAX_TABLE_ROWS rows are broadcast; larger ones, which are counted first, are joined by a shuffle on the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Tables of more rows are joined by bucket through a shuffle instead of being broadcast.
MAX_TABLE_ROWS = 10_000


def intervals(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Each row's key and values with the next row's (null at the end).  The window takes the whole table in one task:
    tables are time tables or knots, and only their rows, not those that look up, pass through it."""
    w = Window.orderBy(key)
    return table.select(F.col(key).alias("lo"), F.lead(key).over(w).alias("hi"), *values, *[F.lead(v).over(w).alias(f"next_{v}") for v in values])


def _met(rows: DataFrame, at: Column, t: DataFrame, inside: Column) -> DataFrame:
    """``rows`` with ``_at`` and the columns of the interval of ``t`` (lo, hi, ...) for which ``inside`` holds."""
    span = t.agg(F.count("*").alias("n"), F.min("lo").alias("low"), F.max("lo").alias("high")).first()
    n = max(1, span["n"])
    low, width = span["low"] or 0.0, ((span["high"] or 0.0) - (span["low"] or 0.0)) / n or 1.0

    def bucket(v: Column) -> Column:
        return F.least(F.floor((v - F.lit(float(low))) / F.lit(float(width))), F.lit(n - 1)).cast("long")

    listed = t.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("lo")), F.coalesce(bucket(F.col("hi")), F.lit(n - 1).cast("long")))))
    keyed = rows.withColumn("_at", at).withColumn("_bucket", bucket(F.col("_at")))
    return keyed.join(F.broadcast(listed) if n <= MAX_TABLE_ROWS else listed, "_bucket").filter(inside).drop("_bucket")


def as_of(rows: DataFrame, at: Column, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the value of the last table row at or before ``at``; rows before the table are dropped."""
    inside = (F.col("_at") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("_at") < F.col("hi")))
    return _met(rows, at, intervals(table, key, [value]), inside).drop("_at", "lo", "hi", f"next_{value}")


def interpolated(rows: DataFrame, at: Column, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the value interpolated linearly between the table rows around ``at``; rows off the table are dropped."""
    inside = (F.col("_at") >= F.col("lo")) & F.when(F.col("hi").isNull(), F.col("_at") == F.col("lo")).otherwise(F.col("_at") < F.col("hi"))
    joined = _met(rows, at, intervals(table, key, [value]), inside)
    f = F.when(F.col("hi").isNotNull(), (F.col("_at") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    out = F.col(value) + f * (F.coalesce(f"next_{value}", value) - F.col(value))
    return joined.withColumn(value, out).drop("_at", "lo", "hi", f"next_{value}")


def natural_spline(x: Sequence[float], y: Sequence[float]) -> list[tuple[float, float, float, float, float]]:
    """(knot, a, b, c, d) of a natural cubic spline: a + b h + c h^2 + d h^3 with h from the knot."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    if len(x) < 3 or (np.diff(x) <= 0).any():
        raise ValueError("a spline needs three or more strictly increasing knots")
    a, b, c, d = spline_coefficients(x, y[:, None])
    return [tuple(map(float, r)) for r in zip(x[:-1], a[:, 0], b[:, 0], c[:, 0], d[:, 0], strict=True)]


def spline_coefficients(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, c, d (segments, series) of the natural cubic splines through the series ``y`` (knots, series), by one solution."""
    n, h = len(x) - 1, np.diff(x)
    m, rhs = np.eye(n + 1), np.zeros_like(y)
    i = np.arange(1, n)
    m[i, i - 1], m[i, i], m[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    slope = np.diff(y, axis=0) / h[:, None]
    rhs[1:n] = 3 * np.diff(slope, axis=0)
    c = np.linalg.solve(m, rhs)
    h = h[:, None]
    return y[:-1], slope - h * (2 * c[:-1] + c[1:]) / 3, c[:-1], np.diff(c, axis=0) / (3 * h)


def spline_values(rows: DataFrame, at: Column, segments: DataFrame, last: float, out: str) -> DataFrame:
    """``rows`` with the spline's value at ``at``; rows off the knots are dropped."""
    t = segments.withColumnRenamed("knot", "lo").withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("lo")), F.lit(last)))
    inside = (F.col("_at") >= F.col("lo")) & ((F.col("_at") < F.col("hi")) | ((F.col("_at") == F.lit(last)) & (F.col("hi") == last)))
    joined = _met(rows, at, t, inside)
    h = F.col("_at") - F.col("lo")
    return joined.withColumn(out, F.col("a") + h * (F.col("b") + h * (F.col("c") + h * F.col("d")))).drop("_at", "lo", "hi", "a", "b", "c", "d")


def bracket(value: Column, nodes: Sequence[float], log: bool = False) -> tuple[Column, Column]:
    """Lower node index (from 0) and fraction of a value between nodes; the fraction is held in [0, 1]."""
    index = F.lit(0)
    for k, node in enumerate(nodes[1:-1], 1):
        index = index + F.when(value >= node, 1).otherwise(0)
    table = F.array(*[F.lit(float(n)) for n in nodes])
    lo, hi = F.get(table, index), F.get(table, index + 1)
    f = F.ln(value / lo) / F.ln(hi / lo) if log else (value - lo) / (hi - lo)
    return index, F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))


def multilinear(values: np.ndarray, axes: Sequence[Sequence[float]], at: Sequence[float], log: Sequence[int] = ()) -> np.ndarray:
    """Interpolation in a dense table over its leading axes at one point, clamped to the axes; the rest are kept."""
    out = values
    for k, (nodes, v) in enumerate(zip(axes, at, strict=True)):
        i = int(np.clip(np.searchsorted(nodes, v, side="right") - 1, 0, len(nodes) - 2))
        a, b = nodes[i], nodes[i + 1]
        f = np.log(v / a) / np.log(b / a) if k in log else (v - a) / (b - a)
        f = min(max(float(f), 0.0), 1.0)
        out = (1 - f) * out[i] + f * out[i + 1]
    return out
