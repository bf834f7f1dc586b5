"""Local regression on equidistant points, one array per series.

A series (a few hundred points: the columns of a scene or the bands of a spectrum) is one array in one row, so
smoothing needs no join and no shuffle.  The fits of all windows of a series are one batch of small normal equations,
which an Arrow-batched function solves; higher-order SQL functions were tried and took minutes for 128 columns,
because lambdas are interpreted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def tricube(span: int, at: int) -> np.ndarray:
    """Weights of a window's points for a fit at its point ``at``."""
    b = max(at, span - 1 - at)
    return (1.0 - (np.abs(np.arange(span) - at) / b) ** 3) ** 1.5


def robust_weights(residuals: np.ndarray) -> np.ndarray:
    """1 - (r / 6 MAD)^2 of absolute residuals, 0 beyond, all 1 if the upper median is 0."""
    mad6 = 6.0 * np.sort(residuals)[len(residuals) // 2]
    if not mad6 > 0:
        return np.ones_like(residuals)
    return np.where(residuals < mad6, 1.0 - (residuals / mad6) ** 2, 0.0)


def lowess(y: np.ndarray, degree: int, span: int, passes: int) -> np.ndarray:
    """Smoothed values; windows at the ends stay whole and off centre."""
    if span <= degree + 2 or passes < 0:
        raise ValueError("the span must exceed the degree by more than two, and passes may not be negative")
    m = len(y)
    if m < span:
        raise ValueError("a series must not be shorter than the span")
    i = np.arange(m)
    start = np.minimum(np.maximum(i - span // 2, 0), m - span)
    place = start[:, None] + np.arange(span)
    base = np.stack([tricube(span, k) for k in range(span)])[i - start]
    t = 2.0 * np.arange(span) / (span - 1) - 1.0
    basis = np.stack([np.polynomial.legendre.legval(t, np.eye(degree + 1)[k]) for k in range(degree + 1)], axis=1)
    here = basis[i - start]
    out, r = y, np.ones(m)
    for k in range(passes + 1):
        w = (base * r[place]) ** 2
        normal = np.einsum("ij,ja,jb->iab", w, basis, basis)
        right = np.einsum("ij,ja,ij->ia", w, basis, y[place])
        try:
            c = np.linalg.solve(normal, right[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            c = np.einsum("iab,ib->ia", np.linalg.pinv(normal), right)
        out = (c * here).sum(axis=1)
        if k < passes:
            r = robust_weights(np.abs(out - y))
    return out


def with_lowess(frame: DataFrame, column: str, out: str, degree: int, span: int, passes: int) -> DataFrame:
    """``frame`` with the smoothed array ``out`` of the array ``column``; null and short series give null."""

    @F.pandas_udf("array<double>")
    def smooth(series: pd.Series) -> pd.Series:
        return series.map(lambda y: None if y is None or len(y) < span else lowess(np.asarray(y, dtype=np.float64), degree, span, passes))

    return frame.withColumn(out, smooth(F.col(column).cast("array<double>")))
