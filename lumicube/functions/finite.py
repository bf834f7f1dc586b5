"""Finite values: the reference has no null, so NaN and infinities mark what is invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite(x: Column) -> Column:
    """The value, or null."""
    return F.when(is_finite(x), x)


def statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, variance (n - 1), sdev, min, max, cv and median of the finite values; NaN where undefined."""
    v = finite(F.col(value))
    nan = F.lit(float("nan"))
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.coalesce(F.avg(v), nan).alias("mean"),
        F.coalesce(F.var_samp(v), nan).alias("variance"),
        F.coalesce(F.stddev_samp(v), nan).alias("sdev"),
        F.coalesce(F.min(v), nan).alias("min"),
        F.coalesce(F.max(v), nan).alias("max"),
        F.coalesce(F.stddev_samp(v) / F.nullif(F.avg(v), F.lit(0.0)), nan).alias("cv"),
        F.coalesce(F.median(v), nan).alias("median"),
    )


def linear_regression(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Simple linear regression over the pairs of finite values: count, slope, intercept, r2, sigma2 and the
    standard errors, all from built-in aggregates."""
    ok = is_finite(F.col(x)) & is_finite(F.col(y))
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    sums = rows.groupBy(*keys).agg(
        F.regr_count(b, a).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
        F.regr_sxx(b, a).alias("sxx"),
        F.regr_syy(b, a).alias("syy"),
        F.regr_sxy(b, a).alias("sxy"),
        F.regr_avgx(b, a).alias("avgx"),
    )
    sigma2 = F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), F.when(F.col("n") > 2, F.col("n") - 2))
    sums = sums.withColumn("sigma2", sigma2)
    return sums.withColumn("slope_error", F.sqrt(F.try_divide("sigma2", "sxx"))).withColumn(
        "intercept_error", F.sqrt(F.col("sigma2") * (1 / F.col("n") + F.try_divide(F.col("avgx") * F.col("avgx"), F.col("sxx"))))
    )
