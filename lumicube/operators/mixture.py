"""Gaussian mixtures with full covariances, started by k-means on features scaled to [0, 1].

Every iteration is one aggregate over the pixels: weights, and first and second moments about the current means; a few
numbers a cluster reach the driver.  Densities are column arithmetic with the inverse Cholesky factors as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    covariance: np.ndarray
    prior: float


def normalised(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with every feature scaled to [0, 1] by its range; a constant feature becomes 0."""
    ends = rows.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(features) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = {n: (ends[f"lo{i}"] or 0.0, ((ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0)) or 1.0) for i, n in enumerate(features)}
    return rows.withColumns({n: (F.col(n) - F.lit(float(lo))) / F.lit(float(span)) for n, (lo, span) in scale.items()})


def _nearest(features: Sequence[str], centres: np.ndarray) -> Column:
    """Index of the nearest centre; the first of equals."""
    away = [sum(((F.col(f) - F.lit(float(c))) * (F.col(f) - F.lit(float(c))) for f, c in zip(features, row, strict=True)), F.lit(0.0)) for row in centres]
    return F.array_position(F.array(*away), F.array_min(F.array(*away))) - 1


def first_centres(rows: DataFrame, features: Sequence[str], keys: Sequence[str], clusters: int, seed: int = 31415) -> np.ndarray:
    """Features of the pixels whose key hashes are smallest."""
    picked = rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(clusters).select(*features).collect()
    if len(picked) < clusters:
        raise ValueError("there are fewer pixels than clusters")
    return np.array(picked, dtype=np.float64)


def kmeans(rows: DataFrame, features: Sequence[str], centres: np.ndarray, iterations: int) -> np.ndarray:
    """Centres after so many iterations; a centre without pixels stays where it is."""
    centres = centres.copy()
    for _ in range(iterations):
        means = rows.groupBy(_nearest(features, centres).alias("k")).agg(*[F.avg(f).alias(f) for f in features]).collect()
        for r in means:
            centres[r["k"]] = [r[f] for f in features]
    return centres


def _moments(weights: Sequence[Column], features: Sequence[str], means: np.ndarray) -> list[Column]:
    out = [F.count("*").alias("n")]
    for k, (w, mean) in enumerate(zip(weights, means, strict=True)):
        d = [F.col(f) - F.lit(float(m)) for f, m in zip(features, mean, strict=True)]
        out.append(F.sum(w).alias(f"g{k}"))
        out += [F.sum(w * d[i]).alias(f"a{k}_{i}") for i in range(len(d))]
        out += [F.sum(w * d[i] * d[j]).alias(f"b{k}_{i}_{j}") for i in range(len(d)) for j in range(i + 1)]
    return out


def _gaussians(r, means: np.ndarray, around_means: bool = False) -> list[Gaussian]:
    d = means.shape[1]
    out = []
    for k, mean in enumerate(means):
        g = r[f"g{k}"] or 0.0
        if not g > 0:
            raise ArithmeticError("a cluster lost all pixels")
        shift = np.array([r[f"a{k}_{i}"] / g for i in range(d)])
        second = np.array([[r[f"b{k}_{max(i, j)}_{min(i, j)}"] / g for j in range(d)] for i in range(d)])
        out.append(Gaussian(mean if around_means else mean + shift, second if around_means else second - np.outer(shift, shift), g / r["n"]))
    return out


def start(rows: DataFrame, features: Sequence[str], centres: np.ndarray) -> list[Gaussian]:
    """Priors and covariances of the pixels nearest to each centre; a rank-deficient covariance gets the identity added."""
    marked = rows.withColumn("_k", _nearest(features, centres))
    weights = [(F.col("_k") == k).cast("double") for k in range(len(centres))]
    found = _gaussians(marked.agg(*_moments(weights, features, centres)).first(), centres, around_means=True)
    full = np.eye(centres.shape[1])
    return [g if np.linalg.matrix_rank(g.covariance) == len(full) else Gaussian(g.mean, g.covariance + full, g.prior) for g in found]


def with_posteriors(rows: DataFrame, features: Sequence[str], mixture: Sequence[Gaussian], out: str = "posterior") -> DataFrame:
    """``rows`` with the probabilities of the mixture's parts, relative to the largest density."""
    keep = rows.columns
    logs = []
    for g in mixture:
        factor = np.linalg.inv(np.linalg.cholesky(g.covariance))
        d = [F.col(f) - F.lit(float(m)) for f, m in zip(features, g.mean, strict=True)]
        steps = [sum((F.lit(float(factor[i, j])) * d[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(d))]
        constant = math.log(g.prior) - 0.5 * len(d) * math.log(2 * math.pi) + float(np.log(np.diag(factor)).sum())
        logs.append(F.lit(constant) - 0.5 * sum((s * s for s in steps), F.lit(0.0)))
    names = [f"_l{k}" for k in range(len(logs))]
    rows = rows.select(*keep, *[x.alias(n) for n, x in zip(names, logs, strict=True)])
    rows = rows.withColumn("_top", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    rows = rows.select(*keep, *[F.exp(F.col(n) - F.col("_top")).alias(n) for n in names]).withColumn("_sum", sum((F.col(n) for n in names), F.lit(0.0)))
    return rows.select(*keep, F.array(*[F.col(n) / F.col("_sum") for n in names]).alias(out))


def em(rows: DataFrame, features: Sequence[str], mixture: Sequence[Gaussian], iterations: int) -> list[Gaussian]:
    """Expectation and maximisation; a covariance that collapses goes back to the one that it started with."""
    first, now = list(mixture), list(mixture)
    for _ in range(iterations):
        marked = with_posteriors(rows.select(*features), features, now)
        weights = [F.get("posterior", F.lit(k)) for k in range(len(now))]
        found = _gaussians(marked.agg(*_moments(weights, features, np.stack([g.mean for g in now]))).first(), np.stack([g.mean for g in now]))
        flat = [np.linalg.svd(g.covariance, compute_uv=False).min() < np.finfo(float).eps for g in found]
        now = [Gaussian(g.mean, first[k].covariance, g.prior) if flat[k] else g for k, g in enumerate(found)]
    return now


def find_mixture(rows: DataFrame, features: Sequence[str], keys: Sequence[str], clusters: int, kmeans_steps: int, em_steps: int) -> list[Gaussian]:
    """The mixture of the scaled features of ``rows``, which hold them normalised; computed once and held for all rounds."""
    kept = rows.select(*dict.fromkeys([*keys, *features])).persist()
    try:
        centres = kmeans(kept, features, first_centres(kept, features, keys, clusters), kmeans_steps)
        return em(kept, features, start(kept, features, centres), em_steps)
    finally:
        kept.unpersist()
