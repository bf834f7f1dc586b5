"""Mixture clustering, classification and endmembers.

A clustering step is one aggregate over the pixels: the clusters' weights and first and second moments about the
current means, one column each, so that no row is repeated by cluster.  Only these few numbers reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..params import ClusterParams


@dataclass(frozen=True)
class Cluster:
    mean: tuple[float, ...]
    variance: tuple[float, ...]
    prior: float


def _square(c: Column) -> Column:
    return c * c


def log_densities(features: Sequence[str], clusters: Sequence[Cluster]) -> list[Column]:
    out = []
    for c in clusters:
        det = math.prod(c.variance)
        if not det > 0:
            raise ArithmeticError("a cluster's covariance is singular")
        norm = -0.5 * (len(features) * math.log(2 * math.pi) + math.log(det))
        dist = sum((_square(F.col(f) - m) / v for f, m, v in zip(features, c.mean, c.variance, strict=True)), F.lit(0.0))
        out.append(F.lit(norm) - 0.5 * dist)
    return out


def with_posteriors(rows: DataFrame, features: Sequence[str], clusters: Sequence[Cluster], ignored: Sequence[int] = (), out: str = "posterior") -> DataFrame:
    """``rows`` with the clusters' probabilities: prior times density, normalised over those not ignored (theirs are 0).

    Densities are taken relative to the largest, so that far pixels don't end as 0 / 0.  Each step is a projection,
    so that a density is evaluated once a pixel.
    """
    keep = rows.columns
    logs = [F.lit(float("-inf")) if k in ignored else d + math.log(c.prior) for k, (d, c) in enumerate(zip(log_densities(features, clusters), clusters, strict=True))]
    rows = rows.select(*keep, *[x.alias(f"_l{k}") for k, x in enumerate(logs)])
    names = [f"_l{k}" for k in range(len(logs))]
    rows = rows.withColumn("_top", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    rows = rows.select(*keep, *[F.exp(F.col(n) - F.col("_top")).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0.0))
    rows = rows.withColumn("_sum", total)
    return rows.select(*keep, F.array(*[F.col(n) / F.col("_sum") for n in names]).alias(out))


def class_index(posterior: str = "posterior") -> Column:
    """The first class above one half, else the first of the most probable; from 0."""
    return (F.array_position(posterior, F.array_max(posterior)) - 1).cast("int")


def em_step(rows: DataFrame, features: Sequence[str], clusters: Sequence[Cluster]) -> list[Cluster]:
    """One expectation-maximisation step with diagonal covariances."""
    marked = with_posteriors(rows.select(*features), features, clusters)
    sums = [F.count("*").alias("n")]
    for k, c in enumerate(clusters):
        g = F.get("posterior", F.lit(k))
        sums.append(F.sum(g).alias(f"g{k}"))
        for j, (f, m) in enumerate(zip(features, c.mean, strict=True)):
            d = F.col(f) - m
            sums += [F.sum(g * d).alias(f"a{k}_{j}"), F.sum(g * d * d).alias(f"b{k}_{j}")]
    r = marked.agg(*sums).first()
    out = []
    for k, c in enumerate(clusters):
        g = r[f"g{k}"]
        if not g > 0:
            raise ArithmeticError("a cluster lost all pixels")
        shift = [r[f"a{k}_{j}"] / g for j in range(len(features))]
        out.append(Cluster(tuple(m + s for m, s in zip(c.mean, shift, strict=True)), tuple(r[f"b{k}_{j}"] / g - s * s for j, s in enumerate(shift)), g / r["n"]))
    return out


class Lcg:
    """The documented 48-bit linear congruential generator of the Java class library."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _bits31(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> 17

    def below(self, bound: int) -> int:
        """A number from 0 to ``bound`` - 1; draws that would favour small numbers are drawn again."""
        if bound & (bound - 1) == 0:
            return (bound * self._bits31()) >> 31
        while True:
            bits = self._bits31()
            value = bits % bound
            if bits - value + bound - 1 < 1 << 31:
                return value


def initial_clusters(rows: DataFrame, features: Sequence[str], index: str, params: ClusterParams) -> list[Cluster]:
    """Means from pixels drawn with replacement by their index 0 .. n-1, unit variances and equal priors."""
    n, draw = rows.count(), Lcg(params.seed)
    at = [draw.below(n) for _ in range(params.clusters)]
    found = {r[index]: tuple(float(r[f]) for f in features) for r in rows.filter(F.col(index).isin(sorted(set(at)))).select(index, *features).collect()}
    return [Cluster(found[i], (1.0,) * len(features), 1.0 / params.clusters) for i in at]


def by_prior(c: Cluster) -> float:
    return -c.prior


def find_clusters(rows: DataFrame, features: Sequence[str], initial: Sequence[Cluster], iterations: int, order: Callable[[Cluster], float] = by_prior) -> list[Cluster]:
    """A fixed number of steps over persisted features; clusters in ascending ``order``, largest prior first by default."""
    kept = rows.select(*features).persist()
    clusters = list(initial)
    try:
        for _ in range(iterations):
            clusters = em_step(kept, features, clusters)
    finally:
        kept.unpersist()
    return sorted(clusters, key=order)


def cloud_probability(posterior: str, cloud: Sequence[int]) -> Column:
    return sum((F.get(posterior, F.lit(k)) for k in cloud), F.lit(0.0))


def cloud_spectrum(rows: DataFrame, cloud: Sequence[int], bright: str, white: str, spectrum: str, order: Sequence[str]) -> DataFrame:
    """One row: the spectrum of the cloud pixel with the largest bright / white ratio, the first of equals in
    ``order``; no row if there is none."""
    ok = (F.col(white) > 0) & F.array_max("posterior").isNotNull()
    is_cloud = F.exists(F.array(*[F.get("posterior", F.lit(k)) for k in cloud]), lambda p: p > 0.5)
    found = rows.filter(ok & is_cloud)
    key = F.struct((F.col(bright) / F.col(white)).alias("ratio"), *[(-F.col(c)).alias(c) for c in order])
    return found.agg(F.max_by(F.struct(*[F.col(c) for c in order], F.col(spectrum)), key).alias("best")).filter("best IS NOT NULL").select("best.*")


def class_spectra(rows: DataFrame, earth: Sequence[int], spectrum: str, bands: int) -> DataFrame:
    """class, n, mean spectrum (array) of the pixels with more than one half for a surface class."""
    first = F.array_position(F.transform("posterior", lambda p: p > 0.5), True) - 1
    kept = rows.withColumn("class", first.cast("int")).filter(F.col("class").isin(list(earth)))
    means = [F.avg(F.get(spectrum, F.lit(b))).alias(f"_{b}") for b in range(bands)]
    grouped = kept.groupBy("class").agg(F.count("*").alias("n"), *means)
    return grouped.select("class", "n", F.array(*[f"_{b}" for b in range(bands)]).alias("spectrum"))
