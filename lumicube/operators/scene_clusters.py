"""Mixture clustering of many scenes at once, with the state of each scene's iteration in a table.

Pixels are packed once into blocks of at most BLOCK pixels of a scene.  A round joins the blocks with the states of the
scenes that still move, turns each block into each cluster's weight, mean and squared deviations, merges these by
scene and writes the new states; the number of scenes that still move is all that the driver sees.
A scene of any size is many blocks, and scenes that have come to rest, or lost a cluster, take no further part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..params import ClusterParams
from .clustering import Lcg
from .tables import cut, delete_cut

#: Pixels of a block; rows of the table of states up to which it is broadcast (some 2 kB each), instead of a shuffle of blocks.
BLOCK, MAX_BROADCAST_STATES = 4096, 20_000
#: Blocks that a task reads in a round, about.
BLOCKS_A_TASK = 64
STATE = "scene string, rounds int, done boolean, lost boolean, means array<double>, variances array<double>, priors array<double>"
_NAMES = ["scene", "rounds", "done", "lost", "means", "variances", "priors"]


def initial_states(pixels: DataFrame, features: Sequence[str], params: ClusterParams) -> DataFrame:
    """STATE of every scene of ``pixels`` (scene, index, features), where ``index`` counts a scene's pixels from 0.

    Means are the features of pixels drawn with replacement, as for one scene: the same seed and the scene's own number of
    pixels.  Variances are 1 and priors equal.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for scene, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lcg = Lcg(params.seed)
                rows += [(scene, k, lcg.below(n)) for k in range(params.clusters)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["scene", "k", "index"])

    sizes = pixels.groupBy(F.col("scene").cast("string").alias("scene")).agg(F.count("*").alias("n"))
    drawn = sizes.mapInArrow(draw, "scene string, k int, index long")
    named = pixels.select(F.col("scene").cast("string").alias("scene"), F.col("index").cast("long").alias("index"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    means = drawn.join(named, ["scene", "index"]).groupBy("scene").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"])).alias("means"))
    size, one = params.clusters * len(features), F.lit(1.0)
    return means.select(
        "scene", F.lit(0).alias("rounds"), F.lit(False).alias("done"), F.lit(False).alias("lost"), "means", F.array_repeat(one, size).alias("variances"), F.array_repeat(one / params.clusters, params.clusters).alias("priors")
    )


def pack(pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    """scene, values: blocks of at most BLOCK pixels, pixel after pixel; pixels with a feature that isn't finite are left out."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    finite = reduce(lambda p, q: p & q, (F.coalesce(F.abs(F.col(f).cast("double")) < float("inf"), F.lit(False)) for f in features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def out(scene: str) -> pa.RecordBatch:
            flat = np.concatenate(held.pop(scene))
            n = size.pop(scene)
            ends = np.minimum(np.arange(-(-n // BLOCK) + 1) * BLOCK, n) * len(features)
            return pa.RecordBatch.from_arrays([pa.array([scene] * (len(ends) - 1), pa.string()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=["scene", "values"])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            flat = np.asarray(batch.column(1).flatten()).reshape(-1, len(features))
            code = np.asarray(names.indices)
            for c, scene in enumerate(names.dictionary.to_pylist()):
                own = flat[code == c].ravel()
                held.setdefault(scene, []).append(own)
                size[scene] = size.get(scene, 0) + len(own) // len(features)
                if size[scene] >= BLOCK:
                    yield out(scene)
            if len(held) > 1000:  # scenes of few pixels
                for scene in list(held):
                    yield out(scene)
        for scene in list(held):
            yield out(scene)

    rows = pixels.filter(F.col("scene").isNotNull() & finite).select(F.col("scene").cast("string").alias("scene"), values.alias("values"))
    return rows.mapInArrow(run, "scene string, values array<double>")


def _sums(x: np.ndarray, means: np.ndarray, variances: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """Number of pixels, then each cluster's weight, mean and squared deviations from that mean."""
    with np.errstate(all="ignore"):
        norm = np.log(priors) - 0.5 * (means.shape[1] * math.log(2 * math.pi) + np.log(variances).sum(axis=1))
        d = x[:, None, :] - means
        log = norm - 0.5 * (d * d / variances).sum(axis=2)
        e = np.exp(log - log.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        weight = p.sum(axis=0)
        own = np.einsum("ik,ij->kj", p, x) / weight[:, None]
        d = x[:, None, :] - own
        return np.concatenate(([len(x)], weight, own.ravel(), np.einsum("ik,ikj->kj", p, d * d).ravel()))


def _merged(a: np.ndarray, b: np.ndarray, clusters: int, size: int) -> np.ndarray:
    """The sums of two sets of pixels.  Deviations add without differences of large numbers, so that a cluster that
    closes in on one pixel keeps its small variance."""
    (wa, ma, da), (wb, mb, db) = (_parted(v, clusters, size) for v in (a, b))
    with np.errstate(all="ignore"):
        w = wa + wb
        share = (wb / w)[:, None]
        # A cluster without weight in one of the sets has no mean there.
        ma, mb = np.where(wa[:, None] == 0, mb, ma), np.where(wb[:, None] == 0, ma, mb)
        da, db = np.where(wa[:, None] == 0, 0.0, da), np.where(wb[:, None] == 0, 0.0, db)
        between = mb - ma
        return np.concatenate(([a[0] + b[0]], w, (ma + between * share).ravel(), (da + db + between * between * wa[:, None] * share).ravel()))


def _parted(sums: np.ndarray, clusters: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and squared deviations by cluster."""
    both = sums[1 + clusters :].reshape(2, clusters, size)
    return sums[1 : 1 + clusters], both[0], both[1]


def _round(blocks: DataFrame, states: DataFrame, n_states: int, clusters: int, size: int, tolerance: float, keep: bool) -> DataFrame:
    """The states after one step of expectation and maximisation."""
    joined = blocks.join(F.broadcast(states) if n_states <= MAX_BROADCAST_STATES else states, "scene")

    def arrays(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, v, p = (np.asarray(batch.column(n)[r].values) for n in ("means", "variances", "priors"))
        return m.reshape(clusters, size), v.reshape(clusters, size), p

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, tuple]] = {}
        for batch in batches:
            for r, scene in enumerate(batch.column("scene").to_pylist()):
                state = arrays(batch, r)
                made = _sums(np.asarray(batch.column("values")[r].values).reshape(-1, size), *state)
                held[scene] = (_merged(held[scene][0], made, clusters, size), held[scene][1]) if scene in held else (made, (batch.column("rounds")[r].as_py(), *state))
            if len(held) > 1000:
                yield flat(held)
                held = {}
        if held:
            yield flat(held)

    def flat(held: dict) -> pa.RecordBatch:
        lists = lambda vs: pa.array([np.ravel(v).tolist() for v in vs], pa.list_(pa.float64()))
        rows = list(held.values())
        cols = [pa.array(list(held), pa.string()), lists(s for s, _ in rows), pa.array([st[0] for _, st in rows], pa.int32()), *(lists(st[k] for _, st in rows) for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays(cols, names=["scene", "sums", "rounds", "means", "variances", "priors"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        state: dict[str, tuple] = {}
        for batch in batches:
            for r, scene in enumerate(batch.column("scene").to_pylist()):
                own = np.asarray(batch.column("sums")[r].values)
                total[scene] = _merged(total[scene], own, clusters, size) if scene in total else own
                state.setdefault(scene, (batch.column("rounds")[r].as_py(), *arrays(batch, r)))
        out = []
        for scene, s in total.items():
            rounds, means, variances, priors = state[scene]
            weight, mean, squares = _parted(s, clusters, size)
            with np.errstate(all="ignore"):
                new = mean, squares / weight[:, None], weight / s[0]
            lost = not ((weight > 0).all() and np.isfinite(s).all() and (new[1] > 0).all())
            if lost and keep:
                out.append((scene, rounds, True, True, means, variances, priors))
                continue
            rest = all(np.abs(a - b).max() <= tolerance for a, b in zip(new, (means, variances, priors), strict=True))
            out.append((scene, rounds + 1, rest, lost, *new))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols[:4], kinds, strict=True)), *(pa.array([np.ravel(v).tolist() for v in c], pa.list_(pa.float64())) for c in cols[4:])], names=_NAMES)

    sums = joined.mapInArrow(add, "scene string, sums array<double>, rounds int, means array<double>, variances array<double>, priors array<double>")
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, n_states // 1000)
    return sums.repartition("scene").mapInArrow(step, STATE).coalesce(tasks)  # few and short rows


def find_clusters(pixels: DataFrame, features: Sequence[str], states: DataFrame, iterations: int, tolerance: float = 0.0, keep: bool = True) -> DataFrame:
    """scene, k, mean, variance, prior, rounds, lost: the clusters of every scene, the largest prior first (k from 0).

    ``pixels`` have scene and the features, ``states`` are as from ``initial_states``.  A scene takes so many steps, or
    fewer if no number changes by more than ``tolerance`` in one; a scene of which a cluster loses all pixels or all
    variance in a step keeps the state before it and is ``lost``.  Without ``keep`` such a scene goes on with the
    numbers of the step: one without variance has no density, so that all numbers of the next step are NaN.  Pixels without a scene or with a feature that isn't
    finite are left out; scenes without a state or without pixels give no rows.
    """
    packed = cut(pack(pixels, features))
    # Every round reads the blocks: some of them a task, however many partitions the pixels had.
    blocks = packed.coalesce(max(packed.sparkSession.sparkContext.defaultParallelism, packed.count() // BLOCKS_A_TASK))
    at, done = cut(states), []
    clusters = None
    for _ in range(iterations):
        moving = at.agg(F.count("*").alias("n"), F.max(F.size("priors")).alias("k")).first()
        if not moving["n"]:
            break
        clusters = moving["k"]
        after = cut(_round(blocks, at, moving["n"], clusters, len(features), tolerance, keep))
        delete_cut(at)
        done.append(after.filter("done"))
        at = after.filter("NOT done")
    delete_cut(packed)
    final = reduce(DataFrame.unionByName, [*done, at])
    size = len(features)
    part = lambda c: F.slice(c, F.col("i") * size + 1, F.lit(size))
    each = final.select("*", F.posexplode("priors").alias("i", "prior"))
    order = F.array_sort(F.transform("priors", lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    place = F.array_position(F.transform(order, lambda s: s["i"]), F.col("i")) - 1
    return each.select("scene", place.cast("int").alias("k"), part("means").alias("mean"), part("variances").alias("variance"), "prior", "rounds", "lost")
