"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample, down to leaves of a few sample rows, and every row is sent down to a leaf.  A
query's leaves come from a priority queue over the tree: the nearest open child is taken next, and a leaf taken is a
leaf visited.  How many leaves are visited is calibrated: for some rows the exact neighbours are found in one pass over
all rows, and visits widen until the calibration rows' neighbours are found with the wanted recall.

Queries meet rows by an equality join on groups of neighbouring leaves (leaves are numbered by subtree): a query goes
to the groups of its leaves alone and is compared with the rows of its leaves alone.  A leaf with many rows, such as
one of many copies, is dealt over several groups.  What the driver holds is one number a leaf, of MAX_LEAVES at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import _bytes as B

#: Rows that the tree is fitted on at most (about), rows that recall is calibrated on, and the recall to reach.
SAMPLE, CALIBRATION, RECALL = 50_000, 64, 0.95
#: Leaves hold some LEAF_ROWS rows of the sample; MAX_LEAVES at most.
BRANCHES, LEAF_ROWS, MAX_LEAVES, ROUNDS = 8, 10, 20_000, 6
#: Rows of one group, and queries that a group meets at a time, on average.
GROUP_ROWS, GROUP_QUERIES = 1000, 20_000


@dataclass
class Node:
    centers: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    leaves: int
    dim: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest child from the root down; ties to the first child."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
                continue
            near = _nearest(x[rows], node.centers)
            todo += [(child, rows[near == k]) for k, child in enumerate(node.children) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by the best-bin-first traversal."""
        heap: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        tick = 1
        while heap:
            node = heapq.heappop(heap)[2]
            if node.leaf >= 0:
                yield node.leaf
                continue
            for d, child in zip(((node.centers - q) ** 2).sum(axis=1).tolist(), node.children, strict=True):
                heapq.heappush(heap, (d, tick, child))
                tick += 1


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(axis=1) - 2 * (x @ centers.T), axis=1)


def fit_tree(sample: np.ndarray, rows: int, seed: int = 13) -> Tree:
    """Split while a node holds more than LEAF_ROWS of ``rows`` by the sample's share, MAX_LEAVES leaves at most."""
    r = np.random.default_rng(seed)
    share = max(1.0, rows / max(1, len(sample)))
    want = max(LEAF_ROWS, rows / MAX_LEAVES)
    root, leaves = Node(), 0
    todo = [(root, np.arange(len(sample)))]
    while todo:
        node, own = todo.pop()
        x = sample[own]
        distinct = np.unique(x, axis=0) if len(x) <= 4 * BRANCHES else x
        if len(own) * share <= want or len(own) < 2 * BRANCHES or len(np.unique(distinct[: 4 * BRANCHES * 8], axis=0)) < BRANCHES:
            node.leaf, leaves = leaves, leaves + 1
            continue
        centers = x[r.choice(len(x), BRANCHES, replace=False)]
        for _ in range(ROUNDS):
            near = _nearest(x, centers)
            for k in range(BRANCHES):
                if (near == k).any():
                    centers[k] = x[near == k].mean(axis=0)
        near = _nearest(x, centers)
        parts = [k for k in range(BRANCHES) if (near == k).any()]
        if len(parts) < 2:
            node.leaf, leaves = leaves, leaves + 1
            continue
        node.centers, node.children = centers[parts], [Node() for _ in parts]
        todo += [(child, own[near == k]) for child, k in zip(node.children, parts, strict=True)]
    return Tree(root, leaves, sample.shape[1] if sample.ndim == 2 else 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def top_k(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k nearest rows but those of the query's id, by exact distance, ties to the smaller id."""
    d = ((x - q) ** 2).sum(axis=1)
    d[ids == query_id] = np.inf
    n = min(k, int(np.isfinite(d).sum()))
    if not n:
        return []
    edge = np.partition(d, n - 1)[n - 1]
    near = np.flatnonzero(d <= edge)
    near = near[np.lexsort((ids[near], d[near]))][:n]
    return [(int(ids[i]), float(np.sqrt(d[i]))) for i in near]


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part: id and vector there, not zero, all components finite."""
    finite = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return out.filter("vec_id IS NOT NULL AND vec IS NOT NULL").filter(F.forall("vec", finite) & F.exists("vec", lambda v: v != 0))


def _exact(rows: DataFrame, ids: np.ndarray, q: np.ndarray, tree: Tree, k: int) -> list[tuple[int, int, float]]:
    """(calibration row, leaf, distance) of the exact k nearest of a few rows: k a task, then k of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = np.asarray(batch.column(0)), _matrix(batch.column(1), tree.dim)
            leaf = dict(zip(own.tolist(), tree.assign(x).tolist(), strict=True))
            for j in range(len(ids)):
                near = [(d, i, leaf[i]) for i, d in top_k(own, x, int(ids[j]), q[j], k)]
                best[j] = sorted(best.get(j, []) + near)[:k]
        flat = [(j, *x) for j, xs in best.items() for x in xs]
        if flat:
            cols = list(zip(*flat, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], names=["j", "d", "vec_id", "leaf"])

    near = rows.mapInArrow(run, "j int, d double, vec_id long, leaf int")
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("j").orderBy("d", "vec_id"))).filter(F.col("n") <= k)
    return [(r["j"], r["leaf"], r["d"]) for r in first.toLocalIterator()]


def calibrate(rows: DataFrame, n: int, tree: Tree, k: int, recall: float = RECALL) -> int:
    """Leaves to visit, so that the calibration rows' exact neighbours are found with the wanted recall."""
    part = max(1, n // CALIBRATION)
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(part)) == 0).orderBy("vec_id").limit(CALIBRATION).toArrow()
    if not chosen.num_rows:
        return tree.leaves
    ids, q = np.asarray(chosen.column("vec_id")), _matrix(chosen.column("vec"), tree.dim)
    wanted: dict[int, list[int]] = {}
    for j, leaf, _ in _exact(rows, ids, q, tree, k):
        wanted.setdefault(j, []).append(leaf)
    ranks: list[int] = []
    for j, leaves in wanted.items():
        left = set(leaves)
        for place, leaf in enumerate(tree.visit(q[j])):
            if leaf in left:
                ranks += [place] * leaves.count(leaf)
                left.discard(leaf)
                if not left:
                    break
    ranks.sort()
    return ranks[min(len(ranks), int(np.ceil(recall * len(ranks)))) - 1] + 1 if ranks else tree.leaves


def pack(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First group and number of groups of each leaf by its rows, and the number of groups: neighbouring leaves share
    a group of about ``size`` rows, a larger leaf has several of its own."""
    first, parts, group, held = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64), 0, 0
    for leaf in np.flatnonzero(counts).tolist():
        own = int(counts[leaf])
        n = -(-own // size)
        if n > 1 or held + own > size:
            group += held > 0
            held = 0
        first[leaf], parts[leaf] = group, n
        if n > 1:
            group += n
        else:
            held += own
    return first, parts, group + (held > 0)


def partial_top_k(own: pa.Table, asked: pa.Table, dim: int, k: int) -> pa.Table:
    """The k nearest rows of a group for each query, among the rows of the query's leaves."""
    found: list[tuple[int, int, float]] = []
    if own.num_rows and asked.num_rows:
        leaf = np.asarray(own.column("leaf"))
        order = np.argsort(leaf, kind="stable")
        leaf, ids, x = leaf[order], np.asarray(own.column("vec_id"))[order], _matrix(own.column("vec"), dim)[order]
        for i, q, wanted in zip(asked.column("query_id").to_pylist(), _matrix(asked.column("q"), dim), asked.column("leaves").to_pylist(), strict=True):
            lo, hi = np.searchsorted(leaf, wanted, "left"), np.searchsorted(leaf, wanted, "right")
            n = hi - lo
            some = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found += [(i, v, d) for v, d in top_k(ids[some], x[some], i, q, k)]
    cols = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def fitted(base: DataFrame, n: int, dim: int, k: int, recall: float) -> tuple[Tree, int]:
    """The tree of the rows, and the leaves that a query visits."""
    keep = min(1.0, SAMPLE / n)
    sample = base.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(keep * 1_000_000)).toArrow()
    own = _matrix(sample.column("vec"), dim)[np.argsort(np.asarray(sample.column("vec_id")), kind="stable")]
    tree = fit_tree(own, n)
    return tree, calibrate(base, n, tree, k, recall)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by Euclidean distance in double.

    Rows and queries with a null id or vector, a zero vector, a null or non-finite component or a length other
    than the commonest take no part.  A row never is its own query's neighbour: candidates with the query's id are
    passed over.  Ties go to the smaller id; repeated rows are candidates each; a query id that repeats is searched
    once, with its smallest vector.  Fewer candidates than k give them all; empty tables give no rows; other columns
    are not read.
    """
    spark = rows.sparkSession
    base, asked = usable(rows, id_col, vec_col), usable(queries, id_col, vec_col)
    sizes = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["dim"], sizes["n"]
    base, asked = base.filter(F.size("vec") == dim), asked.filter(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    tree, visits = fitted(base, n, dim, k, recall)
    shared = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES leaves

    def leaf_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tree_leaves, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(shared.value.assign(_matrix(batch.column(0), dim)), minlength=tree_leaves)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["leaf", "n"])

    tree_leaves = tree.leaves
    counted = base.select("vec").mapInArrow(leaf_counts, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(tree_leaves, np.int64)
    counts[np.asarray(counted.column("leaf"))] = np.asarray(counted.column("n"))
    first, parts, groups = pack(counts, GROUP_ROWS)
    seen = min(1.0, visits / max(1, np.count_nonzero(counts)))
    deals = max(1, -(-int(seen * asked.count()) // GROUP_QUERIES))
    places = spark.sparkContext.broadcast((first, parts))  # two numbers a leaf

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = places.value
        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int32)
            ids = np.asarray(batch.column(0)).astype(np.uint64)
            grp = first[leaf] + (B.mix(ids) % np.maximum(parts[leaf], 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32()), pa.array(grp)], names=["vec_id", "vec", "leaf", "grp"])

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = places.value
        for batch in batches:
            ids, at, grp, leaves = batch.column(0).to_pylist(), [], [], []
            for j, q in enumerate(_matrix(batch.column(1), dim)):
                tour: dict[int, list[int]] = {}
                for leaf in islice(shared.value.visit(q), visits):
                    for g in range(first[leaf], first[leaf] + parts[leaf]):
                        tour.setdefault(g, []).append(leaf)
                at += [j] * len(tour)
                grp += tour.keys()
                leaves += tour.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in at], pa.int64()), batch.column(1).take(pa.array(at, pa.int32())), pa.array(grp, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))],
                names=["query_id", "q", "grp", "leaves"],
            )

    left = base.mapInArrow(to_leaf, "vec_id long, vec array<double>, leaf int, grp long").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    # Few bytes, but much to compute for each: adaptive execution would put all queries into one task.
    spread = asked.repartition(spark.sparkContext.defaultParallelism, "vec_id")
    right = spread.mapInArrow(to_groups, "query_id long, q array<double>, grp long, leaves array<int>").withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int"))
    found = left.groupBy("grp", "deal").cogroup(right.groupBy("grp", "deal")).applyInArrow(lambda own, here: partial_top_k(own, here, dim, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
