"""Exact top-k search by integer inner product in an M-tree of stored pages, best first.

Three levels of metric nodes are kept.  *Shelves* have a pivot from a bounded sample, a covering radius and the
largest norm; each row goes to the nearest pivot, and a shelf with many rows is dealt over several parts.  *Pages*
split a part around pivots of its own, down to PAGE_BYTES of vectors; a page is one stored row with its pivot, the
pivot's distance to the shelf's, covering radius and largest norm.  *Entries* are the rows of a page, with their
distances to the page's pivot.

An inner product is (|q|^2 + |x|^2 - d^2) / 2, so that a lower bound of the distance d is an upper bound of the score:
a node at distance D with radius r has d >= D - r, and a stored distance p to the parent gives D >= |Dp - p| without
computing D.  A query first descends into its most promising shelf alone, which gives it a k-th best score to beat;
then it meets every other shelf whose bound isn't below that score.  Within a shelf pages are taken by falling bound,
until the next bound is below the k-th best score so far, and entries are left out by their stored distances.
Nothing is left out that could be among the k best, so the result is exact.

Queries meet shelves in a shuffle by shelf, sorted so that a shelf's pages come before its queries: pages of one part
are held (SHELF_BYTES), queries stream by.  Rows are shuffled once a phase, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import _bytes as B
from ._spark import cut, scrap

#: Factor of the components before they are rounded down.
STEPS = 256.0
#: Rows that pivots are taken from at most (about), shelves, bytes of vectors of a part of a shelf and of a page.
SAMPLE, MAX_SHELVES, SHELF_BYTES, PAGE_BYTES = 20_000, 4096, 1 << 23, 1 << 16
#: Products of norms up to which scores are whole numbers in double precision.
EXACT = float(1 << 52)
#: Relative slack of bounds, above the rounding of distances.
SLACK = 1e-9
#: Score of no row; no score is below it.
NONE = -(2**63)
#: Parts that a query meets in the first round; each round goes WIDEN times as far down its list of parts.
WIDEN = 32
#: Rows that carry a query to its parts are made in batches of about so many.
ROUTED = 20_000


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, components times STEPS rounded down."""
    finite = lambda v: F.coalesce(F.abs(v.cast("double") * STEPS) < float("inf"), F.lit(False))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return out.filter("vec_id IS NOT NULL AND vec IS NOT NULL").filter(F.forall("vec", finite))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Components times STEPS, rounded down, as doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.floor(np.asarray(col.flatten(), dtype=np.float64) * STEPS).reshape(-1, dim)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of x to each of y."""
    with np.errstate(over="ignore", invalid="ignore"):  # NaN beyond the range of squares
        square = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(axis=1))


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, x.astype(kind).tobytes()


def _unpack(kind: str, raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.float64).reshape(-1, dim)


def choose_pivots(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """``n`` distinct rows of the sample at most, each taken far from those before (out of a few random ones)."""
    r = np.random.default_rng(seed)
    rows = np.unique(sample, axis=0)
    if len(rows) <= n:
        return rows
    taken = [int(r.integers(len(rows)))]
    near = distances(rows, rows[taken])[:, 0]
    while len(taken) < n:
        some = r.choice(len(rows), min(8, len(rows)), replace=False)
        best = int(some[np.argmax(near[some])])
        if near[best] == 0:
            best = int(np.argmax(near))
        taken.append(best)
        near = np.minimum(near, distances(rows, rows[[best]])[:, 0])
    return rows[taken]


def pages(ids: np.ndarray, x: np.ndarray, size: int, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pivot, rows) of pages of at most ``size`` rows: parts are split around pivots until they fit, copies by number."""
    todo = [np.argsort(ids, kind="stable")]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            yield x[own[len(own) // 2]], own
            continue
        centers = choose_pivots(x[own[:: max(1, len(own) // 1024)]], max(2, min(32, -(-len(own) // size))), seed)
        near = np.argmin(distances(x[own], centers), axis=1)
        parts = [own[near == k] for k in range(len(centers))]
        if max(map(len, parts)) == len(own):
            parts = [own[k : k + size] for k in range(0, len(own), size)]
        todo += [p for p in parts if len(p)]


@dataclass
class Shelves:
    """What the driver holds of the tree: MAX_SHELVES pivots at most, with radius, largest norm, first part and parts."""

    pivots: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return upper_bounds(q, self.pivots, distances(q, self.pivots), self.radius, self.norm)


def upper_bounds(q: np.ndarray, pivots: np.ndarray, d: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What no score of a query with a node's rows exceeds, by the triangle inequality and by Cauchy's; no bound (infinite)
    where squares are beyond double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        own = np.sqrt((q**2).sum(axis=1))[:, None]
        metric = (own**2 + norm**2 - np.maximum(0, d * (1 - SLACK) - radius) ** 2) / 2
        linear = q @ pivots.T + own * radius
        out = np.minimum(metric, linear) + SLACK * (own**2 + norm**2) + 0.5
    return np.where(np.isnan(out), np.inf, out)


@dataclass
class Page:
    """A stored page with its entries; ``gap`` is the pivot's distance to the shelf's pivot, ``to`` the entries' to the pivot."""

    pivot: np.ndarray
    gap: float
    radius: float
    norm: float
    ids: np.ndarray
    x: np.ndarray
    to: np.ndarray


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id; ``floor`` is the score to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.scores, self.ids, self.floor = np.full((n, k), NONE, np.int64), np.full((n, k), 2**63 - 1, np.int64), floor

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate((self.scores[at], scores), axis=1)
        i = np.concatenate((self.ids[at], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.scores.shape[1]]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.floor[at] = np.maximum(self.floor[at], self.scores[at, -1])


def search_shelf(shelf: list[Page], root: np.ndarray, own: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[Best, int]:
    """The k best rows of a shelf for each query that reach its ``floor``, and how many scores were computed."""
    best, computed = Best(len(q), k, floor.copy()), 0
    pivots = np.array([p.pivot for p in shelf])
    gap, radius, norm = (np.array([getattr(p, name) for p in shelf]) for name in ("gap", "radius", "norm"))
    with np.errstate(over="ignore", invalid="ignore"):
        length = lengths(q)
        exact = length.max(initial=0) * norm.max(initial=0) < EXACT
    if not exact:
        for p in shelf:
            best.add(np.arange(len(q)), *_long_scores(own, q, p))
        return best, len(q) * sum(len(p.ids) for p in shelf)
    up = distances(q, root[None])
    far = np.maximum(0, np.abs(up - gap) * (1 - SLACK) - radius)
    bound = (length[:, None] ** 2 + norm**2 - far**2) / 2 + SLACK * (length[:, None] ** 2 + norm**2) + 0.5
    needed = np.flatnonzero((bound >= best.floor[:, None]).any(axis=0))  # pages that the stored gap alone doesn't exclude
    d = np.full(bound.shape, np.nan)
    d[:, needed] = distances(q, pivots[needed])
    bound[:, needed] = np.minimum(bound[:, needed], upper_bounds(q, pivots[needed], d[:, needed], radius[needed], norm[needed]))
    bound = np.where(np.isnan(d), -np.inf, bound)
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(shelf)):
        page = order[:, turn]
        going = bound[np.arange(len(q)), page] >= best.floor
        if not going.any():
            break
        for j in np.unique(page[going]).tolist():
            p, at = shelf[j], np.flatnonzero(going & (page == j))
            size = length[at, None] ** 2 + (p.x**2).sum(axis=1)
            top = (size - np.maximum(0, np.abs(d[at, j, None] - p.to) - SLACK * (d[at, j, None] + p.to)) ** 2) / 2 + SLACK * size + 0.5
            some = np.flatnonzero((top >= best.floor[at, None]).any(axis=0))
            if not len(some):
                continue
            scores = (q[at] @ p.x[some].T).astype(np.int64)
            computed += scores.size
            scores[own[at, None] == p.ids[some]] = NONE
            best.add(at, scores, p.ids[some])
    return best, computed


def _long_scores(own: np.ndarray, q: np.ndarray, page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Scores beyond double precision, by Python's whole numbers, clipped to a long."""
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    scores = np.clip(whole(q) @ whole(page.x).T, NONE + 1, 2**63 - 1).astype(np.int64)
    scores[own[:, None] == page.ids] = NONE
    return scores, page.ids


def fit_shelves(base: DataFrame, n: int, dim: int) -> Shelves:
    """Pivots from the sample, and what one pass over all rows says of their shelves."""
    sc = base.sparkSession.sparkContext
    rows = max(1, min(SHELF_BYTES // (8 * max(1, dim)), max(512, n // (4 * sc.defaultParallelism))))
    sample = base.filter(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / n) * 1_000_000)).toArrow()
    own = _matrix(sample.column("vec"), dim)[np.argsort(np.asarray(sample.column("vec_id")), kind="stable")]
    pivots = choose_pivots(own if len(own) else np.zeros((1, dim)), min(MAX_SHELVES, -(-n // rows)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius, norm = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if len(x):
                d = distances(x, pivots)
                near = np.argmin(d, axis=1)
                count += np.bincount(near, minlength=len(pivots))
                np.maximum.at(radius, near, d[np.arange(len(x)), near])
                np.maximum.at(norm, near, lengths(x))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(radius[some]), pa.array(norm[some])], names=["shelf", "n", "radius", "norm"])

    found = base.select("vec").mapInArrow(measure, "shelf long, n long, radius double, norm double").groupBy("shelf").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).toArrow()
    at = np.asarray(found.column("shelf"))
    radius, norm, parts = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    radius[at], norm[at], parts[at] = np.asarray(found.column("radius")), np.asarray(found.column("norm")), -(-np.asarray(found.column("n")) // rows)
    return Shelves(pivots, radius, norm, np.cumsum(parts) - parts, parts)


ROW = "part int, turn int, n long, head binary, floor long, gap double, radius double, norm double, kind string, ids binary, x binary, dist binary"


def stored_pages(base: DataFrame, shelves: Shelves, dim: int) -> DataFrame:
    """One row a page (turn 0 of its part), in the layout ROW."""
    shared = base.sparkSession.sparkContext.broadcast(shelves)  # MAX_SHELVES pivots at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            near = np.argmin(distances(_matrix(batch.column(1), dim), own.pivots), axis=1)
            deal = (B.mix(np.asarray(batch.column(0)).astype(np.uint64)) % np.maximum(1, own.parts[near]).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(own.first[near] + deal, pa.int32())], names=["vec_id", "vec", "shelf", "part"])

    def build(table: pa.Table) -> pa.Table:
        ids, x = np.asarray(table.column("vec_id")), _matrix(table.column("vec"), dim)
        root = shared.value.pivots[table.column("shelf")[0].as_py()]
        rows = []
        for k, (pivot, own) in enumerate(pages(ids, x, max(1, PAGE_BYTES // (8 * max(1, dim))))):
            to = distances(x[own], pivot[None])[:, 0]
            kind, raw = _pack(x[own])
            rows.append((k, pivot.tobytes(), float(distances(pivot[None], root[None])[0, 0]), float(to.max()), float(lengths(x[own]).max()), kind, ids[own].astype("<i8").tobytes(), raw, to.tobytes()))
        n, part = len(rows), table.column("part")[0].as_py()
        k, head, gap, radius, norm, kind, who, raw, to = zip(*rows, strict=True)
        return pa.table({
            "part": pa.array([part] * n, pa.int32()), "turn": pa.array([0] * n, pa.int32()), "n": pa.array(k, pa.int64()), "head": pa.array(head), "floor": pa.nulls(n, pa.int64()), "gap": pa.array(gap),
            "radius": pa.array(radius), "norm": pa.array(norm), "kind": pa.array(kind), "ids": pa.array(who), "x": pa.array(raw), "dist": pa.array(to),
        })

    return base.mapInArrow(place, "vec_id long, vec array<double>, shelf int, part int").groupBy("part").applyInArrow(build, ROW)


def route(asked: DataFrame, shelves: Shelves, dim: int, done: int, reach: int) -> DataFrame:
    """Rows (turn 1) that carry each query (query_id, vec, floor) to the parts that stand at ``done`` up to ``reach`` in its
    list of parts by falling bound, and whose bound reaches its floor."""
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(shelves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            step = max(1, ROUTED // max(1, int(own.parts.sum())))
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                who, q, floor = np.asarray(piece.column(0)), _matrix(piece.column(1), dim), np.asarray(piece.column(2))
                bound = np.where(own.parts > 0, own.bounds(q), -np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")
                parts = own.parts[order]
                end = np.cumsum(parts, axis=1)
                begin = end - parts
                some = np.maximum(0, np.minimum(end, reach) - np.maximum(begin, done)) * (np.take_along_axis(bound, order, 1) >= floor[:, None])
                i, j = np.nonzero(some)
                n = some[i, j]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.maximum(begin[i, j], done) - begin[i, j], n)
                i, shelf = np.repeat(i, n), np.repeat(order[i, j], n)
                part = own.first[shelf] + (at + who[i] % own.parts[shelf]) % own.parts[shelf]
                heads = pa.array([row.tobytes() for row in q], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(who[i]), heads.take(pa.array(i)), pa.array(floor[i])], names=["part", "n", "head", "floor"])

    # Few bytes, but much to compute for each: adaptive execution would put all queries into one task.
    spread = asked.repartition(spark.sparkContext.defaultParallelism, "query_id").select("query_id", "vec", "floor")
    sent = spread.mapInArrow(run, "part int, n long, head binary, floor long").withColumn("turn", F.lit(1))
    for name, kind in (x.split() for x in ROW.split(", ")):
        if name not in sent.columns:
            sent = sent.withColumn(name, F.lit(None).cast(kind))
    return sent.select(*(x.split()[0] for x in ROW.split(", ")))


def meet(stored: DataFrame, sent: DataFrame, shelves: Shelves, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each part for each query sent there, if they reach the query's floor."""
    shared = stored.sparkSession.sparkContext.broadcast(shelves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf: list[Page] = []
        current = -1
        for batch in batches:
            part, turn, n = (np.asarray(batch.column(c)) for c in range(3))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(turn) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if lo == hi:
                    continue
                if part[lo] != current:
                    shelf, current = [], int(part[lo])
                rows = batch.slice(lo, hi - lo)
                heads = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.float64).reshape(-1, dim)
                if turn[lo] == 0:
                    gap, radius, norm, kind, ids, x, dist = (rows.column(c).to_pylist() for c in range(5, 12))
                    for r in range(hi - lo):
                        shelf.append(Page(heads[r], gap[r], radius[r], norm[r], np.frombuffer(ids[r], np.int64), _unpack(kind[r], x[r], dim), np.frombuffer(dist[r], np.float64)))
                    continue
                if not shelf:
                    continue
                root = shared.value.pivots[int(np.searchsorted(shared.value.first, current, "right")) - 1]
                own, floor = n[lo:hi], np.asarray(rows.column(4))
                best, _ = search_shelf(shelf, root, own, heads, floor, k)
                r, c = np.nonzero((best.scores >= floor[:, None]) & (best.scores != NONE))
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(best.ids[r, c]), pa.array(best.scores[r, c])], names=["query_id", "vec_id", "score"])

    tasks = int(min(max(1, shelves.parts.sum()), 20_000))
    both = stored.unionByName(sent).repartitionById(tasks, F.col("part") % tasks)
    return both.sortWithinPartitions("part", "turn", "n").mapInArrow(run, "query_id long, vec_id long, score long")


def top_products(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest inner product with each query, exactly.

    Components are taken times 256 and rounded down.  Rows and queries with a null id or vector, a null or non-finite
    component or a length other than the commonest take no part; zero vectors do.  A row never is its own query's
    result: candidates with the query's id are passed over.  Ties go to the smaller id; repeated rows are candidates
    each; a query id that repeats is searched once, with its smallest vector.  Fewer candidates than k give them all;
    empty tables give no rows; scores beyond a long are clipped to its ends; other columns are not read.
    """
    spark = rows.sparkSession
    base, asked = usable(rows, id_col, vec_col), usable(queries, id_col, vec_col)
    sizes = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = sizes["dim"], sizes["n"]
    base, asked = base.filter(F.size("vec") == dim), asked.filter(F.size("vec") == dim).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    shelves = fit_shelves(base, n, dim)
    stored = cut(stored_pages(base, shelves, dim))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found, done, reach, parts = None, 0, 1, int(shelves.parts.sum())
    while done < parts:
        now = asked.withColumn("floor", F.lit(NONE).cast("long"))
        if found is not None:
            floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            now = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE).cast("long")))
        new = meet(stored, route(now, shelves, dim, done, reach), shelves, dim, k)
        every = new if found is None else new.unionByName(found.drop("rank"))
        before, found = found, cut(every.withColumn("rank", rank).filter(F.col("rank") <= k))
        if before is not None:
            scrap(before)
        done, reach = reach, reach * WIDEN if reach > 1 else WIDEN
    scrap(stored)
    return found.select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """DuckDB SQL of the query: every query against every row."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
