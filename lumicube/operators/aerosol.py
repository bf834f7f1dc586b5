"""Aerosol optical thickness of the views of acquisition sets: bounds from dark pixels, over land the joint inversion.

Many sets are solved by one plan.  Dark pixels are the smallest radiances of each view and band, cut before the
shuffle; those of a set meet the set's views in one cogroup, of at most DARK rows a band whatever the number of views,
where the thickness is raised until the path radiance of the full table, at each view's own angles and altitude,
exceeds them.  Reference pixels are the ends of each view's vegetation index, and they too are cut before the shuffle.
The inversion is one call of a batched Powell search for all pixel sets and endmembers of an Arrow batch of views.

Pixels have set_id, product_id, y, x, radiance (array by band, in the table's unit), valid and, over land, clear.
Views, a row each, have set_id, product_id, vza, sza, ada, alt and cwv; both ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import radiometry as r
from ..model import Band
from ..numerics import minima_powell
from ..sources.binary_tables import RtcTable
from .statistics import smallest

#: Visible ranges (nm) over land and water, dark pixels of a set, step of the fine search, thickness where
#: the inversion has no pixels, nodes of the inversion, pixel sets of a view, index ranges of dense, medium and sparse
#: vegetation, and the first wavelengths (nm) of the bands of the index.
VISIBLE = {"land": (420.0, 690.0), "water": (435.0, 690.0)}
DARK, STEP, DEFAULT, NODES, SETS = 100, 0.005, 0.2, 10, 5
DENSE, MEDIUM, SPARSE = (0.4, 0.9), (0.1, 0.4), (0.01, 0.1)
INDEX_RED, INDEX_NIR = 670.0, 785.0
#: Weights of a set's five pixels (two dense, two medium, one sparse), value of a state out of range, and
#: the vegetation index's relation to the first guess of the vegetation's share.
WEIGHTS, OUTSIDE, GUESS = (2.0, 2.0, 1.0, 1.0, 1.5), 5.0e8, (1.3, 0.25)
#: Wavelengths (nm) and reflectances of three kinds of vegetation and of bare soil.
ENDMEMBER_NM = (412.545, 442.401, 489.744, 509.7, 559.634, 619.62, 664.64, 680.902, 708.426, 753.472, 761.606, 778.498, 864.833, 884.849, 899.86)
VEGETATION = (
    (0.0235, 0.0267, 0.0319, 0.0342, 0.0526, 0.0425, 0.0371, 0.0369, 0.0789, 0.3561, 0.3698, 0.3983, 0.4248, 0.4252, 0.4254),
    (0.0206, 0.02984, 0.0445, 0.0498, 0.0728, 0.0821, 0.0847, 0.087, 0.1301, 0.1994, 0.202, 0.2074, 0.2365, 0.2419, 0.2459),
    (0.0138, 0.0158, 0.0188, 0.021, 0.0395, 0.0279, 0.0211, 0.0206, 0.0825, 0.2579, 0.2643, 0.2775, 0.3201, 0.3261, 0.3307),
)
SOIL = (0.049, 0.086, 0.1071, 0.1199, 0.1679, 0.2425, 0.2763, 0.2868, 0.3148, 0.347, 0.3498, 0.3558, 0.3984, 0.4062, 0.412)
ANGLES = ("vza", "sza", "ada", "alt", "cwv")


def endmembers(bands: Sequence[Band]) -> tuple[np.ndarray, np.ndarray]:
    """Vegetation (three kinds, bands) and soil (bands), interpolated linearly, and beyond the ends along the last pieces."""
    nm, wl = np.array(ENDMEMBER_NM), np.array([b.wavelength for b in bands])
    i = np.clip(np.searchsorted(nm, wl, side="right") - 1, 0, len(nm) - 2)
    f = (wl - nm[i]) / (nm[i + 1] - nm[i])
    along = lambda v: v[..., i] * (1 - f) + v[..., i + 1] * f
    return along(np.array(VEGETATION)), along(np.array(SOIL))


def dark_radiances(pixels: DataFrame, views: DataFrame, share: bool) -> DataFrame:
    """set_id, product_id, band, rank, value: each view's smallest positive radiances of valid pixels, by band.

    DARK of them; with ``share``, DARK divided by the number of the set's views.
    """
    cells = pixels.filter("valid").select("set_id", "product_id", "y", "x", F.posexplode("radiance").alias("at", "value"))
    cells = cells.select("set_id", "product_id", "y", "x", (F.col("at") + 1).alias("band"), F.col("value").cast("double").alias("value"))
    dark = smallest(cells, ["set_id", "product_id", "band"], "value", DARK, ["y", "x"])
    if share:
        most = views.groupBy("set_id").agg(F.greatest(F.lit(1), F.floor(F.lit(DARK) / F.count("*"))).alias("most"))
        dark = dark.join(most, "set_id").filter("rank <= most")
    return dark.select(*[F.col(c).alias(c) for c in ("set_id", "product_id", "band", "rank", "value")])


def _highest(path, dark: np.ndarray, nodes: np.ndarray) -> tuple[float, float]:
    """The greatest thickness at which not every rank of ``dark`` (views, ranks, bands) has a radiance at or under the path
    radiance ``path(aot)`` (views, bands) in some view and band, and the thickness looked at last."""
    over = lambda aot: (dark <= path(aot)[:, None, :]).any(axis=(0, 2)).all()
    failed = next((k for k, aot in enumerate(nodes) if over(aot)), len(nodes) - 1)
    below = failed - 1
    if below <= 0:
        return float(nodes[0]), float(nodes[max(0, failed)])
    k = 1
    while nodes[below] + k * STEP <= nodes[-1]:
        if over(nodes[below] + k * STEP):
            return float(nodes[below] + (k - 1) * STEP), float(nodes[below] + k * STEP)
        k += 1
    return float(nodes[below] + max(0, k - 2) * STEP), float(nodes[below] + (k - 1) * STEP)


def thickness_bounds(pixels: DataFrame, views: DataFrame, table: RtcTable, bands: Sequence[Band], surface: str = "land", joint: bool = False) -> DataFrame:
    """set_id, product_id, aot_max, correction (array by band) of every view.

    The thickness is raised over the table's nodes, then in steps of STEP, until each rank of dark pixels is at or under
    the path radiance in some visible band: of the view itself, or with ``joint`` of any view of the set, which gives the
    set one thickness.  Joint views take DARK pixels each, others DARK divided by the number of views.  ``correction`` is what to take off the path radiance of a view of 55 degrees (fly-by zenith
    ``fza``, if the views have it) whose thickness is the table's least, else 0: the path radiance above the dark mean,
    over water along a polynomial of degree 4.  Views without a full set of dark pixels in some visible band have null
    values; a joint thickness is null if that holds for all of the set's views.
    """
    sc = views.sparkSession.sparkContext
    shared = sc.broadcast(table)  # one file of fixed axes, averaged to bands
    wl = np.array([b.wavelength for b in bands])
    seen = np.flatnonzero((wl >= VISIBLE[surface][0]) & (wl <= VISIBLE[surface][1]))
    count = len(bands)
    ids = {n: t for n, t in views.dtypes if n in ("set_id", "product_id")}

    def bound(rows: pa.Table, own: pa.Table) -> pa.Table:
        nodes = shared.value.axes["aot"]
        names = own.column("product_id").to_pylist()
        place = {p: k for k, p in enumerate(names)}
        rank = np.asarray(rows.column("rank"))
        n = DARK if joint else max(1, DARK // max(1, len(names)))
        cells = np.full((len(names), n, count), np.nan)
        at = np.array([place.get(p, -1) for p in rows.column("product_id").to_pylist()], dtype=int)
        on = at >= 0
        cells[at[on], rank[on] - 1, np.asarray(rows.column("band"))[on] - 1] = np.asarray(rows.column("value"))[on]
        full = np.isfinite(cells[:, :, seen]).all(axis=(1, 2))
        points = {a: np.asarray(own.column(a).cast(pa.float64())) for a in ANGLES}
        fza = np.asarray(own.column("fza").cast(pa.float64())) if "fza" in own.column_names else np.zeros(len(names))

        def path(aot: float, use: np.ndarray) -> np.ndarray:
            return shared.value.many({a: v[use] for a, v in points.items()} | {"aot": np.full(len(use), aot)}).lpw

        most, correction = [None] * len(names), np.zeros((len(names), count))
        groups = [np.flatnonzero(full)] if joint else [np.array([k]) for k in np.flatnonzero(full)]
        for use in groups:
            if not len(use):
                continue
            aot, last = _highest(lambda a, use=use: path(a, use)[:, seen], cells[use][:, :, seen], nodes)
            for k, lpw in zip(use, path(last, use), strict=True):
                most[k] = aot
                if aot == nodes[0] and abs(fza[k]) == 55.0:
                    wrong = lpw - cells[k].mean(axis=0)
                    if surface == "water" and np.isfinite(wrong).all():
                        x = (wl - wl.mean()) / (np.ptp(wl) or 1.0)
                        wrong = np.polyval(np.polyfit(x, wrong, min(4, count - 1)), x)
                    correction[k] = np.maximum(np.nan_to_num(wrong, nan=0.0), 0.0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * count), pa.array(correction.ravel()))
        return pa.table({"set_id": own.column("set_id"), "product_id": own.column("product_id"), "aot_max": pa.array(most, pa.float64()), "correction": lists})

    schema = f"set_id {ids['set_id']}, product_id {ids['product_id']}, aot_max double, correction array<double>"
    known = [c for c in ("fza",) if c in views.columns]
    own = views.select(*[F.col(c).alias(c) for c in ("set_id", "product_id", *ANGLES, *known)])  # may share a plan with the pixels
    met = dark_radiances(pixels, views, not joint)
    # A set is at most a few views with DARK ranks a band.
    return met.groupBy("set_id").cogroup(own.groupBy("set_id")).applyInArrow(bound, schema).filter("product_id IS NOT NULL")


def reference_pixels(pixels: DataFrame, bands: Sequence[Band]) -> DataFrame:
    """product_id, dense, medium, sparse (arrays of spectra), n_dense, n_medium: reference pixels of each view.

    Dense and medium vegetation from the highest index down, sparse from the lowest up, of valid and clear pixels, 3 SETS
    spectra at most; the counts stop there.  Ties go to the smaller y, then x.
    """
    first = lambda least: next(k for k, b in enumerate(bands) if b.wavelength > least)
    red, nir = (F.get("radiance", F.lit(first(w))).cast("double") for w in (INDEX_RED, INDEX_NIR))
    marked = pixels.filter("valid AND clear").withColumn("ndvi", r.ndvi(nir, red))
    within = lambda span: (F.col("ndvi") > span[0]) & (F.col("ndvi") < span[1])
    kind = F.when(within(DENSE), "dense").when(within(MEDIUM), "medium").when(within(SPARSE), "sparse")
    key = F.when(kind == "sparse", F.col("ndvi")).otherwise(-F.col("ndvi"))
    rank = F.row_number().over(Window.partitionBy("product_id", "kind").orderBy("key", "y", "x"))
    chosen = marked.withColumns({"kind": kind, "key": key}).filter("kind IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") <= 3 * SETS)
    spectra = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", F.col("radiance").cast("array<double>").alias("v"))))), lambda s: s["v"]).alias(k)
    return chosen.groupBy("product_id").agg(*map(spectra, ("dense", "medium", "sparse")))


def pixel_sets(dense: Sequence, medium: Sequence, sparse: Sequence) -> np.ndarray:
    """(sets, 5, bands): two dense, two medium and a sparse pixel each, or a third medium one where sparse ones ran out."""
    n = min(len(dense) // 2, len(medium) // 3, SETS)
    made = [[*dense[2 * i : 2 * i + 2], *(medium[2 * i : 2 * i + 2] if i < len(sparse) else medium[2 * i : 2 * i + 3]), *sparse[i : i + 1]] for i in range(n)]
    return np.array(made, dtype=np.float64)


def misfit(spectra: np.ndarray, nodes: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], vegetation: np.ndarray, soil: np.ndarray, wl: np.ndarray):
    """f(states, rows) of problems: spectra (problems, 5, bands), nodes (problems, NODES), path radiance, flux and albedo
    (problems, NODES, bands) there, and the vegetation's spectrum (problems, bands).

    A state has the shares of vegetation and soil of the five pixels in turn, then the thickness.  Out of the nodes, or
    with a negative share, the value is OUTSIDE.
    """
    weight = np.where(wl > 850.0, 0.0, 1000.0 / wl)
    if wl[0] <= 440.0:
        weight[0] = 0.0
    pixel = np.array(WEIGHTS)[:, None] * weight

    def f(states: np.ndarray, rows: np.ndarray) -> np.ndarray:
        own, aot = nodes[rows], states[:, 10]
        out = np.full(len(rows), OUTSIDE)
        ok = np.flatnonzero((states >= 0).all(axis=1) & (aot > own[:, 0]) & (aot < own[:, -1]))
        if not len(ok):
            return out
        rows, own, aot = rows[ok], own[ok], aot[ok]
        i = (aot[:, None] > own).sum(axis=1) - 1
        lo, hi = own[np.arange(len(ok)), i], own[np.arange(len(ok)), i + 1]
        g = ((aot - lo) / (hi - lo))[:, None]
        lpw, egl, sab = ((t[rows, i] * (1 - g) + t[rows, i + 1] * g)[:, None, :] for t in tables)
        s = states[ok, 0:10:2, None] * vegetation[rows][:, None, :] + states[ok, 1:10:2, None] * soil
        toa = lpw + s * egl / np.pi / (1 - sab * s)
        out[ok] = (pixel * (spectra[rows] - toa) ** 2).sum(axis=(1, 2))
        return out

    return f


def invert_sets(sets: Sequence[np.ndarray], nodes: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], bands: Sequence[Band]) -> list[np.ndarray]:
    """Thickness of every pixel set of each view: of the three kinds of vegetation, the one that fits best.

    All sets and kinds of all views are minimised together; ``nodes`` is (views, NODES), tables are (views, NODES, bands).
    """
    wl = np.array([b.wavelength for b in bands])
    vegetation, soil = endmembers(bands)
    view = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(view):
        return [np.zeros(0) for _ in sets]
    spectra = np.concatenate([s for s in sets if len(s)])
    kinds = len(vegetation)
    many, own = np.repeat(spectra, kinds, axis=0), np.repeat(view, kinds)
    red, nir = (next(k for k, b in enumerate(bands) if b.wavelength > w) for w in (INDEX_RED, INDEX_NIR))
    ndvi = (many[:, :, nir] - many[:, :, red]) / (many[:, :, nir] + many[:, :, red])
    share = GUESS[0] * ndvi + GUESS[1]
    start = np.empty((len(many), 11))
    start[:, 0:10:2], start[:, 1:10:2], start[:, 10] = np.maximum(share, 0), np.maximum(1 - share, 0), nodes[own, nodes.shape[1] // 2]
    f = misfit(many, nodes[own], tuple(t[own] for t in tables), np.tile(vegetation, (len(spectra), 1)), soil, wl)
    found, value = minima_powell(f, start, accuracy=1e-7, line=1e-6)
    best = value.reshape(-1, kinds).argmin(axis=1)
    aot = found[:, 10].reshape(-1, kinds)[np.arange(len(spectra)), best]
    return [aot[view == k] for k in range(len(sets))]


def settled(values: np.ndarray) -> float:
    """The mean of values within 1.5 standard deviations of their mean; of all, if there is no such value."""
    if len(values) < 2:
        return float(values[0])
    near = np.abs(values - values.mean()) <= 1.5 * values.std(ddof=1)
    return float(values[near].mean() if near.any() else values.mean())


def land_thickness(pixels: DataFrame, views: DataFrame, table: RtcTable, bands: Sequence[Band]) -> DataFrame:
    """set_id, product_id, aot_max, aot550, origin, sets, correction of every view, over land.

    Dark pixels bound the thickness of each view, DARK of them a set, so that a set of five views takes twenty of each.
    Below the bound, up to SETS pixel sets are inverted.  ``origin``: ``least`` (the bound is the table's least), ``fitted``,
    ``bound`` or ``default`` where there are too few reference pixels and the bound is below DEFAULT or not, ``none``
    (null thickness) without dark pixels.  Views without pixels are kept; pixels without a view are left out; empty
    tables give no rows.
    """
    bounds = thickness_bounds(pixels, views, table, bands, "land")
    rows = views.select("set_id", "product_id", *ANGLES).join(bounds, ["set_id", "product_id"]).join(reference_pixels(pixels, bands), "product_id", "left")
    shared = views.sparkSession.sparkContext.broadcast(table)
    ids = {n: t for n, t in views.dtypes if n in ("set_id", "product_id")}
    schema = f"set_id {ids['set_id']}, product_id {ids['product_id']}, aot_max double, aot550 double, origin string, sets int, correction array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = float(shared.value.axes["aot"][0])
        for batch in batches:
            n = batch.num_rows
            most = np.asarray(batch.column("aot_max").to_numpy(zero_copy_only=False), dtype=np.float64)
            aot, origin, used = [None] * n, ["none"] * n, [0] * n
            kinds = [batch.column(k).to_pylist() for k in ("dense", "medium", "sparse")]
            todo, sets = [], []
            for k in np.flatnonzero(np.isfinite(most)).tolist():
                dense, medium, sparse = (c[k] or [] for c in kinds)
                if most[k] == least:
                    aot[k], origin[k] = least, "least"
                elif len(dense) >= 2 and len(medium) >= 3:
                    todo.append(k)
                    sets.append(pixel_sets(dense, medium, sparse))
                else:
                    aot[k], origin[k] = (float(most[k]), "bound") if most[k] < DEFAULT else (DEFAULT, "default")
            if todo:
                nodes = least + (most[todo, None] - least) * np.arange(NODES) / (NODES - 1)
                points = {a: np.repeat(np.asarray(batch.column(a).cast(pa.float64()))[todo], NODES) for a in ANGLES} | {"aot": nodes.ravel()}
                t = shared.value.many(points)
                for k, found in zip(todo, invert_sets(sets, nodes, tuple(v.reshape(len(todo), NODES, -1) for v in (t.lpw, t.egl, t.sab)), bands), strict=True):
                    aot[k], origin[k], used[k] = settled(found), "fitted", len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), batch.column("product_id"), batch.column("aot_max"), pa.array(aot, pa.float64()), pa.array(origin), pa.array(used, pa.int32()), batch.column("correction")],
                names=["set_id", "product_id", "aot_max", "aot550", "origin", "sets", "correction"],
            )

    # A few numbers a view, but a long search for each: adaptive execution would put all views into one task.
    spread = rows.repartition(views.sparkSession.sparkContext.defaultParallelism, "product_id")
    return spread.mapInArrow(run, schema)


def water_thickness(pixels: DataFrame, views: DataFrame, table: RtcTable, bands: Sequence[Band], joint: bool) -> DataFrame:
    """set_id, product_id, aot550, correction of every view over water, from dark pixels alone.

    With ``joint`` the views of a set share one thickness, from DARK pixels each; else every view has its own, from DARK
    pixels divided by the number of views.  ``valid`` must hold for water pixels alone.
    """
    return thickness_bounds(pixels, views, table, bands, "water", joint).withColumnRenamed("aot_max", "aot550")
