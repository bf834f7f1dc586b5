"""Near-duplicate detection: a multi-index Hamming join of b-bit MinHash signatures.

A document's signature is ``CHUNKS x PER_CHUNK`` MinHash values of ``BITS`` bits.  Two signatures within
``2 * CHUNKS - 1`` differing values have, by the pigeonhole principle, a chunk that differs in one value at
most; every chunk is therefore indexed under each of its one-error patterns (one value masked out), and an
equality join of the patterns finds all such pairs, and others beyond the threshold too.  Links are decided
on the full shingle sets alone.

Steps, none of which lists the pairs of a bucket:

1. equal sets become one class (most copies end here), whose node is its smallest document id;
2. each member of a bucket is compared with the bucket's smallest member; verified links give components;
3. buckets that still hold several components go to an exact prefix filter: two sets with Jaccard similarity
   of at least t share one of the shingles that stand first in any common order at positions that the sizes bound,
   so that pairs which the sizes rule out are never made; the rest is compared on full sets.

So no pair of a bucket is given up, and none is capped.  What may be missed are pairs without a common bucket: of
pairs at a similarity of exactly 0.8 about 2 in 100,000.  The sets of the classes in buckets are written once and
read by every later step; hot keys are dealt over tasks (``salted_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._graph import components
from ._spark import bounded_batches, cut, hot_keys, salted_join, scrap

CHUNKS, PER_CHUNK, BITS = 8, 5, 12
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 1 << 63, CHUNKS * PER_CHUNK, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, CHUNKS * PER_CHUNK, dtype=np.uint64)
#: Up to so many node ids (16 bytes each) are broadcast to pick the documents to compare; beyond, a shuffle join.
MAX_BROADCAST_IDS = 500_000

#: Classes whose smallest id is another's too, as where an id stands on different texts, get nodes from here on.
SHARED_ID = 1 << 62
#: Shingles are counted in so many slots to order them from rare to frequent; any order gives the same links.
SLOTS = 1 << 18

_CHUNK_COLS = [f"c{i}" for i in range(CHUNKS)]


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, shingle hashes by document in ascending order) of a block."""
    n = len(offsets) - 1
    data = B.lower_ascii(data)
    starts, ends, word_doc = B.find_words(data, offsets, B.NON_SPACE)
    docs, hashes = B.shingles(B.hash_spans(data, starts, ends), word_doc, n, width)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(docs[new], minlength=n).astype(np.int64), hashes[new]


def _set_hashes(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    h1, h2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    if len(some):
        h1[some] = np.add.reduceat(B.mix(hashes), first)
        h2[some] = np.add.reduceat(B.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    return h1, h2, some, first


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_buffers(batch.column(2))
            for lo, hi, d, o in B.blocks(data, offsets):
                sizes, hashes = distinct_shingles(d, o, width)
                h1, h2, some, first = _set_hashes(sizes, hashes)
                chunks = np.zeros((CHUNKS, hi - lo), dtype=np.int64)
                if len(some):
                    for k in range(CHUNKS * PER_CHUNK):
                        value = B.mix(np.minimum.reduceat(hashes * _MUL[k] + _ADD[k], first)) & np.uint64((1 << BITS) - 1)
                        chunks[k // PER_CHUNK, some] |= value.astype(np.int64) << (BITS * (k % PER_CHUNK))
                own = [batch.column(k).slice(lo, hi - lo) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *map(pa.array, chunks)],
                    names=["doc_id", "text_hash", "n_shingles", "h1", "h2", *_CHUNK_COLS],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_buffers(batch.column(1))
            for lo, hi, d, o in B.blocks(data, offsets):
                sizes, hashes = distinct_shingles(d, o, width)
                h1, _, _, _ = _set_hashes(sizes, hashes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(h1.view(np.int64)), lists], names=["id", "h", "shingles"])

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit hash of the set and the signature's chunks."""
    schema = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in _CHUNK_COLS)
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_sketch(width), schema)


def _patterns() -> list:
    """Every chunk under each of its one-error patterns."""
    out = []
    for i, c in enumerate(_CHUNK_COLS):
        for j in range(PER_CHUNK):
            mask = ((1 << (BITS * PER_CHUNK)) - 1) ^ (((1 << BITS) - 1) << (BITS * j))
            out.append(F.xxhash64(F.lit(i * PER_CHUNK + j), F.col(c).bitwiseAND(F.lit(mask).cast("long"))))
    return out


def _nodes(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` with a node each, and whether some have a smallest id that isn't theirs alone."""
    again = classes.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("again"))
    if again.isEmpty():
        return classes.withColumn("node", F.col("id")), False
    own = F.col("h1").bitwiseAND(F.lit(SHARED_ID - 1)).bitwiseOR(F.lit(SHARED_ID))
    return cut(classes.join(again, "id", "left").withColumn("node", F.when(F.col("again"), own).otherwise(F.col("id"))).drop("again")), True


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (node, id, h1), from their documents' texts: one pass over them."""
    n = wanted.count()
    small = n <= MAX_BROADCAST_IDS
    ids = wanted.select("id").distinct()
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if small else ids, "id")
    sets = picked.mapInArrow(_full_sets(width), "id long, h1 long, shingles array<long>")
    # An id that stands on several rows gives the sets of all its texts: those of other classes go, copies become one.
    own = cut(sets.join(F.broadcast(wanted) if small else wanted, ["id", "h1"]).select("node", "shingles"))
    return own if own.count() == n else cut(own.dropDuplicates(["node"]))


def _keyed(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` joined with ``nodes``, which has a row a node; up to MAX_BROADCAST_IDS nodes without a shuffle of sets."""
    return sets.join(F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_IDS else nodes, "node")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; a set that many pairs need is sent to several tasks."""
    left = _keyed(sets, pairs.select(F.col("a").alias("node")).distinct()).select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = _keyed(sets, pairs.select(F.col("b").alias("node")).distinct()).select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    hot = hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), ["b"])
    both = salted_join(pairs.join(left, "a"), right, ["b"], hot, ["a"])
    shared = F.size(F.array_intersect("sa", "sb"))
    linked = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), shared.alias("i"))
    return linked.filter(F.col("i") * 100 >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, component_id, chosen of every row: chosen if its class has the component's
    smallest id, and null with component_id where the id is null or the set empty."""
    rows = cut(sketches(docs, id_col, text_col, width))
    sound = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes, several = _nodes(
        cut(sound.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in _CHUNK_COLS]))
    )
    keys = classes.select("node", "n", F.explode(F.array(*_patterns())).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("times")).filter("hub <> last").select("key", "hub", "times")
    members = cut(salted_join(keys, shared.drop("times"), ["key"], hot_keys(shared, ["key"], "times"), ["node"]).select("key", "hub", "node", "n"))

    pairs = cut(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    wanted = cut(classes.select("node", "id", "h1").join(members.select("node").distinct(), "node", "left_semi"))
    sets = _sets_of(docs, wanted, id_col, text_col, width)
    first = cut(components(_linked(pairs, sets, percent)))

    placed = members.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rest = cut(placed.join(open_keys, "key", "left_semi").select("node", "n", "comp").distinct())
    more = cut(_rest_pairs(rest, sets, percent))
    comp_of = rest.select("node", "comp")
    joined = _linked(more, sets, percent).join(comp_of.toDF("a", "ca"), "a").join(comp_of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    second = components(joined).toDF("comp", "root")
    labels = first.union(second.select(F.col("comp").alias("node"), F.col("comp").alias("comp"))).distinct().join(second, "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))

    moved = classes.select("h1", "h2", "copies", "id", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if several:
        # A component's smallest id may belong to a class whose node is not the smallest.
        least = F.min(F.struct("id", "node"))
        moved = cut(moved)
        moved = moved.join(moved.groupBy("root").agg(least.alias("least")), "root").withColumns({"component_id": F.col("least.id"), "chosen": F.col("node") == F.col("least.node")})
    else:
        moved = moved.withColumns({"component_id": F.col("root"), "chosen": F.col("node") == F.col("root")})
    on = ["h1", "h2", "live"]
    moved = cut(moved.filter("copies > 1 OR NOT chosen").select("h1", "h2", "component_id", "chosen", "copies", F.lit(True).alias("live")))
    scrap(members, pairs, wanted, sets, rest, more)
    live = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = rows.select("doc_id", "text_hash", "n_shingles", "h1", "h2", live.alias("live"))
    out = salted_join(out, moved.drop("copies"), on, hot_keys(moved, on, "copies"), ["doc_id", "text_hash"], "left")
    own = F.when(F.col("live"), F.col("doc_id"))
    right = F.coalesce(F.col("chosen") & (F.col("doc_id") == F.col("component_id")), F.lit(True))
    return out.select("doc_id", "text_hash", "n_shingles", "h1", F.coalesce("component_id", own).alias("component_id"), F.when(F.col("live"), right).alias("chosen"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id it reaches over links), kept.

    Words are maximal runs of other than white space with A-Z lower-cased; a document's set holds its distinct
    ``shingle_words``-word shingles, with fewer words the whole sequence.  Two documents are linked if
    100 * |intersection| >= percent * |union|.

    Null, empty and blank texts have an empty set: linked with nothing, component_id is their own id, kept.
    A null id is linked with nothing and kept, with component_id null.  Repeated rows each give a row; rows that
    share an id but not a text are judged by their own text.  Equal texts tie to the smallest id.  An empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    component = F.coalesce("component_id", "doc_id")
    found = _labelled(docs, id_col, text_col, shingle_words, percent)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row left of each group of near duplicates; columns stay as they are.

    Every row is judged by its own text: the row of the group's smallest id stays, of several texts of that id the
    one with the smaller set hash, then the smaller text hash, and of repeated rows the one with the smallest values.
    Rows without words and rows with a null id stay, each.  An empty table gives no rows.
    """
    found = cut(_labelled(docs, id_col, text_col, shingle_words, percent).filter("chosen IS NOT NULL"))
    key, text_key = (next(n for k in range(99) if (n := f"_{what}{k}") not in docs.columns) for what in ("id", "text"))
    best = found.filter("chosen").groupBy("doc_id", "h1").agg(F.min("text_hash").alias("best"), F.count("*").alias("n")).filter("n > 1")
    worse = found.filter("chosen").join(best, ["doc_id", "h1"]).filter("text_hash <> best")
    out = found.filter("NOT chosen").select("doc_id", "text_hash").union(worse.select("doc_id", "text_hash")).distinct().toDF(key, text_key)
    keyed = docs.withColumns({key: F.col(id_col).cast("long"), text_key: F.xxhash64(text_col)})
    kept = keyed.join(out, [key, text_key], "left_anti")
    again = best.select(F.col("doc_id").alias(key), F.col("best").alias(text_key))
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, [key, text_key], "left_semi").groupBy(key, text_key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(again, [key, text_key], "left_anti").select(docs.columns).unionByName(once.select("row.*"))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's shingles by slot."""
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_slot(np.asarray(batch.column(0).flatten())), minlength=SLOTS)
    some = np.flatnonzero(total)
    for lo in range(0, len(some), 100_000):
        at = some[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _rest_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in ``rest`` (node, n, comp) that may still reach the similarity.

    Shingles are ordered by how many of these documents' shingles share their slot, then by hash.  With overlap at
    least need = ceil(t / (1 + t) * (n_a + n_b)), the first shared shingle stands at position n - need + 1 or before
    in both sets, and this is the join condition; only these prefixes are shuffled.
    """
    bounded_batches(rest.sparkSession)
    own = cut(_keyed(sets, rest).select("node", "n", "comp", "shingles"))
    totals = np.zeros(SLOTS, dtype=np.int64)
    found = own.select("shingles").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    totals[np.asarray(found.column("slot"))] = np.asarray(found.column("n"))
    shared = rest.sparkSession.sparkContext.broadcast(np.minimum(totals, (1 << 31) - 1).astype(np.int32))  # SLOTS numbers

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = np.asarray(batch.column(3).offsets), np.asarray(batch.column(3).values)
            owner, hashes, place = [], [], []
            for k in range(batch.num_rows):
                h = flat[ends[k] : ends[k + 1]]
                first = np.lexsort((h, shared.value[_slot(h)]))[: prefix_length(len(h), percent)]
                owner.append(np.full(len(first), k))
                hashes.append(h[first])
                place.append(np.arange(1, len(first) + 1))
            if owner:
                at = pa.array(np.concatenate(owner))
                cols = [batch.column(k).take(at) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), *cols, pa.array(np.concatenate(place))], names=["h", "node", "n", "comp", "q"])

    prefix = own.mapInArrow(prefixes, "h long, node long, n long, comp long, q long")
    times = cut(prefix.groupBy("h").agg(F.count("*").alias("times"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h", "times"))
    prefix = cut(prefix.join(times.select("h"), "h", "left_semi"))
    scrap(own)
    x, y = prefix.toDF("h", "a", "na", "ca", "qa"), prefix.toDF("h", "b", "nb", "cb", "qb")
    need = F.expr(f"ceil({percent} * (na + nb) / {100 + percent}.0 - 1e-9)")
    near = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near &= (F.col("qa") <= F.col("na") - need + 1) & (F.col("qb") <= F.col("nb") - need + 1)
    return salted_join(x, y, ["h"], hot_keys(times, ["h"], "times"), ["a"]).filter(near).select("a", "b").distinct()
