"""Source divergence audit: how far the word use of each source of a language is from the others and from the language.

A first pass over the documents adds, in each task, how many documents hold a term to a count-min sketch of a few
saturating cells; merged by addition it never underestimates.  A second pass drops every term that the sketch shows to
be in too few documents, before anything is shuffled, and counts the others exactly: texts are cut into terms as bytes,
terms are counted by Arrow in bounded tables, and partial counts meet by (language, term).

The chi-square sums of all pairs of sources are taken over every kept term, but joined over few: where neither source
has the term the addend is one constant a pair; where one has it, it depends on its count alone and is summed over a
histogram of counts; only terms that both have are joined.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import _bytes as B
from ._spark import cut

#: Documents of a language that a kept term is in at least, the scale of probabilities, and terms listed a source.
LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`
TERM = B.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F), invert=True)
#: Rows of the sketch, and cells of a row: CELLS_A_DOC for each document, as a power of two between these bounds.
#: More cells discard more terms before the shuffle; results don't depend on them.
DEPTH, CELLS_A_DOC, MIN_CELLS, MAX_CELLS = 2, 16, 1 << 16, 1 << 24
#: Cells of one row of the table that sketches are merged in.
SLICE = 1 << 16
#: Rows of partial counts that a task holds at most before it hands them on.
HELD_ROWS = 1_000_000
#: Low bits of a hash that make room for a document's number in its block.
DOC_BITS = 20
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _words(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: the first one's number, bytes (A-Z lower-cased), starts, ends, document in the run, and a
    44-bit hash of language and term."""
    data, offsets = B.column_buffers(texts)
    tongue = B.hash_spans(*_spans(langs))
    for first, end, raw, own in B.blocks(data, offsets, 1 << 20):
        low = B.lower_ascii(raw)
        starts, ends, doc = B.find_words(low, own, TERM)
        h = B.mix(B.hash_spans(low, starts, ends) ^ (tongue[first:end] * np.uint64(_SEEDS[3]))[doc]) >> np.uint64(DOC_BITS)
        yield first, low, starts, ends, doc, h


def _spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = B.column_buffers(col)
    return data, offsets[:-1], offsets[1:]


def _cell(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (B.mix(h * np.uint64(_SEEDS[row])) & np.uint64(cells - 1)).astype(np.int64)


def add(sketch: np.ndarray, h: np.ndarray, docs: np.ndarray) -> None:
    """Add numbers of documents to the cells of distinct hashes; cells stop at 255."""
    for row in range(len(sketch)):
        cell, at = np.unique(_cell(h, row, sketch.shape[1]), return_inverse=True)
        sketch[row, cell] = np.minimum(255, sketch[row, cell] + np.bincount(at, weights=docs)).astype(np.uint8)


def estimate(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What the sketch says about each hash: never less than the true number, up to 255."""
    out = np.full(len(h), 255, np.uint8)
    for row in range(len(sketch)):
        out = np.minimum(out, sketch[row, _cell(h, row, sketch.shape[1])])
    return out


def document_frequencies(docs: DataFrame, cells: int) -> np.ndarray:
    """The merged sketch of (language, term) document frequencies of ``docs`` (lang, text).

    Each task fills a sketch of DEPTH * cells bytes; slices of equal places meet in one task and are added as a stream.
    The result, of DEPTH * MAX_CELLS bytes at most, is what the driver gets.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, cells), np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << DOC_BITS):
                part = batch.slice(lo, 1 << DOC_BITS)
                for *_, doc, h in _words(part.column(1), part.column(0)):
                    once = np.unique((h << np.uint64(DOC_BITS)) | doc.astype(np.uint64)) >> np.uint64(DOC_BITS)
                    terms, n = np.unique(once, return_counts=True)
                    add(sketch, terms, n)
        yield from _slices(dict(enumerate(sketch.reshape(-1, min(SLICE, cells)))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(raw, np.uint8)
                held[k] = np.minimum(255, held[k].astype(np.int32) + new).astype(np.uint8) if k in held else new
        yield from _slices(held)

    schema = "slice int, cells binary"
    merged = docs.select("lang", "text").mapInArrow(fill, schema).repartition("slice").mapInArrow(merge, schema).toArrow()
    out = np.zeros((DEPTH * cells // min(SLICE, cells), min(SLICE, cells)), np.uint8)
    for k, raw in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        out[k] = np.frombuffer(raw, np.uint8)
    return out.reshape(DEPTH, cells)


def _slices(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, cells in parts.items():
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["slice", "cells"])


def _strings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column, without a Python object a term."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[at]))


KEYS = ["lang", "source", "term"]


def _counted(words: pa.Array, group: np.ndarray, doc: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of terms that stand in documents of groups; strings are hashed once, to their numbers."""
    coded = words.dictionary_encode()
    size, code = len(coded.dictionary), np.asarray(coded.indices).astype(np.int64)
    once, n = np.unique(doc * size + code, return_counts=True)
    own, place = np.unique(group[once // size] * size + once % size, return_inverse=True)
    total = np.bincount(place, weights=n, minlength=len(own)).astype(np.int64)
    term = coded.dictionary.take(pa.array(own % size))
    return pa.table({"group": pa.array(own // size), "term": term, "n": pa.array(total), "docs": pa.array(np.bincount(place, minlength=len(own)))})


def _sum(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["group", "term", "n", "docs"])


def term_counts(docs: DataFrame, sketch: np.ndarray, least: int) -> DataFrame:
    """(lang, source, term, n, docs): exact occurrences and documents of the terms that the sketch doesn't rule out, in parts."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # DEPTH * MAX_CELLS bytes at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        groups: dict[tuple[str, str], int] = {}
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            group = np.array([groups.setdefault(x, len(groups)) for x in pairs], np.int64)
            for first, low, starts, ends, doc, h in _words(batch.column(2), batch.column(0)):
                some = np.flatnonzero(estimate(shared.value, h) >= min(least, 255))
                if len(some):
                    held.append(_counted(_strings(low, starts[some], ends[some]), group[first:], doc[some]))
            if sum(t.num_rows for t in held) > HELD_ROWS or len(groups) > HELD_ROWS:
                held = [_sum(held)] if held else []
                if sum(t.num_rows for t in held) > HELD_ROWS // 2 or len(groups) > HELD_ROWS:
                    yield from _out(held, groups)
                    held, groups = [], {}
        if held:
            yield from _out([_sum(held)], groups)

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _out(tables: list[pa.Table], groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
    for table in tables:
        for batch in table.to_batches(max_chunksize=10_000):
            at = batch.column("group")
            yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), batch.column("term").cast(pa.string()), batch.column("n"), batch.column("docs")], names=[*KEYS, "n", "docs"])


def _share(n: str, whole: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 1) / whole), exactly at any size; 1 where ``whole`` is 0."""
    whole = f"({whole})"
    wide = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0)) div CAST({whole} AS DECIMAL(20,0))"
    return f"CASE WHEN {whole} = 0 THEN 1L WHEN {n} < 9000000000 THEN 1 + {SCALE}L * ({n} + 1) div {whole} ELSE 1 + {wide} END"


def _chi(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q): both are SCALE + 1 at most, so the square fits a long."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, whole, one: occurrences of each term that at least ``least`` documents of its language hold.

    ``whole`` is the term's number in the language; ``one`` marks one row of each (language, term).
    """
    n = max(1, docs.count())
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (n * CELLS_A_DOC - 1).bit_length()))
    parts = term_counts(docs, document_frequencies(docs, cells), least)
    counted = parts.repartition("lang", "term").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    with_all = counted.withColumns({"whole": F.sum("n").over(term), "held": F.sum("docs").over(term), "one": F.row_number().over(term.orderBy("source")) == 1})
    return with_all.filter(F.col("held") >= least).drop("held", "docs")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): for each ordered pair of sources of a language, the sum of chi over all kept terms."""
    own = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("p0"), "v")
    other = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("q0"))
    nowhere = own.join(other, "lang").filter("a <> b").select("lang", "a", "b", F.expr(f"v * ({_chi('p0', 'q0')})").alias("value"))
    counts = kept.groupBy("lang", F.col("source").alias("a"), "p", F.col("none").alias("p0")).agg(F.count("*").alias("c")).join(other, "lang").filter("a <> b")
    there = F.struct("a", "b", F.expr(f"c * ({_chi('p', 'q0')} - {_chi('p0', 'q0')})").alias("value"))
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.expr(f"c * ({_chi('q0', 'p')} - {_chi('q0', 'p0')})").alias("value"))
    one_side = counts.select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.*")
    mine = kept.select("lang", "term", F.col("source").alias("a"), "p", F.col("none").alias("p0"))
    theirs = kept.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("none").alias("q0"))
    gain = F.expr(f"{_chi('p', 'q')} - {_chi('p', 'q0')} - {_chi('p0', 'q')} + {_chi('p0', 'q0')}")
    both = mine.join(theirs, ["lang", "term"]).filter("a <> b").select("lang", "a", "b", gain.alias("value"))
    each = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (nowhere, one_side, both)]
    whole = each[0].unionByName(each[1]).unionByName(each[2])
    return whole.groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def divergence(rows: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of ``rows`` (text, lang, source) is from others.

    Part ``pair`` has every other source of the language; its value is the sum over all kept terms of
    floor((p - q)^2 / q), with p and q as 1 + floor(10^9 (count + 1) / (N + V)) of the two sources.  Part ``term`` has
    the ``top`` terms that the source uses more than its language does (q), by the same measure.  Ranks count from 1
    by falling value, then by the item's bytes.  Null text, lang and source count as empty; ids are not read; each
    repeated row is a document; very long texts are counted whole; groups without terms have pairs, of value 0 where
    the language keeps no term.  Other columns are not read; an empty table gives no rows.
    """
    docs = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = cut(kept_counts(docs, least))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    languages = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.count(F.when(F.col("one"), 1)).alias("v"))
    groups = cut(
        docs.groupBy("lang", "source").agg(F.lit(1)).select("lang", "source").join(sums, ["lang", "source"], "left").join(languages, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "all", "v"))).withColumn("none", F.expr(_share("0L", "n + v")))
    )
    sizes = groups.select("lang", "source", F.expr("n + v").alias("size"), "none", F.expr("all + v").alias("size_all"))
    kept = counts.join(sizes, ["lang", "source"]).select(*KEYS, F.expr(_share("n", "size")).alias("p"), F.expr(_share("whole", "size_all")).alias("q"), "none")
    terms = kept.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_chi("p", "q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    pairs = _pairs(kept, groups).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms)


def oracle() -> str:
    """DuckDB SQL of the query, over every kept term of every pair."""
    share = lambda n, whole: f"(1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({whole}))"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {low} AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
a AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
al AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 'coalesce(s.n, 0) + v.v')} AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
q AS (SELECT lang, term, {share('a.n', 'al.n + v.v')} AS q FROM a JOIN al USING (lang) JOIN v USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= {TOP}"""
