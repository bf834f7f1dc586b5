"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; the words under its zeros are ignored, so that a hit survives
substitutions there.  Masks for items of LONG words or more are two runs of three words at every distance up to REACH:
a stretch in which four of five words are equal, and enough of them, has two such runs.  The seeds of the benchmark are
hashed into a table; every document's seeds are joined with it by equality, after a fixed bit table has dropped nearly
all that have no partner.  Around each hit the words of document and item are aligned.  An overlap is a stretch of the
alignment with enough equal words and at least four of five equal; one run of up to GAP words that were inserted or left
out may stand in it, each counting as an unequal word.

The benchmark is a query set: it is read in blocks of a bounded number of words, and each block is held against
all documents.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B

#: Items of so many words have the masks of two runs; distance of the runs' starts at most.
LONG, RUN, REACH = 15, 3, 17
#: Words that may be inserted or left out in one place.
GAP = 3
#: An overlap counts from so many equal words, for shorter items from this share of their words; and with this share (four
#: of five, in whole numbers) of its stretch.
MIN_WORDS, MIN_SHARE, OF, EQUAL = 13, 0.8, 5, 4
#: Words of one benchmark block.
BLOCK_WORDS = 200_000
_BITS = 23
_COEF = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _masks_for(length: int) -> list[np.ndarray]:
    """Offsets of the masks for items of a length; shorter items may miss one word (up to nine words) or two, so that each
    word is left out in turn, or two of four groups are."""
    if length >= LONG:
        return [np.concatenate((np.arange(RUN), d + np.arange(RUN))) for d in range(RUN, REACH + 1)]
    if length < 5:
        return [np.arange(length)]
    if length - needed(length) < 2:
        return [np.delete(np.arange(length), cut) for cut in range(length)]
    groups = np.array_split(np.arange(length), 4)  # two missing words leave two groups whole
    return [np.concatenate(kept) for kept in combinations(groups, 2)]


def _seed_hashes(words: np.ndarray, offsets: np.ndarray, span: int, kind: int) -> np.ndarray:
    """Hash of the masked words from each place on; places need not be checked for document ends."""
    m = len(words) - span + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, int(_COEF[63 - kind % 32]) * span % (1 << 64), dtype=np.uint64)
    for k, o in enumerate(offsets):
        total += words[o : o + m] * _COEF[k]
    return B.mix(total)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (A-Z lower-cased, letters and digits) and the document of each."""
    data = B.lower_ascii(data)
    starts, ends, docs = B.find_words(data, offsets, B.ALNUM)
    return B.hash_spans(data, starts, ends), docs


@dataclass
class Index:
    """Seeds of one benchmark block: for each (span, mask) sorted hashes with item and place, and a bit table."""

    ids: np.ndarray
    first: np.ndarray
    words: np.ndarray
    seeds: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    bits: np.ndarray


def build_index(ids: list[int], texts: list[str]) -> Index:
    data, offsets = B.column_buffers(pa.array(texts, pa.string()))
    words, owner = words_of(data, offsets)
    counts = np.bincount(owner, minlength=len(ids)) if len(owner) else np.zeros(len(ids), np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    bits, seeds = np.zeros(1 << _BITS, dtype=bool), []
    spans = sorted({min(int(c), LONG) for c in counts if c})
    for span in spans:
        for kind, mask in enumerate(_masks_for(span)):
            lead = int(mask[0])  # a seed begins at its first word, which need not be the item's
            mask = mask - lead
            width = int(mask[-1]) + 1
            h = _seed_hashes(words, mask, width, kind)
            at = np.arange(len(h))
            whole = owner[at] == owner[at + width - 1]
            right = counts[owner[at]] >= LONG if span == LONG else (counts[owner[at]] == span) & (at - first[owner[at]] == lead)
            keep = np.flatnonzero(whole & right)
            order = keep[np.argsort(h[keep], kind="stable")]
            seeds.append((width, kind, mask, h[order], owner[order], order - first[owner[order]]))
            bits[(h[order] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(np.asarray(ids, dtype=np.int64), first, words, seeds, bits)


def _stretches(same: np.ndarray, cost: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(equal words, start, end) by row of the stretch with the most equal words among those with the share, the first of
    equals, without unequal words at its ends.  ``cost`` has what each place takes from the share's balance.
    """
    n, size = same.shape
    equal, balance = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
    np.cumsum(same, axis=1, out=equal[:, 1:])
    np.cumsum(OF * same - cost, axis=1, out=balance[:, 1:])
    most, start, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s in range(size):
        own = np.flatnonzero(same[:, s] & (equal[:, -1] - equal[:, s] > most))
        if not len(own):
            continue
        fits = (balance[own, s + 1 :] >= balance[own, s, None]) & same[own, s:]
        e = size - np.argmax(fits[:, ::-1], axis=1)
        m = np.where(fits.any(axis=1), equal[own, e] - equal[own, s], 0)
        better = m > most[own]
        own, m, e = own[better], m[better], e[better]
        most[own], start[own], end[own] = m, s, e
    return most, start, end


#: Words that are aligned at a time.
ALIGNED = 1 << 21


def _distinct_hits(docs: np.ndarray, items: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (document, item, shift) once, by item."""
    pairs, pair = np.unique(items * np.int64(docs.max() + 1) + docs, return_inverse=True)
    low, span = shifts.min(), shifts.max() - shifts.min() + 1
    if len(pairs) * span <= 1 << 26:
        flags = np.zeros(len(pairs) * span, dtype=bool)
        flags[pair * span + shifts - low] = True
        key = np.flatnonzero(flags)
    else:
        key = np.unique(pair * span + shifts - low)
    both = pairs[key // span]
    return both % (docs.max() + 1), both // (docs.max() + 1), key % span + low


def needed(item_words: int) -> int:
    """Matching words that an overlap with an item of this length must have."""
    return min(MIN_WORDS, int(np.ceil(MIN_SHARE * item_words)))


def find_overlaps(index: Index, words: np.ndarray, docs: np.ndarray, n_docs: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, matching words, start and end in the document's words, item words) of the best overlaps."""
    first = np.searchsorted(docs, np.arange(n_docs + 1))
    found = []
    for width, kind, mask, hashes, items, places in index.seeds:
        h = _seed_hashes(words, mask, width, kind)
        maybe = np.flatnonzero(index.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        maybe = maybe[docs[maybe] == docs[maybe + width - 1]]
        lo, hi = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
        n = hi - lo
        if n.sum():
            at = np.repeat(maybe, n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            hit = np.stack((docs[at], items[k], at - first[docs[at]] - places[k]))
            found.append(np.stack(_distinct_hits(*hit)))
    if not found:
        return []
    d, i, shift = _distinct_hits(*np.concatenate(found, axis=1))
    counts = np.diff(np.append(first, len(words)))
    parts = []
    edges = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for lo, hi in zip(edges, np.append(edges[1:], len(i)), strict=True):
        item = index.words[index.first[i[lo]] : index.first[i[lo] + 1]]
        need, size = needed(len(item)), len(item)

        def aligned(own: np.ndarray, by: np.ndarray, item=item) -> np.ndarray:
            place = by[:, None] + np.arange(len(item))
            inside = (place >= 0) & (place < counts[own][:, None])
            return inside & (words[np.where(inside, first[own][:, None] + place, 0)] == item)

        def keep(own: np.ndarray, by: np.ndarray, after: np.ndarray, found: tuple, cut: np.ndarray, need=need, size=size, item_no=i[lo]) -> np.ndarray:
            match, start, end = found
            good = np.flatnonzero(match >= need)
            begin = np.where(start >= cut, after, by)[good] + start[good]
            stop = np.where(end > cut, after, by)[good] + end[good]
            parts.append(np.stack((own[good], np.full(len(good), item_no), match[good], begin, stop, np.full(len(good), size))))
            return match >= need

        step = max(1, ALIGNED // (size * (2 * GAP + 1)))
        for at in range(lo, hi, step):
            own, by = d[at : min(at + step, hi)], shift[at : min(at + step, hi)]
            same = aligned(own, by)
            done = keep(own, by, by, _stretches(same, np.full(size, EQUAL)), np.full(len(own), size))
            # A document that has no overlap with the item without a gap may have one with a gap.
            whole = np.unique(own[done])
            left = np.flatnonzero(~done & ~np.isin(own, whole) & (same.sum(axis=1) >= 2 * RUN))
            if size < 2 * RUN or not len(left):
                continue
            for gap in [g for g in range(-GAP, GAP + 1) if g]:
                for first_part, second in ((0, gap), (gap, 0)):
                    head, tail = (aligned(own[left], by[left] + g) if g else same[left] for g in (first_part, second))
                    up = np.zeros((len(left), size + 1), np.int64)
                    down = up.copy()
                    np.cumsum(head, axis=1, out=up[:, 1:])
                    down[:, :-1] = np.cumsum(tail[:, ::-1], axis=1)[:, ::-1]
                    # Words left out of the document are words of the item: the tail then stands that much further left.
                    away = second - first_part
                    skip = max(0, -away)
                    sums = up[:, : size + 1 - skip] + down[:, skip:]
                    cut = np.argmax(sums, axis=1)
                    place = np.arange(size)
                    both = np.where(place < cut[:, None], head, tail & (place >= cut[:, None] + skip))
                    cost = np.full((len(left), size), EQUAL) + (place == cut[:, None]) * EQUAL * max(0, away)
                    keep(own[left], by[left] + first_part, by[left] + second, _stretches(both, cost), cut)
    if not parts:
        return []
    # The best alignment of each document and item; the first place of equals.
    all_of = np.concatenate(parts, axis=1)
    all_of = all_of[:, np.lexsort((all_of[3], -all_of[2], all_of[1], all_of[0]))]
    new = np.ones(all_of.shape[1], dtype=bool)
    new[1:] = (all_of[0, 1:] != all_of[0, :-1]) | (all_of[1, 1:] != all_of[1, :-1])
    return [tuple(x) for x in all_of[:, new].T.tolist()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += 1 + len(r["t"]) // 4
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


SCHEMA = "doc_id long, item_id long, n_match long, start_word long, end_word long, item_words long"


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_match (matching words of the best overlap),
    start_word and end_word (its place in the document, end exclusive), item_words.

    Null and empty documents or items overlap with nothing; items with a null id are passed over; a document with
    a null id gives rows with a null doc_id.  Repeated documents or items each give their rows; of equally long
    overlaps the first place wins.  An empty table on either side gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for ids, texts in _blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(build_index(ids, texts))  # bounded by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                data, offsets = B.column_buffers(batch.column(1))
                names = batch.column(0).to_pylist()
                for lo, hi, d, o in B.blocks(data, offsets):
                    words, owner = words_of(d, o)
                    found = find_overlaps(index, words, owner, hi - lo)
                    if found:
                        cols = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[lo + x] for x in cols[0]], pa.int64()), pa.array(index.ids[list(cols[1])]), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                            names=["doc_id", "item_id", "n_match", "start_word", "end_word", "item_words"],
                        )

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item, by one narrow pass a block; columns stay as they are.

    Null, empty and wordless texts stay; ids are not looked at; repeated rows share their fate; texts of any length are
    read whole; null and empty items overlap with nothing, and without items every row stays; an empty table gives no
    rows.  An item of fewer than five words counts only where all of it stands.
    """
    spark, schema = docs.sparkSession, docs.schema
    at = docs.columns.index("text")
    for ids, texts in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(build_index(ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                data, offsets = B.column_buffers(batch.column(at))
                for lo, hi, d, o in B.blocks(data, offsets):
                    words, owner = words_of(d, o)
                    keep[[lo + x[0] for x in find_overlaps(shared.value, words, owner, hi - lo)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
