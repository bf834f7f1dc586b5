"""Toxicity: a bidirectional gated recurrent network over overlapping windows of words (see ``_bigru``).

The network is trained on the driver, on a bounded sample of labelled documents.  Labels hold for documents, so
training alternates: a toxic document teaches by its currently most toxic windows, a clean one by all of its
sampled windows.  A document's score is that of its most toxic window; every window of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _bytes as B
from ._bigru import BiGru, pair_buckets, sigmoid

#: Words of a window, and words from one window to the next.
WINDOW, STRIDE = 24, 12
#: Labelled documents that the training reads at most, by label; documents of more characters are passed over.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 2500, 20_000
VOCABULARY, EPOCHS, BATCH, RATE = 300, 8, 256, 0.01
#: After the first epochs, a toxic document whose best window stays below this probability counts as mislabelled.
DOUBTFUL = 0.5
#: One in so many sampled documents is kept from training and sets the cut, if the sample has TUNING_LEAST texts at
#: least; a smaller one sets the cut on the training texts themselves.
TUNING, TUNING_LEAST = 5, 1000
CLEAN_WINDOWS, TOXIC_WINDOWS = 6, 2
#: Small samples get more epochs, about so many steps in all.
STEPS = 120


@dataclass
class Words:
    """Words of a block of documents: distinct words, and the places as numbers of distinct words."""

    hashes: np.ndarray  # of distinct words, ascending
    place: np.ndarray  # number of the distinct word at each place
    docs: np.ndarray  # document of each place
    starts: np.ndarray  # spans of the distinct words
    ends: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        data = B.lower_ascii(data)
        starts, ends, docs = B.find_words(data, offsets, B.ALNUM)
        hashes, first, place = np.unique(B.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        return cls(hashes, place, docs, starts[first], ends[first], data)


def windows(docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, mask, document) of all windows; places and mask are (steps, windows).  Documents without words have none."""
    counts = np.bincount(docs, minlength=n_docs) if len(docs) else np.zeros(n_docs, np.int64)
    first = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE)), 0)
    owner = np.repeat(np.arange(n_docs), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (first[owner] + k * STRIDE).astype(np.int32) + np.arange(WINDOW, dtype=np.int32)[:, None]
    mask = at < (first + counts)[owner]
    at[~mask] = 0
    return at, mask, owner


def _gather(texts: list[str]) -> tuple[Words, list[tuple]]:
    """Words of all texts, built block by block to keep temporary arrays small; and the keys by which copies are known."""
    data, offsets = B.column_buffers(pa.array(texts, pa.string()))
    low = B.lower_ascii(data)
    parts = []
    for lo, _, d, o in B.blocks(low, offsets):
        starts, ends, docs = B.find_words(d, o, B.ALNUM)
        parts.append((B.hash_spans(d, starts, ends), starts + offsets[lo], ends + offsets[lo], docs + lo))
    hashes, starts, ends, docs = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    cuts = np.searchsorted(docs, np.arange(len(texts) + 1))
    keys = [tuple(np.unique(hashes[cuts[k] : cuts[k + 1]])[:4].tolist()) for k in range(len(texts))]
    return Words(distinct, place, docs, starts[first], ends[first], low), keys


@dataclass
class Model:
    net: BiGru | None
    vocabulary: np.ndarray  # ascending hashes
    shift: float  # added to logits, so that the best cut on the training sample is at 0.5
    empty: float  # score of a text without words

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def window_logits(self, words: Words, places: np.ndarray, mask: np.ndarray) -> np.ndarray:
        buckets, at = pair_buckets(words.data, words.starts, words.ends)
        x = self.net.inputs(self._ids(words.hashes), buckets, at)
        pf, pb = self.net.projections(x)
        out = np.empty(places.shape[1], np.float32)
        for lo in range(0, places.shape[1], 2048):
            ix = words.place[places[:, lo : lo + 2048]]
            out[lo : lo + 2048] = self.net.logits(pf[ix], pb[ix], mask[:, lo : lo + 2048].astype(np.float32))
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of windows of each document of a block."""
        n = len(offsets) - 1
        score, count = np.full(n, self.empty), np.zeros(n, np.int64)
        words = Words.of(data, offsets)
        if self.net is None or not len(words.place):
            return score, count
        places, mask, owner = windows(words.docs, n)
        best = np.full(n, -np.inf)
        np.maximum.at(best, owner, self.window_logits(words, places, mask))
        count = np.bincount(owner, minlength=n)
        some = count > 0
        # Sums in single precision depend on a text's place in its block; six digits don't.
        score[some] = np.round(sigmoid(best[some] + self.shift), 6)
        return score, count


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Model:
    """Fit on whole texts with labels 0 and 1; without both labels every text scores 0.

    Of copies, which share their four smallest word hashes, only the first teaches: one wrong label of a group of
    copies would else weigh as many times as the group has members.
    """
    if not len(texts):
        return Model(None, np.zeros(0, np.uint64), 0.0, 0.0)
    first: dict[tuple, int] = {}
    for k, key in enumerate(_gather(texts)[1]):
        first.setdefault((int(toxic[k]), *key), k)
    texts, toxic = [texts[k] for k in first.values()], np.asarray(toxic)[list(first.values())]
    y = np.asarray(toxic, dtype=np.float32)
    if y.min() == y.max():
        return Model(None, np.zeros(0, np.uint64), 0.0, 0.0)
    words = _gather(texts)[0]
    n = len(texts)
    r = np.random.default_rng(seed)
    # A word's log-odds between toxic and clean documents pick the vocabulary and the first windows.
    size = max(1, len(words.hashes))
    pair = np.divmod(np.unique(words.docs.astype(np.int64) * size + words.place), size)  # (document, word), each once
    bad = np.bincount(pair[1], weights=y[pair[0]], minlength=len(words.hashes))
    good = np.bincount(pair[1], minlength=len(words.hashes)) - bad
    odds = np.log((bad + 0.2) / (y.sum() + 1)) - np.log((good + 0.2) / (n - y.sum() + 1))
    known = np.flatnonzero(bad + good >= 3)
    merit = np.abs(odds[known]) * np.sqrt((bad + good)[known])
    chosen = known[np.argsort(-merit, kind="stable")[:VOCABULARY]]
    model = Model(BiGru(len(chosen), seed), np.sort(words.hashes[chosen]), 0.0, 0.0)
    ids = model._ids(words.hashes)
    places, mask, owner = windows(words.docs, n)
    if not len(owner):
        return Model(None, np.zeros(0, np.uint64), 0.0, 0.0)
    worth = np.maximum(odds * np.minimum(1, (bad + good) / 5), 0)
    prior = np.concatenate([np.where(mask[:, a : a + 4096], worth[words.place[places[:, a : a + 4096]]], 0).max(axis=0) for a in range(0, len(owner), 4096)])
    tuning = np.arange(n) % TUNING == 0 if n >= TUNING_LEAST else np.zeros(n, dtype=bool)
    epochs = max(EPOCHS, -(-STEPS // max(1, n * CLEAN_WINDOWS // BATCH)))
    for epoch in range(epochs):
        rank = prior if epoch == 0 else model.window_logits(words, places, mask)
        rank = rank + 1e-6 * r.random(len(rank))
        order = np.lexsort((-rank, owner))
        nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        # Clean documents give their most toxic windows and some others.
        some = r.random(len(order)) < CLEAN_WINDOWS / np.maximum(1, np.bincount(owner, minlength=n)[owner[order]])
        order, nth, some = (v[~tuning[owner[order]]] for v in (order, nth, some))
        use = order[np.where(y[owner[order]] > 0, nth < TOXIC_WINDOWS, (nth < 2) | some)]
        use = use[r.permutation(len(use))]
        if epoch >= epochs // 4:
            top = np.full(n, -np.inf)
            np.maximum.at(top, owner, rank)
            doubt = (y > 0) & (sigmoid(top) < DOUBTFUL)
            if doubt.sum() < 0.3 * y.sum():
                use = use[~doubt[owner[use]]]
        target = y[owner[use]]
        heavy = min(4.0, max(1.0, (len(use) - target.sum()) / max(1.0, target.sum())))
        for lo in range(0, len(use), BATCH):
            w = use[lo : lo + BATCH]
            inner, ix = np.unique(words.place[places[:, w]], return_inverse=True)
            buckets, at = pair_buckets(words.data, words.starts[inner], words.ends[inner])
            yw = y[owner[w]]
            model.net.step(ids[inner], buckets, at, ix.reshape(WINDOW, -1), mask[:, w].astype(np.float32), yw, np.where(yw > 0, heavy, 1.0).astype(np.float32), RATE if epoch < epochs - 3 else RATE / 4)
    best = np.full(n, -20.0)
    np.maximum.at(best, owner, model.window_logits(words, places, mask))
    own = np.flatnonzero(tuning) if y[tuning].any() else np.arange(n)
    order = own[np.argsort(-best[own], kind="stable")]
    hit = np.cumsum(y[order])
    # F-measure with precision weighed more than recall: clean documents are to stay.
    k = int(np.argmax(1.25 * hit / (np.arange(1, len(own) + 1) + 0.25 * y[own].sum())))
    cut = (best[order[k]] + (best[order[k + 1]] if k + 1 < len(own) else best[order[k]] - 2)) / 2
    model.net.m = {}  # the optimiser's state is not needed any more
    return Model(model.net, model.vocabulary, float(-cut), float(min(0.49, y.mean())) if y.mean() < 0.5 else 0.0)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: dict[int, int], max_chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of ``most[label]`` labelled documents at most, those whose id hash is smallest.

    Only ids, texts and the named label are read; rows of the fold and rows without id, text or label are left out.
    """
    ids = labels.filter(~fold).filter(F.col("doc_id").isNotNull() & F.col(label).isin(*most)).groupBy("doc_id").agg(F.min(label).alias("y"))
    picked = None
    for value, limit in most.items():
        part = ids.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        picked = part if picked is None else picked.union(part)
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, max_chars)).join(F.broadcast(picked), "doc_id")
    rows = texts.select("doc_id", "text", "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return rows.column("text").to_pylist(), np.asarray(rows.column("y"), dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold, a bounded sample of them.

    Rows with a null id, label or text, an empty text or more than MAX_CHARS characters teach nothing; an id with both
    labels counts as clean; rows that share an id each teach with their text; without both labels every text scores 0.
    """
    return train(*training_sample(docs, labels, "toxic", held_out(F.col("doc_id"), 5, 0), {1: MAX_TOXIC, 0: MAX_CLEAN}))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5), n_windows.

    A null, empty or wordless text has no window and a score below 0.5; a null id stays null with held_out false;
    repeated rows are repeated with equal scores; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary and weights: bounded by the constants above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_buffers(batch.column(1))
            for lo, hi, d, o in B.blocks(data, offsets, 1 << 19):
                score, n = shared.value.scores(d, o)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "n_windows"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_windows long")
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject (score below 0.5); columns stay as they are.

    Null, empty and wordless texts stay, and so does a null id with its text; repeated rows share their fate; texts of
    any length are read whole; an empty table gives no rows.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_buffers(batch.column(at))
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, hi, d, o in B.blocks(data, offsets, 1 << 19):
                keep[lo:hi] = shared.value.scores(d, o)[0] < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
