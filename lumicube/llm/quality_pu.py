"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk (Kiryo et al., 2017).

Trusted positives are labelled documents of good quality; the unlabelled sample is other text of the corpus, whose
labels are never read.  With class prior p, the risk is p * R_P(+) + max(0, R_U(-) - p * R_P(-)): when the estimate
of the negatives' risk falls below zero, the step turns against it.  The prior is estimated from a first classifier
of labelled against unlabelled text by the share of unlabelled text that scores like positives.

The model is a small network over the shares of character classes, of shapes of words and of repetition in a
text; every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _bytes as B
from .toxicity import held_out, training_sample

#: Texts that training reads at most: trusted positives and unlabelled; texts of more characters are passed over.
MAX_POSITIVE, MAX_UNLABELLED, MAX_CHARS = 2000, 4000, 50_000
HIDDEN, EPOCHS, BATCH, RATE = 16, 60, 256, 0.01
#: Score from which a document is predicted to be good.
CUT = 0.7

_CLASSES = {
    "lower": B.byte_class((0x61, 0x7A)),
    "upper": B.byte_class((0x41, 0x5A)),
    "digit": B.byte_class((0x30, 0x39)),
    "space": B.byte_class((0x20, 0x20), (0x09, 0x09)),
    "line": B.byte_class((0x0A, 0x0D)),
    "high": B.byte_class((0x80, 0xFF)),
    "stop": B.byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B)),
    "loud": B.byte_class((0x21, 0x21), (0x3F, 0x3F)),
    "quote": B.byte_class((0x22, 0x22), (0x27, 0x29), (0x2D, 0x2D)),
}
_CLASSES["symbol"] = ~np.logical_or.reduce(list(_CLASSES.values()))
_TABLE = np.stack(list(_CLASSES.values()), axis=0)
N_FEATURES = len(_CLASSES) + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES) shares of the texts of a block; zeros where a text is empty."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    first = offsets[:-1][some]
    for k, table in enumerate(_TABLE):
        out[some, k] = np.add.reduceat(table[data].astype(np.int32), first) / size[some]
    starts, ends, docs = B.find_words(data, offsets, B.NON_SPACE)
    if not len(starts):
        return out
    words = np.bincount(docs, minlength=n)
    have = np.flatnonzero(words)
    at = (np.cumsum(words) - words)[have]
    m = words[have].astype(float)
    mean = lambda x: np.add.reduceat(x.astype(np.float64), at) / m
    lens = ends - starts
    hashes = B.hash_spans(data, starts, ends)
    k = len(_CLASSES)
    out[have, k] = np.log1p(mean(lens)) / 4
    last = data[ends - 1]
    out[have, k + 1] = mean(_CLASSES["symbol"][last] & (lens > 1))
    out[have, k + 2] = mean(_CLASSES["loud"][last])
    up = np.concatenate(([0], np.cumsum(_CLASSES["upper"][data])))
    out[have, k + 3] = mean((up[ends] - up[starts]) * 2 > lens)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    out[have, k + 4] = mean(again)
    order = np.lexsort((hashes, docs))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    distinct = np.bincount(docs[order][new], minlength=n)[have]
    # Distinct words against what a text of this many words usually has.
    out[have, k + 5] = np.log1p(distinct) / np.log1p(m)
    out[have, k + 6] = np.log1p(m) / 10
    out[have, k + 7] = mean((lens == 1) & _CLASSES["symbol"][data[starts]])
    pairs, owner = B.shingles(hashes, docs, n, 2)[::-1]
    order = np.lexsort((pairs, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (pairs[order][1:] != pairs[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    total, once = np.bincount(owner, minlength=n)[have], np.bincount(owner[order][new], minlength=n)[have]
    out[have, k + 8] = 1 - once / np.maximum(total, 1)
    return out


def features_of(texts: list[str]) -> np.ndarray:
    data, offsets = B.column_buffers(pa.array(texts, pa.string()))
    parts = [features(d, o) for _, _, d, o in B.blocks(data, offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


class Net:
    """One hidden layer, trained by Adam on given derivatives of the loss by the logit."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, 0.4, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.4, HIDDEN), np.zeros(1)]
        self.m = [(np.zeros_like(v), np.zeros_like(v)) for v in self.p]
        self.t = 0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def step(self, x: np.ndarray, d: np.ndarray, rate: float) -> None:
        h = np.tanh(x @ self.p[0] + self.p[1])
        dh = d[:, None] * self.p[2] * (1 - h * h)
        self.t += 1
        for k, g in enumerate((x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True))):
            g = g + 1e-4 * self.p[k]
            a, b = self.m[k]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            self.p[k] = self.p[k] - rate * (a / (1 - 0.9**self.t)) / (np.sqrt(b / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3, slack: float = 0.0) -> Net:
    """Minimise the non-negative risk with the sigmoid loss."""
    r, net = np.random.default_rng(seed), Net(seed)
    n = max(1, len(unlabelled) // BATCH)
    for epoch in range(EPOCHS):
        pu, pp = np.array_split(r.permutation(len(unlabelled)), n), np.array_split(r.permutation(len(positive)), n)
        rate = RATE if epoch < EPOCHS * 2 // 3 else RATE / 5
        for u, p in zip(pu, pp, strict=True):
            if not len(p) or not len(u):
                continue
            xp, xu = positive[p], unlabelled[u]
            sp, su = _sigmoid(net.logits(xp)), _sigmoid(net.logits(xu))
            # loss of a positive label: 1 - s; of a negative label: s
            below = su.mean() - prior * sp.mean()
            dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
            if below >= -slack:
                grad = np.concatenate((-prior * dp - prior * dp, du))
            else:
                grad = np.concatenate((prior * dp, -du))
            net.step(np.concatenate((xp, xu)), grad, rate)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """Share of positives in the unlabelled sample.

    A classifier of positive against unlabelled text orders both; above a cut that keeps a share t of the positives,
    the unlabelled share is at least t * prior.  The least ratio over cuts with enough positives, with a margin for
    the sample's size, bounds the prior from above.  With fewer than ten texts of a kind to order it is 0.8.
    """
    r, net = np.random.default_rng(seed), Net(seed)
    x = np.concatenate((positive, unlabelled))
    y = np.concatenate((np.ones(len(positive)), np.zeros(len(unlabelled))))
    w = np.where(y > 0, 0.5 / max(1, len(positive)), 0.5 / max(1, len(unlabelled))) * len(x)
    fit_on = np.arange(len(x)) % 2 == 0
    for _ in range(30):
        for b in np.array_split(r.permutation(np.flatnonzero(fit_on)), max(1, len(x) // (2 * BATCH))):
            net.step(x[b], w[b] * (_sigmoid(net.logits(x[b])) - y[b]) / len(b), RATE)
    s, rest = net.logits(x), ~fit_on
    sp, su = np.sort(s[rest & (y > 0)]), np.sort(s[rest & (y == 0)])
    if len(sp) < 10 or len(su) < 10:
        return 0.8
    cuts = np.quantile(sp, np.linspace(0.02, 0.7, 35))
    kept = 1 - np.searchsorted(sp, cuts) / len(sp)
    seen = 1 - np.searchsorted(su, cuts) / len(su)
    ratio = seen / kept + np.sqrt(seen * (1 - seen) / len(su)) / kept
    return float(np.clip(ratio.min(), 0.05, 0.95))


@dataclass
class Model:
    net: Net | None
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    shift: float  # added to logits: places the share ``prior`` of the unlabelled sample above CUT

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = features(data, offsets)
        if self.net is None:
            return np.full(len(x), self.prior)
        # The last digits of a product depend on a text's place in its block; six digits don't.
        out = np.round(_sigmoid(self.net.logits((x - self.mean) / self.scale) + self.shift), 6)
        return np.where(np.diff(offsets) > 0, out, 0.0)


def train(positive: list[str], unlabelled: list[str], seed: int = 3) -> Model:
    """Fit on whole texts; without positives or unlabelled texts every score is 0.8."""
    if not positive or not unlabelled:
        return Model(None, np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.8, 0.0)
    xp, xu = features_of(positive), features_of(unlabelled)
    mean, scale = xu.mean(axis=0), xu.std(axis=0) + 1e-3
    xp, xu = (xp - mean) / scale, (xu - mean) / scale
    prior = estimate_prior(xp, xu, seed)
    net = train_nnpu(xp, xu, prior, seed)
    # The cut lies in the widest gap between the scores around the prior's quantile.
    s = np.sort(net.logits(xu))
    lo, hi = int(len(s) * max(0.0, 1 - prior - 0.05)), int(len(s) * min(1.0, 1 - prior + 0.05))
    part = s[lo : max(hi, lo + 2)]
    k = int(np.argmax(np.diff(part))) if len(part) > 1 else 0
    cut = (part[k] + part[min(k + 1, len(part) - 1)]) / 2 if len(part) else 0.0
    return Model(net, mean, scale, prior, float(np.log(CUT / (1 - CUT)) - cut))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trusted positives are training rows with quality 1; unlabelled texts are those whose id hash is smallest.

    Rows with a null id, an empty or null text or more than MAX_CHARS characters teach nothing; rows that share an id
    each teach with their text; without positives or texts every score is 0.8; labels of quality 0 are never read.
    """
    fold = held_out(F.col("doc_id"), 4, 2)
    positive, _ = training_sample(docs, labels, "quality", fold, {1: MAX_POSITIVE}, MAX_CHARS)
    # Ids alone are ordered; only the texts of those picked are read, and of repeated ids one each.
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(MAX_UNLABELLED)
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, MAX_CHARS)).join(F.broadcast(ids), "doc_id")
    unlabelled = texts.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).column("text").to_pylist()
    return train(positive, unlabelled)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= CUT).

    A null or empty text scores 0; a null id stays null with held_out false; repeated rows are repeated with equal
    scores; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_buffers(batch.column(1))
            for lo, hi, d, o in B.blocks(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.scores(d, o), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", _fold().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _fold() -> Column:
    return held_out(F.col("doc_id"), 4, 2)
