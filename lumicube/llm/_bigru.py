"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are windows of words.  A word enters as its embedding (row 0 stands for words outside the vocabulary) and
the mean embedding of its character pairs.  Training uses Adam on the logistic loss.
"""

from __future__ import annotations

import numpy as np

WORD_DIM = CHAR_DIM = HIDDEN = ATTENTION = 8
CHAR_BUCKETS = 1024
#: Embeddings shrink by this share of the learning rate a step, so that words without evidence fade.
DECAY = 0.3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pair_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character pairs of the words (the first pairs with a boundary), and each word's first place."""
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.repeat(starts - at, lens) + np.arange(lens.sum())
    now = data[place].astype(np.int64)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[at] = 0
    return (before * 271 + now * 53) % CHAR_BUCKETS, at


class BiGru:
    def __init__(self, vocabulary: int, seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": r.normal(0, 0.3, (vocabulary + 1, WORD_DIM)),
            "char": r.normal(0, 0.3, (CHAR_BUCKETS, CHAR_DIM)),
            "att": r.normal(0, 0.3, (2 * h, ATTENTION)),
            "att_v": r.normal(0, 0.3, ATTENTION),
            "out": r.normal(0, 0.3, 2 * h),
            "bias": np.zeros(1),
        }
        for side in "fb":
            self.p |= {f"W{side}": r.normal(0, 0.3, (d, 3 * h)), f"U{side}": r.normal(0, 0.3, (h, 3 * h)), f"c{side}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def inputs(self, word_ids: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        lens = np.diff(np.append(at, len(buckets)))
        chars = np.add.reduceat(self.p["char"][buckets], at, axis=0) / lens[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][word_ids], chars), axis=1)

    def _run(self, side: str, xp: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, windows, hidden); xp are the steps' input projections."""
        steps, n, _ = xp.shape
        h = HIDDEN
        U = self.p[f"U{side}"]
        state, out, tape = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = state @ U
            zr = sigmoid(xp[t, :, : 2 * h] + g[:, : 2 * h])
            z, rst = zr[:, :h], zr[:, h:]
            new = np.tanh(xp[t, :, 2 * h :] + rst * g[:, 2 * h :])
            m = mask[t][:, None]
            nxt = state + m * (1 - z) * (new - state)
            if keep:
                tape.append((t, state, z, rst, new, g[:, 2 * h :]))
            state = nxt
            out[t] = state
        return out, tape

    def logits(self, project_f: np.ndarray, project_b: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows whose input projections are given as (steps, windows, 3 hidden)."""
        H = np.concatenate((self._run("f", project_f, mask, False)[0], self._run("b", project_b, mask, False)[0]), axis=2)
        e = np.exp(np.minimum(np.tanh(H @ self.p["att"]) @ self.p["att_v"], 30)) * mask
        pooled = np.einsum("tn,tnh->nh", e, H) / np.maximum(e.sum(axis=0), 1e-9)[:, None]
        return pooled @ self.p["out"] + self.p["bias"][0]

    def projections(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]

    def step(self, word_ids: np.ndarray, buckets: np.ndarray, at: np.ndarray, windows: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One Adam step on windows of indices into the distinct words given; returns the loss."""
        p, h = self.p, HIDDEN
        x = self.inputs(word_ids, buckets, at)
        steps, n = windows.shape
        xw = x[windows]
        runs = {s: self._run(s, xw @ p[f"W{s}"] + p[f"c{s}"], mask, True) for s in "fb"}
        H = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        a = np.tanh(H @ p["att"])
        s = a @ p["att_v"]
        e = np.exp(np.minimum(s, 30)) * mask
        norm = np.maximum(e.sum(axis=0), 1e-9)
        alpha = e / norm
        pooled = np.einsum("tn,tnh->nh", alpha, H)
        prob = sigmoid(pooled @ p["out"] + p["bias"][0])
        loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / weight.sum())
        d = (weight * (prob - y) / weight.sum()).astype(np.float32)
        grad = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["out"]
        dH = alpha[:, :, None] * d_pool
        d_alpha = np.einsum("tnh,nh->tn", H, d_pool)
        ds = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["att_v"] = np.einsum("tn,tna->a", ds, a)
        da = ds[:, :, None] * p["att_v"] * (1 - a * a)
        grad["att"] = np.einsum("tnh,tna->ha", H, da)
        dH = dH + da @ p["att"].T
        dx = np.zeros_like(xw)
        for side, part in (("f", dH[:, :, :h]), ("b", dH[:, :, h:])):
            U = p[f"U{side}"]
            dU, dxp, carry = np.zeros_like(U), np.zeros((steps, n, 3 * h), np.float32), np.zeros((n, h), np.float32)
            for t, state, z, rst, new, gn in reversed(runs[side][1]):
                carry = carry + part[t]
                m = mask[t][:, None]
                upd = m * carry
                d_new = upd * (1 - z) * (1 - new * new)
                d_z = -upd * (new - state) * z * (1 - z)
                d_r = d_new * gn * rst * (1 - rst)
                dg = np.concatenate((d_z, d_r, d_new * rst), axis=1)
                dxp[t] = np.concatenate((d_z, d_r, d_new), axis=1)
                dU += state.T @ dg
                carry = carry - upd * (1 - z) + dg @ U.T
            grad[f"U{side}"] = dU
            grad[f"c{side}"] = dxp.sum(axis=(0, 1))
            grad[f"W{side}"] = np.einsum("tnd,tng->dg", xw, dxp)
            dx += dxp @ p[f"W{side}"].T
        by_word = np.zeros_like(x)
        np.add.at(by_word, windows.ravel(), dx.reshape(-1, dx.shape[2]))
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], word_ids, by_word[:, :WORD_DIM])
        lens = np.diff(np.append(at, len(buckets)))
        grad["char"] = np.zeros_like(p["char"])
        np.add.at(grad["char"], buckets, np.repeat(by_word[:, WORD_DIM:] / lens[:, None], lens, axis=0))
        self.t += 1
        for k, g in grad.items():
            if k in ("word", "char"):
                p[k] *= np.float32(1 - rate * DECAY)
            m1, m2 = self.m[k]
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p[k] -= (rate * (m1 / (1 - 0.9**self.t)) / (np.sqrt(m2 / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
        return loss
