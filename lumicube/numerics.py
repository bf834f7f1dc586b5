"""Vectorised solvers: one call solves a batch of independent problems."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MACHINE_EPSILON = 2.220446049250313e-16
SQRT_EPSILON = 1.4901161193847656e-08
_GOLDEN = 1.0 / 0.381966 - 1.0

Function = Callable[[np.ndarray], np.ndarray]
#: Many functions: values at points, one for each of the numbered functions.
Lines = Callable[[np.ndarray, np.ndarray], np.ndarray]


def is_bracket(f: Function, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the function's values at the ends have different signs, or one of them is 0."""
    return f(a) * f(b) <= 0


def brent_roots(f: Function, a: np.ndarray, b: np.ndarray, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Roots in the brackets [a, b] by Brent's method, all functions in step, and the steps that each took.

    Per function: ``best`` is the best estimate so far, ``last`` the one before, ``other`` the end with the other sign.
    A step is inverse quadratic through the three (a secant where only two differ), and a bisection where that would
    leave the bracket's near three quarters, or not halve the step before the last.  A function is done when half the
    bracket is within rounding of its root.  Brackets must hold a change of sign, or a root at an end.
    """
    last, best = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    f_last, f_best = f(last), f(best)
    other, f_other = last.copy(), f_last.copy()
    move = before = best - last
    steps = np.zeros(len(best), dtype=int)
    for _ in range(most):
        same = np.sign(f_best) == np.sign(f_other)  # the other end must have the other sign
        other, f_other = np.where(same, last, other), np.where(same, f_last, f_other)
        move, before = np.where(same, best - last, move), np.where(same, best - last, before)
        swap = np.abs(f_other) < np.abs(f_best)
        last, best, other = np.where(swap, best, last), np.where(swap, other, best), np.where(swap, best, other)
        f_last, f_best, f_other = np.where(swap, f_best, f_last), np.where(swap, f_other, f_best), np.where(swap, f_best, f_other)
        tolerance = 0.5 * MACHINE_EPSILON * np.abs(best)
        half = (other - best) / 2
        live = (f_best != 0) & (np.abs(half) > tolerance)
        if not live.any():
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            s, q, r = f_best / f_last, f_last / f_other, f_best / f_other
            two = last == other
            p = np.where(two, 2 * half * s, s * (2 * half * q * (q - r) - (best - last) * (r - 1)))
            d = np.where(two, 1 - s, (q - 1) * (r - 1) * (s - 1))
            d, p = np.where(p > 0, -d, d), np.abs(p)
            fits = (np.abs(before) >= tolerance) & (np.abs(f_last) > np.abs(f_best)) & (2 * p < np.minimum(3 * half * d - np.abs(tolerance * d), np.abs(before * d)))
            before, move = np.where(fits, move, half), np.where(fits, p / d, half)
        step = np.where(np.abs(move) > tolerance, move, np.where(half > 0, tolerance, -tolerance))
        last, f_last = np.where(live, best, last), np.where(live, f_best, f_last)
        best = np.where(live, best + step, best)
        f_best = np.where(live, f(best), f_best)
        steps += live
    return best, steps


def roots(f: Function, a: np.ndarray, b: np.ndarray, most: int = 200) -> np.ndarray:
    """Roots in the brackets [a, b] by ``brent_roots``.

    An end that is a root is returned; without a change of sign, the end with the smaller absolute value is.
    """
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    fa, fb = f(a), f(b)
    bad = np.sign(fa) * np.sign(fb) > 0
    found, _ = brent_roots(f, a, b, most)
    return np.where(fa == 0, a, np.where(fb == 0, b, np.where(bad, np.where(np.abs(fa) <= np.abs(fb), a, b), found)))


def bracket_minimum(f: Callable[[float], float], a: float, b: float, most: int = 100) -> tuple[float, float, float]:
    """(low, inner, high) around a minimum, by growing the interval downhill in golden proportion."""
    fa, fb = f(a), f(b)
    if fb > fa:
        a, b, fa, fb = b, a, fb, fa
    c = b + _GOLDEN * (b - a)
    fc = f(c)
    for _ in range(most):
        if fc >= fb:
            break
        a, b, c = b, c, c + _GOLDEN * (c - b)
        fb, fc = fc, f(c)
    return min(a, c), b, max(a, c)


def minimum(f: Callable[[float], float], low: float, inner: float, high: float, tolerance: float = 1e-10, most: int = 100) -> float:
    """Place of a minimum in a bracket, by parabolic steps guarded by golden sections."""
    ratio = 0.3819660112501051
    x = w = v = inner
    fx = fw = fv = f(inner)
    step = last = 0.0
    for _ in range(most):
        mid = (low + high) / 2
        tol = SQRT_EPSILON * abs(x) + tolerance
        if abs(x - mid) <= 2 * tol - (high - low) / 2:
            break
        golden = True
        if abs(last) > tol:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(q * last / 2) and q * (low - x) < p < q * (high - x):
                last, step, golden = step, p / q, False
        if golden:
            last = (high if x < mid else low) - x
            step = ratio * last
        u = x + (step if abs(step) >= tol else (tol if step > 0 else -tol))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, w, x, fv, fw, fx = w, x, u, fw, fx, fu
        else:
            low, high = (low, u) if u >= x else (u, high)
            if fu <= fw or w == x:
                v, w, fv, fw = w, u, fw, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x


def minimum_powell(f: Callable[[np.ndarray], float], x: np.ndarray, scale: float = 1.0, accuracy: float = 1e-10, most: int = 200) -> np.ndarray:
    """Minimum over several variables by line minimisations along a set of directions that is renewed."""
    x = np.array(x, dtype=np.float64)
    ways = np.eye(len(x)) * scale
    fx = f(x)
    for _ in range(most):
        start, f0, drop, which = x.copy(), fx, 0.0, 0
        for i, d in enumerate(ways):
            before = fx
            along = lambda t, d=d: f(x + t * d)
            lo, mid, hi = bracket_minimum(along, 0.0, 1.0)
            t = minimum(along, lo, mid, hi)
            if along(t) < fx:
                x = x + t * d
                fx = f(x)
            if before - fx > drop:
                drop, which = before - fx, i
        if 2 * (f0 - fx) <= accuracy * (abs(f0) + abs(fx)) + 1e-300:
            break
        new = x - start
        if f(x + new) < f0:
            ways[which] = ways[-1]
            ways[-1] = new
    return x


def brackets(f: Lines, a: np.ndarray, b: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bracket_minimum`` of many functions at once: f(t, rows) gives the values of the functions ``rows`` at ``t``."""
    every = np.arange(len(a))
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    fa, fb = f(a, every), f(b, every)
    up = fb > fa
    a, b, fb = np.where(up, b, a), np.where(up, a, b), np.where(up, fa, fb)
    c = b + _GOLDEN * (b - a)
    fc = f(c, every)
    live = np.flatnonzero(fc < fb)
    for _ in range(most):
        if not len(live):
            break
        a[live], b[live], fb[live] = b[live], c[live], fc[live]
        c[live] = b[live] + _GOLDEN * (b[live] - a[live])
        fc[live] = f(c[live], live)
        live = live[fc[live] < fb[live]]
    return np.minimum(a, c), b, np.maximum(a, c)


def minima(f: Lines, low: np.ndarray, inner: np.ndarray, high: np.ndarray, tolerance: float = 1e-10, relative: float = SQRT_EPSILON, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """``minimum`` of many functions at once: the places, and the values there."""
    ratio = 0.3819660112501051
    low, high, x = (np.array(v, dtype=np.float64) for v in (low, high, inner))
    w, v = x.copy(), x.copy()
    fx = f(x, np.arange(len(x)))
    fw, fv = fx.copy(), fx.copy()
    step, last = np.zeros(len(x)), np.zeros(len(x))
    live = np.arange(len(x))
    for _ in range(most):
        mid, tol = (low[live] + high[live]) / 2, relative * np.abs(x[live]) + tolerance
        on = np.abs(x[live] - mid) > 2 * tol - (high[live] - low[live]) / 2
        live, mid, tol = live[on], mid[on], tol[on]
        if not len(live):
            break
        xs, ws, vs = x[live], w[live], v[live]
        r, q = (xs - ws) * (fx[live] - fv[live]), (xs - vs) * (fx[live] - fw[live])
        p, q = (xs - vs) * q - (xs - ws) * r, 2 * (q - r)
        p, q = np.where(q > 0, -p, p), np.abs(q)
        fits = (np.abs(last[live]) > tol) & (np.abs(p) < np.abs(q * last[live] / 2)) & (p > q * (low[live] - xs)) & (p < q * (high[live] - xs))
        wide = np.where(xs < mid, high[live], low[live]) - xs
        with np.errstate(divide="ignore", invalid="ignore"):
            parabolic = p / q
        last[live], step[live] = np.where(fits, step[live], wide), np.where(fits, parabolic, ratio * wide)
        s = step[live]
        u = xs + np.where(np.abs(s) >= tol, s, np.where(s > 0, tol, -tol))
        fu = f(u, live)
        better, right = fu <= fx[live], u >= xs
        low[live] = np.where(better, np.where(right, xs, low[live]), np.where(right, low[live], u))
        high[live] = np.where(better, np.where(right, high[live], xs), np.where(right, u, high[live]))
        second = ~better & ((fu <= fw[live]) | (ws == xs))
        third = ~better & ~second & ((fu <= fv[live]) | (vs == xs) | (vs == ws))
        v[live], fv[live] = np.where(better | second, ws, np.where(third, u, vs)), np.where(better | second, fw[live], np.where(third, fu, fv[live]))
        w[live], fw[live] = np.where(better, xs, np.where(second, u, ws)), np.where(better, fx[live], np.where(second, fu, fw[live]))
        x[live], fx[live] = np.where(better, u, xs), np.where(better, fu, fx[live])
    return x, fx


def minima_powell(f: Lines, x: np.ndarray, accuracy: float = 1e-10, most: int = 200, line: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Minima of many functions of several variables at once, and the values there; a row of ``x`` is a function's start.

    f(points, rows) gives the values of the functions ``rows``, one point each.  All functions search along their own
    directions in step; a function that has converged is left out of further rounds.
    """
    x = np.array(x, dtype=np.float64)
    rows, size = x.shape
    ways = np.broadcast_to(np.eye(size), (rows, size, size)).copy()
    fx = f(x, np.arange(rows))
    live = np.arange(rows)
    for _ in range(most):
        start, f0 = x[live].copy(), fx[live].copy()
        drop, which = np.zeros(len(live)), np.zeros(len(live), dtype=int)
        for i in range(size):
            d, at, before = ways[live, i], x[live], fx[live]
            along = lambda t, k, at=at, d=d: f(at[k] + t[:, None] * d[k], live[k])
            t, ft = minima(along, *brackets(along, np.zeros(len(live)), np.ones(len(live))), tolerance=line, relative=line)
            better = ft < before
            x[live], fx[live] = np.where(better[:, None], at + t[:, None] * d, at), np.where(better, ft, before)
            fell = before - fx[live]
            which, drop = np.where(fell > drop, i, which), np.maximum(drop, fell)
        going = 2 * (f0 - fx[live]) > accuracy * (np.abs(f0) + np.abs(fx[live])) + 1e-300
        live, start, f0, drop, which = live[going], start[going], f0[going], drop[going], which[going]
        if not len(live):
            break
        new = x[live] - start
        beyond = f(x[live] + new, live)
        curved = 2 * (f0 - 2 * fx[live] + beyond) * (f0 - fx[live] - drop) ** 2 < drop * (f0 - beyond) ** 2
        use = np.flatnonzero((beyond < f0) & curved)  # else the new direction would come to depend on the others
        if len(use):
            rows_, d, at = live[use], new[use], x[live[use]]
            along = lambda t, k, at=at, d=d, rows_=rows_: f(at[k] + t[:, None] * d[k], rows_[k])
            t, ft = minima(along, *brackets(along, np.zeros(len(use)), np.ones(len(use))), tolerance=line, relative=line)
            better = ft < fx[rows_]
            x[rows_], fx[rows_] = np.where(better[:, None], at + t[:, None] * d, at), np.where(better, ft, fx[rows_])
            ways[rows_, which[use]] = ways[rows_, -1]
            ways[rows_, -1] = d
    return x, fx


def _solved_on(a: np.ndarray, b: np.ndarray, passive: np.ndarray) -> np.ndarray:
    """Least squares of each row of ``b`` in the columns its row of ``passive`` marks, 0 elsewhere; equal sets at once."""
    z = np.zeros(passive.shape)
    sets, which = np.unique(passive, axis=0, return_inverse=True)
    for k, columns in enumerate(sets):
        if columns.any():
            rows = np.flatnonzero(which.ravel() == k)
            z[np.ix_(rows, columns)] = np.linalg.lstsq(a[:, columns], b[rows].T, rcond=None)[0].T
    return z


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| with x >= 0 for each row of ``b``, by active sets, all rows together.

    A row with a value that isn't finite gives NaN.
    """
    n = a.shape[1]
    out = np.full((len(b), n), np.nan)
    sound = np.flatnonzero(np.isfinite(b).all(axis=1))
    b = b[sound]
    x, passive = np.zeros((len(b), n)), np.zeros((len(b), n), dtype=bool)
    tol = 10 * MACHINE_EPSILON * np.abs(a).sum(axis=0).max() * max(a.shape)
    live = np.arange(len(b))
    for _ in range(10 * n):
        w = np.where(passive[live], -np.inf, (b[live] - x[live] @ a.T) @ a)
        gain = w.max(axis=1, initial=-np.inf)
        live, w = live[gain > tol], w[gain > tol]
        if not len(live):
            break
        passive[live, w.argmax(axis=1)] = True
        todo = live
        while len(todo):
            z = _solved_on(a, b[todo], passive[todo])
            low = passive[todo] & (z <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(low, x[todo] / (x[todo] - z), np.inf).min(axis=1)
            bad = low.any(axis=1)
            x[todo[~bad]] = z[~bad]
            todo, z, step = todo[bad], z[bad], step[bad, None]
            # A variable that leaves the set is the one that stops the step, whatever rounding leaves of it.
            moved = x[todo] + step * (z - x[todo])
            passive[todo] &= (moved > tol) & ~(low[bad] & (x[todo] <= step * (x[todo] - z)))
            x[todo] = np.where(passive[todo], moved, 0.0)
    out[sound] = x
    return out


def unmix(spectra: np.ndarray, endmembers: np.ndarray, weight: float = 1e3) -> np.ndarray:
    """Abundances (pixels, endmembers), not negative and with sum one, of spectra (pixels, bands) in the columns of
    ``endmembers`` (bands, endmembers); the sum is one more, heavily weighted equation."""
    scale = weight * max(1.0, float(np.abs(endmembers).max()))
    a = np.vstack((endmembers, np.full((1, endmembers.shape[1]), scale)))
    return nonnegative_least_squares(a, np.hstack((spectra, np.full((len(spectra), 1), scale))))
