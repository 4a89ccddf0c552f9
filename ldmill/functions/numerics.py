"""Small numerical helpers for the pandas functions: F tail, correlations, variance components."""

from __future__ import annotations

from math import lgamma

import numpy as np


def beta_tail(a: float, b: float, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), by Lentz's continued fraction on the side where it converges fast."""
    x = np.asarray(x, dtype=float)
    out = np.full(x.shape, np.nan)
    for flip in (False, True):
        at = (x >= 0) & (x <= 1) & ((x > (a + 1) / (a + b + 2)) == flip)
        p, q, z = (b, a, 1 - x[at]) if flip else (a, b, x[at])
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
            tiny = 1e-300
            c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            h = d.copy()
            for m in range(1, rounds):
                for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                    d = 1 + num * d
                    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                    c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
                    step = c * d
                    h = h * step
                if h.size == 0 or np.all(np.abs(step - 1) < 1e-15):
                    break
            v = np.where(z <= 0, 0.0, front * h)
        out[at] = 1 - v if flip else v
    return out


def f_tail(f: np.ndarray, df1: float, df2: float) -> np.ndarray:
    """P(F > f); nan where f is."""
    f = np.asarray(f, dtype=float)
    return beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.maximum(f, 0)))


def cross_r2(x: np.ndarray, m: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Squared correlation of every row of x with every row of y over the columns both have (m, k: 1 where present); 0 where undefined."""
    v = x - x.sum(axis=1, keepdims=True) / np.maximum(m.sum(axis=1, keepdims=True), 1) * m
    u = y - y.sum(axis=1, keepdims=True) / np.maximum(k.sum(axis=1, keepdims=True), 1) * k
    n, sx, sy, sxx, syy, sxy = m @ k.T, v @ k.T, m @ u.T, (v * v) @ k.T, m @ (u * u).T, v @ u.T
    top, bottom = n * sxy - sx * sy, (n * sxx - sx * sx) * (n * syy - sy * sy)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.minimum(1.0, np.where(bottom > 1e-18, top * top / bottom, 0.0))


def reml(y: np.ndarray, vectors: np.ndarray, values: np.ndarray, grid: int = 100) -> tuple[float, float]:
    """Genetic and residual variance of y with an intercept: the root of the restricted likelihood's derivative in log delta on a grid over -10..10,
    refined by bisection. ``vectors``, ``values``: eigen pairs of the centred kinship without the constant direction."""
    eta2 = (vectors.T @ y) ** 2
    n = len(eta2)

    def likelihood(t: np.ndarray) -> np.ndarray:
        lam = values[:, None] + np.exp(t)[None, :]
        return 0.5 * (n * (np.log(n / (2 * np.pi)) - 1 - np.log((eta2[:, None] / lam).sum(axis=0))) - np.log(lam).sum(axis=0))

    def slope(t: np.ndarray) -> np.ndarray:
        lam = values[:, None] + np.exp(t)[None, :]
        return 0.5 * np.exp(t) * (n * (eta2[:, None] / lam**2).sum(axis=0) / (eta2[:, None] / lam).sum(axis=0) - (1 / lam).sum(axis=0))

    t = np.linspace(-10, 10, grid + 1)
    s = slope(t)
    candidates = [t[0], t[-1]]
    for i in np.flatnonzero((s[:-1] > 0) & (s[1:] <= 0)):
        lo, hi = t[i], t[i + 1]
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if slope(np.array([mid]))[0] > 0 else (lo, mid)
        candidates.append((lo + hi) / 2)
    at = np.array(candidates)
    delta = float(np.exp(at[np.argmax(likelihood(at))]))
    vg = float((eta2 / (values + delta)).sum() / n)
    return vg, vg * delta


def normalized_kinship(k: np.ndarray) -> np.ndarray:
    """Scaled so that the centred trace is n - 1."""
    n = len(k)
    return (n - 1) / (np.trace(k) - k.sum() / n) * k


def centred_eigen(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigen pairs of S (K + I) S - S for the centring S, without the constant direction."""
    n = len(k)
    s = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(s @ (k + np.eye(n)) @ s)
    return vectors[:, 1:], values[1:] - 1
