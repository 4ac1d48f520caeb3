"""Small numeric learners that run on a bounded matrix on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the mean log loss plus l1 and l2 penalties on the weights: accelerated proximal steps."""
    n, d = x.shape
    x = np.ascontiguousarray(x, np.float32)
    w, b = np.zeros(d, np.float32), np.float32(0)
    if not n:
        return w, 0.0
    v = np.random.default_rng(0).normal(size=d + 1).astype(np.float32)
    for _ in range(12):  # the largest curvature
        u = x @ v[:-1] + v[-1]
        v = np.append(x.T @ u, u.sum()).astype(np.float32)
        top = np.linalg.norm(v)
        if not top:
            break
        v /= top
    step = 1 / (1.05 * top / (4 * n) + l2 + 1e-9)
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = sigmoid(x @ zw + zb) - y
        nw = zw - step * (x.T @ r / n + l2 * zw)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = zb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw.astype(np.float32), nb, nt
    return w, float(b)


def grow_tree(bins: np.ndarray, target: np.ndarray, features: np.ndarray, depth: int, least: int, n_bins: int):
    """Paths of a least-squares tree: each node below the root as a tuple of (feature, bin, above) tests."""
    out, values = [], np.full(len(target), target.mean() if len(target) else 0.0)

    def split(rows, path):
        if len(path) == depth or len(rows) < 2 * least:
            return
        y, best = target[rows], None
        total = y.sum()
        for f in features:
            k = bins[rows, f]
            n = np.cumsum(np.bincount(k, minlength=n_bins))[:-1]
            s = np.cumsum(np.bincount(k, weights=y, minlength=n_bins))[:-1]
            m = len(rows) - n
            ok = (n >= least) & (m >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1), -np.inf)
                at = int(np.argmax(gain))
                if best is None or gain[at] > best[0] + 1e-12:
                    best = gain[at], f, at
        if best is None or best[0] <= total**2 / len(rows) + 1e-9:
            return
        _, f, at = best
        for above in (False, True):
            mine = rows[(bins[rows, f] > at) == above]
            values[mine] = target[mine].mean()
            out.append((*path, (int(f), at, above)))
            split(mine, out[-1])

    split(np.arange(len(target)), ())
    return out, values
