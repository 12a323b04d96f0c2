"""Gradient-boosted regression trees on binned features, with monotonic constraints, flattened into numpy node arrays."""

from __future__ import annotations

import numpy as np


class Forest:
    """All trees in five arrays; a leaf points to itself, so scoring is ``depth`` gathers a tree."""

    def __init__(self, roots, feature, threshold, left, right, value, depth: int, base: float) -> None:
        self.roots, self.depth, self.base = np.asarray(roots, np.int32), depth, base
        self.feature, self.threshold = np.asarray(feature, np.int32), np.asarray(threshold, np.float64)
        self.left, self.right, self.value = np.asarray(left, np.int32), np.asarray(right, np.int32), np.asarray(value, np.float64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Forest:
    """Logistic boosting. ``monotone``: feature -> 1 (the score may only rise with it) or -1 (only fall)."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(m)]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    width = bins + 1
    flat = codes + np.arange(m) * width
    rise = np.array([monotone.get(f, 0) for f in range(m)])[:, None]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-9)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            k, rows, level, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[k] = float(np.clip(g / (h + ridge), low, high))
            best = None
            if level < depth and len(rows) >= 2 * least:
                at = flat[rows].ravel()
                shape = (m, width)
                gl = np.bincount(at, np.repeat(grad[rows], m), m * width).reshape(shape).cumsum(1)[:, :-1]
                hl = np.bincount(at, np.repeat(hess[rows], m), m * width).reshape(shape).cumsum(1)[:, :-1]
                nl = np.bincount(at, minlength=m * width).reshape(shape).cumsum(1)[:, :-1]
                lv, rv = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                gain = 2 * (gl * lv + (g - gl) * rv) - (hl + ridge) * lv**2 - (h - hl + ridge) * rv**2
                gain -= 2 * g * value[k] - (h + ridge) * value[k] ** 2
                gain[(nl < least) | (len(rows) - nl < least) | (rise * (rv - lv) < 0)] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    best = (int(f), int(b), float(lv[f, b]), float(rv[f, b]))
            if best is None:
                value[k] *= rate
                margin[rows] += value[k]
                continue
            f, b, lv, rv = best
            feature[k], threshold[k], value[k] = f, float(cuts[f][b]), 0.0
            left[k], right[k] = node(), node()
            mid, goes = (lv + rv) / 2, codes[rows, f] <= b
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone.get(f, 0)]
            todo += [(left[k], rows[goes], level + 1, *bounds[0]), (right[k], rows[~goes], level + 1, *bounds[1])]
    return Forest(roots, feature, threshold, left, right, value, depth, base)
