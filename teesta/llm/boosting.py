"""Gradient boosted trees for a binary outcome, fitted and applied with numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, Newton leaf values, depth-wise trees on exact thresholds, and a Platt calibration on held-out rows."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.trees: list[dict] = []
        self.base, self.scale, self.shift = 0.0, 1.0, 0.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> dict:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = {"value": -total_g / (total_h + self.ridge)}
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best, gain0 = (1e-6, -1, 0.0), total_g**2 / (total_h + self.ridge)
        for f in range(x.shape[1]):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            s = v[order]
            cg, ch = np.cumsum(g[rows][order]), np.cumsum(h[rows][order])
            cut = np.flatnonzero(s[1:] > s[:-1])
            cut = cut[(cut + 1 >= self.least) & (len(rows) - cut - 1 >= self.least)]
            if not len(cut):
                continue
            gain = cg[cut] ** 2 / (ch[cut] + self.ridge) + (total_g - cg[cut]) ** 2 / (total_h - ch[cut] + self.ridge) - gain0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float((s[cut[i]] + s[cut[i] + 1]) / 2))
        if best[1] < 0:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return {"f": best[1], "t": best[2], "l": self._grow(x, g, h, rows[left], depth - 1), "r": self._grow(x, g, h, rows[~left], depth - 1)}

    def _apply(self, tree: dict, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if "value" in tree:
            out[rows] += self.rate * tree["value"]
            return
        left = x[rows, tree["f"]] <= tree["t"]
        self._apply(tree["l"], x, rows[left], out)
        self._apply(tree["r"], x, rows[~left], out)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in self.trees:
            self._apply(t, x, rows, out)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, leave: np.ndarray) -> BoostedTrees:
        """Trees on the rows that are neither for calibration nor left for others; the calibration on its rows alone."""
        held = calibrate
        a, b = x[~calibrate & ~leave], y[~calibrate & ~leave]
        rate = np.clip(b.mean(), 0.01, 0.99)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(a), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(a, p - b, np.maximum(p * (1 - p), 1e-6), np.arange(len(a)), self.depth)
            self.trees.append(tree)
            self._apply(tree, a, np.arange(len(a)), score)
        z, t = self.raw(x[held]), np.clip(y[held], 0.01, 0.99)
        w = np.array([1.0, 0.0])
        for _ in range(30):  # Newton steps of a two-parameter logistic fit
            p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
            r = np.maximum(p * (1 - p), 1e-9)
            grad = np.array([((p - t) * z).sum() + 1e-3 * (w[0] - 1), (p - t).sum()])
            hess = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
            w = w - np.linalg.solve(hess, grad)
        self.scale, self.shift = float(w[0]), float(w[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))

    def threshold(self, x: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
        """The cutoff with the best F-measure on the given rows, midway to the next lower score."""
        p = self.probability(x)
        order = np.argsort(-p, kind="stable")
        hit = np.cumsum(y[order])
        f = (1 + beta**2) * hit / (np.arange(1, len(p) + 1) + beta**2 * y.sum())
        last = np.append(p[order][1:] < p[order][:-1] - 1e-12, True)
        f[~last] = -1
        i = int(f.argmax())
        lower = p[order][i + 1] if i + 1 < len(p) else 0.0
        return float((p[order][i] + lower) / 2)
