"""Gradient-boosted trees for two classes: histogram splits, trees of one depth, Newton leaves."""

from __future__ import annotations

import numpy as np


class Trees:
    """feature and threshold of each inner node (rows are trees, nodes by level), and each leaf's value."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def dump(self) -> dict:
        """What load() takes, in JSON's types; numbers are kept exactly."""
        lists = {k: [a.tolist() for a in getattr(self, k)] for k in ("feature", "leaf")}
        cuts = [[None if np.isinf(t) else float(t) for t in a] for a in self.threshold]
        return {"depth": self.depth, "base": self.base, "threshold": cuts, **lists}

    @classmethod
    def load(cls, held: dict) -> Trees:
        out = cls(held["depth"], held["base"])
        out.feature = [np.array(a, np.int64) for a in held["feature"]]
        out.threshold = [np.array([np.inf if t is None else t for t in a], np.float32) for a in held["threshold"]]
        out.leaf = [np.array(a) for a in held["leaf"]]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = at + (1 << level) - 1
                at = 2 * at + (x[rows, feature[node]] > threshold[node])
            out += leaf[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 50, depth: int = 5, rate: float = 0.25, bins: int = 32, l2: float = 2.0, share: float = 0.6, seed: int = 7) -> Trees:
    """share: of the features that each tree may split on."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], axis=1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    trees = Trees(depth, float(np.log(mean / (1 - mean))))
    score = np.full(n, trees.base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf, np.float32)
        some = np.sort(rng.choice(m, max(1, int(share * m)), replace=False))
        for level in range(depth):
            k = 1 << level
            best = np.full(k, 1e-6)
            split = np.zeros((2, k), np.int64)
            split[1] = bins
            for f in some:
                key = at * bins + binned[:, f]
                gs = np.cumsum(np.bincount(key, g, k * bins).reshape(k, bins), axis=1)
                hs = np.cumsum(np.bincount(key, h, k * bins).reshape(k, bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[:, -1] = 0
                b = gain.argmax(axis=1)
                top = gain[np.arange(k), b]
                mine = top > best
                best[mine] = top[mine]
                split[0, mine], split[1, mine] = f, b[mine]
            base = k - 1
            feature[base : base + k] = split[0]
            for i in range(k):
                e = edges[split[0, i]]
                threshold[base + i] = e[split[1, i]] if split[1, i] < len(e) else np.inf
            at = 2 * at + (binned[np.arange(n), split[0, at]] > split[1, at])
        leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + l2)
        score += leaf[at]
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.leaf.append(leaf)
    return trees
