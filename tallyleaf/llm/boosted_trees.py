"""Gradient-boosted trees for a yes/no target: fitted on a bounded sample, flattened to arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points to itself, so every row walks ``depth`` steps."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
        ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic boosting over binned features.

    ``signs`` holds +1 or -1 for a feature along which the score may only rise or only fall, else 0. A split that
    breaks its sign is refused, and both sides of a signed split are bounded by the middle of their values, so the sign
    holds for whole trees. With one class (or no rows) the forest has no trees and scores its share.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    nodes: list[list] = []
    roots: list[int] = []
    if len(np.unique(y)) > 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
        total = np.full(len(y), np.log(share / (1 - share)))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = gradient[rows], weight[rows]
            at = len(nodes)
            nodes.append([0, np.inf, at, at, rate * float(np.clip(-g.sum() / (h.sum() + ridge), low, high))])
            best = (1e-6, None)
            for f, c in enumerate(cuts if level < depth else []):
                gl, hl = np.cumsum(np.bincount(binned[f][rows], g, len(c) + 1))[:-1], np.cumsum(np.bincount(binned[f][rows], h, len(c) + 1))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * wl + (hl + ridge) * wl**2 / 2) - (gr * wr + (hr + ridge) * wr**2 / 2)
                w = np.clip(-g.sum() / (h.sum() + ridge), low, high)
                gain += g.sum() * w + (h.sum() + ridge) * w**2 / 2
                gain[(hl < least) | (hr < least) | (signs[f] * (wr - wl) < 0)] = -np.inf
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, (wl[k] + wr[k]) / 2))
            if best[1]:
                f, k, middle = best[1]
                goes = binned[f][rows] <= k
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(signs[f])]
                left = grow(rows[goes], level + 1, *bounds[0])
                right = grow(rows[~goes], level + 1, *bounds[1])
                nodes[at][:4] = [f, float(cuts[f][k]), left, right]
            return at

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            gradient, weight = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
            tree = _arrays(nodes, roots[-1:], 0.0, depth)
            total += np.log(np.clip(s := tree.score(x), 1e-12, None) / np.clip(1 - s, 1e-12, None))
    return _arrays(nodes, roots, float(np.log(share / (1 - share))), depth)


def _arrays(nodes: list[list], roots: list[int], base: float, depth: int) -> Forest:
    f, t, a, b, v = ([n[i] for n in nodes] for i in range(5))
    return Forest(base, depth, np.array(roots, dtype=np.int64), np.array(f, dtype=np.int64), np.array(t, dtype=float),
                  np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(v, dtype=float))
