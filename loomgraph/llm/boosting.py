"""Gradient-boosted trees with monotonic constraints, in numpy, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: a node is a leaf where feature is -1; children are absolute node numbers."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x, all rows and trees at once, level by level."""
        out = np.full(len(x), self.base)
        for k in range(0, len(x), 1 << 14):
            part = x[k : k + (1 << 14)]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                f = self.feature[node]
                below = part[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(below, self.left[node], self.right[node]))
            out[k : k + len(part)] += self.value[node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: tuple[int, ...] = (),
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    least: int = 10,
) -> Trees:
    """Logistic-loss boosting on quantile bins.

    monotone has +1, -1 or 0 for each feature. A split on a constrained feature must order its
    leaf values the right way, and its middle value bounds all that lies below either side, so the
    fitted function is monotonic in that feature everywhere. Ties between splits go to the lower
    feature, then the lower bin. Without rows, or with one class only, the trees are single leaves.
    """
    n, width = x.shape
    monotone = tuple(monotone) or (0,) * width
    rate_of = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) if n else np.zeros((0, width), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    margin = np.full(n, base)
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        root = leaf()
        roots.append(root)
        todo = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            own = float(np.clip(total_g / (total_h + l2), low, high))
            value[node] = rate * own
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    size = len(edges[f]) + 1
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                    gain = vl * gl - 0.5 * vl**2 * (hl + l2) + vr * gr - 0.5 * vr**2 * (hr + l2) - (own * total_g - 0.5 * own**2 * (total_h + l2))
                    bad = (nl < least) | (len(rows) - nl < least)
                    if monotone[f]:
                        bad |= (vr - vl) * monotone[f] < 0
                    gain[bad] = -np.inf
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            _, f, k, vl, vr = best
            if f < 0:
                margin[rows] += value[node]
                continue
            feature[node], threshold[node] = f, float(edges[f][k])
            left[node], right[node] = leaf(), leaf()
            side = binned[rows, f] <= k
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
            todo.append((left[node], rows[side], level + 1, *bounds[0]))
            todo.append((right[node], rows[~side], level + 1, *bounds[1]))
    if not roots:
        roots.append(leaf())
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), base, depth)
