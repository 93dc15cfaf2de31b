"""BagMinHash signatures of multisets, for many rows at once.

A weight w is discretised to the levels 0, 1, 2, ... Each element has an independent Poisson process of
points (x, level) over x > 0 with rate 1 per level. The smallest x whose level lies below w, among the points
that hash to a register, is the register's value; two multisets agree in a register with the probability of
their weighted Jaccard similarity.

The levels are the ranges [0, 1), [1, 2), [2, 4), [4, 8), ... Each is the root of a binary tree: a range's
first point falls into one half, the other half's first point lies an exponential step further on, and so
down to single levels, which go on by exponential steps. Ranges beyond the weight are dropped, ranges whose
first point lies beyond the row's largest register are left alone. So a weight costs its logarithm, and a
row about as many points as it has elements, plus m log m.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _exponential(seed: np.ndarray) -> np.ndarray:
    """Exp(1) from 53 bits of a hash."""
    return -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """(rows, m) float64; a row without elements has infinities. Weights are whole numbers of 1 or more."""
    out = np.full((rows, m), np.inf)
    flat = out.reshape(-1)
    if not len(row):
        return out
    # roots: range k is [2**(k-1), 2**k), range 0 is [0, 1)
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(row)), depth)
    k = np.arange(len(at)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    size = np.where(k == 0, 1, low)
    h, r, w = element[at], row[at], weight[at]
    seed = mix(h ^ mix(low.astype(np.uint64) * _STEP + size.astype(np.uint64)))
    x = _exponential(seed) / size
    most = np.full(rows, np.inf)
    while len(x):
        single = size == 1
        if single.any():
            g = mix(seed[single] + _STEP)
            np.minimum.at(flat, r[single] * m + (g % np.uint64(m)).astype(np.int64), x[single])
            touched = np.unique(r[single])
            most[touched] = out[touched].max(1)
            # a level's process goes on
            seed[single] = mix(g ^ _STEP)
            x[single] += _exponential(seed[single])
        wide = np.flatnonzero(~single)
        if len(wide):
            half = size[wide] // 2
            g = mix(seed[wide] + _STEP)
            right = (g & np.uint64(1)).astype(bool)  # where the first point falls; halves have equal rates
            hit, miss = low[wide] + np.where(right, half, 0), low[wide] + np.where(right, 0, half)
            low[wide], size[wide], seed[wide] = hit, half, mix(g ^ hit.astype(np.uint64))
            other = mix(mix(g ^ miss.astype(np.uint64)) + _STEP)
            h_x = x[wide] + _exponential(other) / half
            r, w = np.concatenate([r, r[wide]]), np.concatenate([w, w[wide]])
            low, size = np.concatenate([low, miss]), np.concatenate([size, half])
            seed, x = np.concatenate([seed, other]), np.concatenate([x, h_x])
        on = (low < w) & (x < most[r])
        r, w, low, size, seed, x = r[on], w[on], low[on], size[on], seed[on], x[on]
    return out


def identities(signature: np.ndarray) -> np.ndarray:
    """64-bit hashes of the registers: equal registers, equal hashes."""
    return mix(np.ascontiguousarray(signature).view(np.uint64))
