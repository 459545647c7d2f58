"""Counts and quantiles over all pairs of two lists, without forming the pairs."""

from __future__ import annotations

import struct

import numpy as np


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of w_i w_j over i < j with value_i > value_j, in n log n.

    Ranks are split by one bit after the other, the highest first: in each run
    of equal higher bits, ones that stand before zeros are inversions.
    """
    if len(values) < 2:
        return 0
    ranks = np.unique(values, return_inverse=True)[1]
    order, total = np.arange(len(ranks)), 0
    for bit in reversed(range(int(ranks.max()).bit_length())):
        r, w = ranks[order], weights[order]
        one = (r >> bit) & 1
        ahead = np.cumsum(w * one)
        new = np.r_[True, (r[1:] >> bit + 1) != (r[:-1] >> bit + 1)]
        before = np.r_[0, ahead][np.flatnonzero(new)][np.cumsum(new) - 1]
        total += int(((ahead - before) * w)[one == 0].sum())
        order = order[np.argsort(r >> bit, kind="stable")]
    return total


def grid_inversions(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> int:
    """The same over cells (x, y) of a grid: pairs with a smaller x and a larger y."""
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    grid = np.zeros((x.max(initial=0) + 2, y.max(initial=0) + 2), np.int64)
    np.add.at(grid, (x + 1, y), weights)
    # Weight at a smaller x (rows are shifted by one) and a larger y.
    smaller = np.cumsum(grid, 0)[:-1]
    above = np.cumsum(smaller[:, ::-1], 1)[:, ::-1]
    return int((weights * above[x, y + 1]).sum())


def _key(v: float) -> int:
    """Integers in the order of doubles."""
    (k,) = struct.unpack("<q", struct.pack("<d", v))
    return k if k >= 0 else -(k & ((1 << 63) - 1))


def _double(k: int) -> float:
    return struct.unpack("<d", struct.pack("<q", k if k >= 0 else -k | -(1 << 63)))[0]


def differences_up_to(t: float, x: np.ndarray, nx: np.ndarray, y: np.ndarray, at_least: np.ndarray) -> int:
    """How many differences x - y are at most t; y ascends, at_least[i] counts its values from place i on."""
    at = np.searchsorted(y, x - t)
    # Differences are rounded, so the place may be off by rounding.
    while (low := (at > 0) & (x - y[np.maximum(at, 1) - 1] <= t)).any():
        at = at - low
    while (high := (at < len(y)) & (x - y[np.minimum(at, len(y) - 1)] > t)).any():
        at = at + high
    return int((nx * at_least[at]).sum())


def median_difference(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> float | None:
    """Median of all differences x - y of distinct values with counts: the middle one, or the mean of the two middle ones.

    Bisection on doubles finds the k-th difference exactly; each step counts
    in n log n.
    """
    order = np.argsort(y)
    y, ny = y[order], ny[order]
    at_least = np.r_[np.cumsum(ny[::-1])[::-1], 0]
    total = int(nx.sum()) * int(ny.sum())
    if not total:
        return None

    def nth(k: int) -> float:
        lo, hi = _key(float(x.min() - y[-1])), _key(float(x.max() - y[0]))
        while lo < hi:
            mid = (lo + hi) // 2
            if differences_up_to(_double(mid), x, nx, y, at_least) >= k:
                hi = mid
            else:
                lo = mid + 1
        return _double(lo)

    low = nth((total + 1) // 2)
    return low if total % 2 else (low + nth(total // 2 + 1)) / 2
