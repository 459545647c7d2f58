"""Resampling by counts: what a block of a cell's rows adds to each replicate's sums.

A cell's rows are numbered and cut into blocks. How many of a replicate's draws
fall into each block follows from splits along a binary tree over the blocks:
binomial for draws with replacement, hypergeometric for permutations, each
split's generator seeded by the cell and the tree node. So a task knows its
block's part of all replicates from the blocks' sizes alone, and rows are never
multiplied by replicates outside it. A cell of one block has plain draws by a
32-bit hash of replicate and slot, which SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = np.uint64(0xFFFFFFFF)
#: Draws that are held at once.
HELD = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser (two multiplications, three shifts) of longs below 2^33."""
    x = x & _MASK
    x = x ^ (x >> np.uint64(16))
    x = x * np.uint64(0x7FEB352D) & _MASK
    x = x ^ (x >> np.uint64(15))
    x = x * np.uint64(0x846CA68B) & _MASK
    return x ^ (x >> np.uint64(16))


def hashes(base: int, replicates: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Hash of each (replicate, slot), elementwise."""
    return mix(mix(np.uint64(base) + replicates.astype(np.uint64)) + slots.astype(np.uint64))


def block_base(base: int, block: int, blocks: int) -> int:
    return base if blocks == 1 else int(mix(np.array([base ^ (0x9E3779B1 * (block + 1) & 0xFFFFFFFF)], np.uint64))[0])


def _descend(base: int, block: int, sizes: np.ndarray) -> Iterator[tuple[np.random.Generator, np.ndarray, np.ndarray, bool]]:
    """Splits from the root to a block: generator, sizes on the left and on the right, and whether the block lies left."""
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        yield np.random.default_rng([base, lo, hi]), sizes[lo:mid].sum(0), sizes[mid:hi].sum(0), block < mid
        lo, hi = (lo, mid) if block < mid else (mid, hi)


def drawn_counts(base: int, block: int, sizes: np.ndarray, replicates: int, draws: int) -> np.ndarray:
    """How many of `draws` draws with replacement each replicate has in a block, given all blocks' sizes."""
    left = np.full(replicates, draws)
    for rng, a, b, here in _descend(base, block, sizes):
        first = rng.binomial(left, a / (a + b)) if a + b else np.zeros_like(left)
        left = first if here else left - first
    return left


def permuted_counts(base: int, block: int, sizes: np.ndarray, replicates: int, groups: np.ndarray) -> np.ndarray:
    """(replicates, groups): how many rows of a block each permutation gives to each group; cells of less than 10^9 rows."""
    left = np.tile(groups, (replicates, 1))
    for rng, a, b, here in _descend(base, block, sizes):
        first, need, rest = np.zeros_like(left), np.full(replicates, int(a)), left.sum(1)
        for g in range(left.shape[1]):
            rest = rest - left[:, g]
            first[:, g] = rng.hypergeometric(left[:, g], rest, need)
            need = need - first[:, g]
        left = first if here else left - first
    return left


def picks(base: int, counts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(replicate, slot, row) of all draws in a block of `size` rows, some replicates at a time."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD)))
        some = counts[lo:hi]
        b = np.repeat(np.arange(lo, hi), some)
        slot = np.arange(len(b)) - np.repeat(np.cumsum(some) - some, some)
        yield b, slot, (hashes(base, b, slot) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        lo = hi


def resampled_sums(base: int, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the drawn values of each replicate."""
    out = np.zeros(len(counts))
    for b, _, row in picks(base, counts, len(values)):
        out += np.bincount(b, weights=values[row], minlength=len(counts))
    return out


def resampled_weights(base: int, counts: np.ndarray, times: np.ndarray, first: int) -> np.ndarray:
    """How often each of a block's distinct values (there `times` each) is drawn in the replicates from number `first` on."""
    d = len(times)
    if d == 1:  # a value by itself gets all its block's draws
        return counts[:, None]
    ends = np.cumsum(times)
    b = np.repeat(np.arange(len(counts)), counts)
    slot = np.arange(len(b)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = (hashes(base, b + first, slot) * np.uint64(ends[-1]) >> np.uint64(32)).astype(np.int64)
    return np.bincount(b * d + np.searchsorted(ends, row, side="right"), minlength=len(counts) * d).reshape(-1, d)


def resampled_wins(base: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per replicate, of a block of ascending distinct values: pairs won by group a inside it (ties half), and both groups' draws.

    a, b: draws of each replicate in the block; na, nb: times of each value.
    """
    wins, other = np.zeros(len(a)), int(mix(np.array([base + 1], np.uint64))[0])
    step = max(1, HELD // max(len(na), int(a.max(initial=1)), int(b.max(initial=1))))
    for lo in range(0, len(a), step):
        x = resampled_weights(base, a[lo : lo + step], na, lo) if na.any() else np.zeros((len(a[lo : lo + step]), len(na)))
        y = resampled_weights(other, b[lo : lo + step], nb, lo) if nb.any() else np.zeros((len(b[lo : lo + step]), len(nb)))
        wins[lo : lo + step] = (x * (np.cumsum(y, 1) - y / 2)).sum(1)
    return wins, a, b


def permuted_sums(base: int, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(replicates, groups): sums of the values that each permutation gives to each group.

    Rows in the order of their hashes are dealt to the groups in turn.
    """
    replicates, s = len(counts), len(values)
    out = np.zeros(counts.shape)
    step = max(1, HELD // max(s, 1))
    for lo in range(0, replicates, step):
        b = np.arange(lo, min(lo + step, replicates))
        h = hashes(base, np.repeat(b, s), np.tile(np.arange(s), len(b))).reshape(len(b), s)
        total = np.c_[np.zeros(len(b)), np.cumsum(values[np.argsort(h, 1, kind="stable")], 1)]
        ends = np.cumsum(counts[b], 1)
        upto = np.take_along_axis(total, ends, 1)
        out[b] = np.diff(upto, axis=1, prepend=0)
    return out
