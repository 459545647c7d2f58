"""Words one edit apart by a trie of letter-group counts.

A word's letters fall into GROUPS groups, and its counts by group, one after
another, are its path in the trie. One inserted letter raises one count by one
(a surplus), one deleted letter lowers one (a deficit), a replaced one does
both or neither. So a depth-first search that may spend one surplus and one
deficit on its way meets every word one edit away at a leaf; words of the
leaves met are verified.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

GROUPS = 16
#: Letters of Latin scripts by falling frequency; a letter's place, modulo GROUPS, is its group.
FREQUENCY = "eainrtosldcumpghvbfqyzjxkw"
#: Counts are clipped here: that keeps differences of at most one, and node keys small.
MOST = 250
#: Node pairs and word pairs that are held at once, and the longest word of the comparison by matrices.
CHUNK, WIDTH = 1 << 16, 48
PAD = 0xFFFFFFFF


def _groups() -> np.ndarray:
    """Group of each code point below 256; letters with marks are half a turn away from their bare letter."""
    out = np.arange(256) % GROUPS
    for c in range(256):
        bare = unicodedata.normalize("NFD", chr(c))[0].lower()
        if bare in FREQUENCY:
            out[c] = (FREQUENCY.index(bare) + (0 if c < 128 else GROUPS // 2)) % GROUPS
    return out


TABLE = _groups()


def flat_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and their lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), np.array([len(w) for w in words], np.int64)


def count_vectors(words: list[str]) -> np.ndarray:
    """Letters by group of each word, clipped at MOST."""
    codes, lengths = flat_codes(words)
    group = np.where(codes < 256, TABLE[np.minimum(codes, 255)], codes % GROUPS)
    at = np.repeat(np.arange(len(words)), lengths) * GROUPS + group
    return np.minimum(np.bincount(at, minlength=len(words) * GROUPS), MOST).reshape(-1, GROUPS)


class Trie:
    """Sorted count vectors: the nodes of a level are the distinct prefixes of its length, in order."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        rows = vectors[self.order]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        node = np.zeros(len(rows), np.int64)
        #: By level: node keys (parent * 256 + count), counts, and where a node's children begin.
        self.keys, self.counts, self.first = [], [], []
        for level in range(rows.shape[1]):
            parent = node
            new = new | np.r_[True, rows[1:, level] != rows[:-1, level]][: len(rows)]
            node = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            self.first.append(np.searchsorted(parent[heads], np.arange(parent[-1] + 2)))
            self.counts.append(rows[heads, level].astype(np.int64))
            self.keys.append(parent[heads] * 256 + self.counts[-1])
        #: Rows of each leaf: order[begin[leaf] : begin[leaf + 1]].
        self.begin = np.r_[np.flatnonzero(new), len(rows)]


def ragged(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (first, size): the range that each place belongs to, and the places."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def leaf_pairs(a: Trie, b: Trie) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of a and of b whose counts differ by at most one surplus and one deficit.

    Both tries are descended together, deepest pairs first; pairs of one level
    that come from one step are a chunk on the stack.
    """
    one, yes = np.zeros(1, np.int64), np.ones(1, bool)
    stack = [(0, one, one, yes, yes)]
    while stack:
        level, x, y, surplus, deficit = stack.pop()
        if len(x) > CHUNK:
            stack.append((level, x[CHUNK:], y[CHUNK:], surplus[CHUNK:], deficit[CHUNK:]))
            x, y, surplus, deficit = x[:CHUNK], y[:CHUNK], surplus[:CHUNK], deficit[:CHUNK]
        first = a.first[level]
        owner, child = ragged(first[x], first[x + 1] - first[x])
        count, keys, found = a.counts[level][child], b.keys[level], []
        for step in (-1, 0, 1):
            may = np.ones(len(owner), bool) if step == 0 else (surplus if step > 0 else deficit)[owner]
            want = y[owner] * 256 + count + step
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.flatnonzero(may & (keys[at] == want) & (count + step >= 0))
            found.append((child[hit], at[hit], surplus[owner[hit]] & (step <= 0), deficit[owner[hit]] & (step >= 0)))
        x, y, surplus, deficit = (np.concatenate(c) for c in zip(*found))
        if not len(x):
            continue
        if level + 1 < len(a.first):
            stack.append((level + 1, x, y, surplus, deficit))
        else:
            yield x, y


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    p = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[p + (len(a) == len(b)) :] == long[p + 1 :]


class Words:
    """Words of one task with what their comparison needs."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, self.lengths = flat_codes(words)
        start = np.cumsum(self.lengths) - self.lengths
        self.width = int(min(self.lengths.max(initial=1), WIDTH))
        place = np.arange(self.width)[None]
        inside = place < self.lengths[:, None]
        codes = np.r_[codes, np.uint32(PAD)]
        last = len(codes) - 1
        self.left = codes[np.where(inside, start[:, None] + place, last)]
        self.right = codes[np.where(inside, (start + self.lengths)[:, None] - 1 - place, last)]
        self.long = self.lengths > self.width
        # Hashes of the first and of the last half, by the word's own length and by a length one shorter.
        self.heads, self.tails = ([self._hash(m, (self.lengths - k) // 2) for k in (0, 1)] for m in (self.left, self.right))

    def _hash(self, codes: np.ndarray, upto: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            out = np.where(k < upto, out * np.uint64(0x9E3779B97F4A7C15) + codes[:, k] + np.uint64(1), out)
        return out

    def halves(self, i: np.ndarray, j: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with the same first or the same last half, which an edit in the other half leaves alone; i has `longer` letters more."""
        a, b = int(longer > 0), int(longer < 0)
        same = (self.heads[a][i] == self.heads[b][j]) | (self.tails[a][i] == self.tails[b][j])
        if self.long.any():
            same |= self.long[i] | self.long[j]
        return i[same], j[same]

    def verified(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are one edit apart."""
        keep = (np.abs(self.lengths[i] - self.lengths[j]) <= 1) & (i != j)
        i, j = i[keep], j[keep]
        short = np.minimum(self.lengths[i], self.lengths[j])
        apart = lambda m: np.where((e := m[i] == m[j]).all(1), self.width, e.argmin(1))
        near = apart(self.left) + apart(self.right) >= np.where(self.lengths[i] == self.lengths[j], short - 1, short)
        for k in np.flatnonzero(self.long[i] | self.long[j]):
            near[k] = one_edit(self.words[i[k]], self.words[j[k]])
        return i[near], j[near]


def near_pairs(words: list[str], stored: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, stored word) of distinct words that are one edit apart, in blocks of a bounded size."""
    if not len(stored) or not len(queries):
        return
    vectors, compared = count_vectors(words), Words(words)
    a, b = Trie(vectors[queries]), Trie(vectors[stored])
    mine, theirs = queries[a.order], stored[b.order]
    for x, y in leaf_pairs(a, b):
        # Words of a leaf have one length, but for clipped counts, whose words are long ones.
        gap = np.clip(compared.lengths[mine[a.begin[x]]] - compared.lengths[theirs[b.begin[y]]], -1, 1)
        for longer in (-1, 0, 1):
            u, v = x[gap == longer], y[gap == longer]
            # Each word of leaf u, in turn, meets all words of leaf v.
            owner, row = ragged(a.begin[u], a.begin[u + 1] - a.begin[u])
            size = (b.begin[v + 1] - b.begin[v])[owner]
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 4 * CHUNK, 4 * CHUNK))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo < hi:
                    who, other = ragged(b.begin[v[owner[lo:hi]]], size[lo:hi])
                    yield compared.verified(*compared.halves(mine[row[lo:hi][who]], theirs[other], longer))
