"""Byte-level BPE by a rank file: encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakelane.llm.chunks import ChunkEncoder, flat, id_lists, interleaved
from wakelane.llm.common import gathered, list_slices, map_arrow, tuned

#: A leaf word of the bitmap covers 2**LEAF_BITS ranks.
LEAF_BITS = 8
_LOW = (1 << LEAF_BITS) - 1
#: Bytes of text gathered for one call: the queue serves all new pre-tokens of a batch together.
BATCH_BYTES = 2 << 20
#: Bytes from which a pre-token is merged by itself.
LONG = 256


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap; find-first-set gives the lowest rank.

    Positions that are outdated stay in their buckets; who takes a bucket
    compares them with what now starts there.
    """

    def __init__(self):
        self.top, self.leaves, self.buckets = 0, {}, {}

    def push(self, rank: int, positions: list[int]) -> None:
        if rank in self.buckets:
            self.buckets[rank] += positions
            return
        self.buckets[rank] = positions
        word = rank >> LEAF_BITS
        leaf = self.leaves.get(word, 0)
        self.leaves[word] = leaf | 1 << (rank & _LOW)
        if not leaf:
            self.top |= 1 << word

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its bucket, which leaves the queue."""
        word = (self.top & -self.top).bit_length() - 1
        leaf = self.leaves[word]
        bit = leaf & -leaf
        self.leaves[word] = leaf = leaf ^ bit
        if not leaf:
            self.top ^= 1 << word
        rank = (word << LEAF_BITS) + bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Merger:
    """Merges many pre-tokens at once; their symbols form one array of linked lists.

    A bucket holds the pairs of one rank in all pre-tokens. Of each pre-token
    the leftmost live pair is merged, the others go back into the bucket, and
    the new neighbours are pushed, so that every pre-token sees the lowest rank
    first and then the leftmost place. A pre-token of n symbols takes part in
    fewer than n rounds, and a round costs its live positions.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 2
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys, self.merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.merged = np.append(self.merged, -1)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair (left * size + right) makes, or -1."""
        at = self.keys.searchsorted(keys)
        return np.where(self.keys[at] == keys, self.merged[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the pre-tokens, one after another."""
        short = np.fromiter((len(p) < LONG for p in pieces), bool, len(pieces))
        if not short.all():
            some, long = ([p for p, x in zip(pieces, short) if x == y] for y in (True, False))
            return interleaved(short, self.merge(some), flat([merge(p, self.ranks) for p in long]))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(lengths.sum())
        ids = np.append(self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], -self.size * self.size)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        # Whole pre-tokens that are tokens need no merges: they keep one symbol.
        whole = np.fromiter(map(self.ranks.get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        single = whole >= 0
        begin = (ends - lengths)[single]
        alive = ~single[owner] if n else np.zeros(0, bool)
        alive[begin] = True
        ids[begin] = whole[single]
        # Index n stands for no neighbour; its id makes no pair.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[lengths > 0] - 1] = n
        before[(ends - lengths)[lengths > 0]] = n
        after[n] = n
        before = np.append(before, n)[: n + 1]
        current = np.full(n + 1, -1, np.int64)
        if n > 1:
            inside = (owner[1:] == owner[:-1]) & ~single[owner[1:]]
            current[: n - 1] = np.where(inside, self.rank(ids[: n - 1] * self.size + ids[1:n]), -1)
        queue, start = RankQueue(), np.flatnonzero(current >= 0)
        order = start[np.argsort(current[start], kind="stable")]
        rank, first = np.unique(current[order], return_index=True)
        for r, some in zip(rank.tolist(), np.split(order, first[1:])):
            queue.push(r, some.tolist())
        while queue.top:
            r, bucket = queue.pop()
            p = np.array(bucket)
            p = p[current[p] == r]
            if len(p) > 1:
                p.sort()
                w = owner[p]
                again = w[1:] == w[:-1]
                if again.any():
                    later = np.flatnonzero(again) + 1
                    queue.push(r, p[later].tolist())
                    p = np.delete(p, later)
            elif not len(p):
                continue
            gone = after[p]
            end = after[gone]
            left = before[p]
            after[p], before[end], ids[p], alive[gone] = end, p, r, False
            current[gone] = -1
            at = np.concatenate([p, left])
            found = self.rank(np.concatenate([r * self.size + ids[end], ids[left] * self.size + r]))
            current[at] = found
            hit = found >= 0
            if hit.any():
                for rank, i in zip(found[hit].tolist(), at[hit].tolist()):
                    queue.push(rank, [i])
        return np.bincount(owner[alive], minlength=len(pieces)), ids[:n][alive].astype(np.uint32)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long pre-token, in O(n log n) of its length.

    The same queue with one position taken at a time, the leftmost of the
    lowest bucket (a heap), so that long runs of one pair cost no rounds.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, rank_of = len(piece), ranks.get
    after = list(range(1, n + 1))  # where the symbol at i ends: the list's next
    before = list(range(-1, n))  # and its previous
    current: list[int] = [-1] * (n + 1)  # rank of the pair that starts at i
    queue = RankQueue()

    def push(rank: int, i: int) -> None:
        current[i] = rank
        if rank in queue.buckets:
            heapq.heappush(queue.buckets[rank], i)
        else:
            queue.push(rank, [i])

    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            push(r, i)
    while queue.top:
        rank, bucket = queue.pop()
        i = heapq.heappop(bucket)
        if bucket:
            queue.push(rank, bucket)
        if current[i] != rank:
            continue  # stale
        gone = after[i]
        end = after[i] = after[gone]
        current[gone] = current[i] = -1
        if end < n:
            before[end] = i
            if (r := rank_of(piece[i : after[end]])) is not None:
                push(r, i)
        if (p := before[i]) >= 0:
            current[p] = -1
            if (r := rank_of(piece[p:end])) is not None:
                push(r, p)
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    import regex

    find, merger = regex.compile(pattern).findall, Merger(load_ranks(path))

    def learn(chunks):
        # One run of letters or one sign, after a space or not, is one match of the pattern.
        single = [(c[1:] if c[0] == " " else c).isalpha() and c.isascii() or len(c) == 1 for c in chunks]
        pieces = [[c] if s else find(c) for c, s in zip(chunks, single)]
        sizes, ids = merger.merge([p.encode() for some in pieces for p in some])
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return np.bincount(owner, weights=sizes, minlength=len(chunks)).astype(np.int64), ids

    return ChunkEncoder(learn)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> pa.Array:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ids_col (array<int>): every match of the pattern in the whole text, merged by rank.

    Null text encodes as empty (no ids). Rows, repeats, nulls elsewhere and
    other columns stay; a column called ids_col is replaced. No shuffle.
    """
    tuned(df.sparkSession)
    base = df.drop(ids_col)
    at = base.columns.index(text_col)

    def run(batches):
        for batch in gathered(batches, BATCH_BYTES):
            offsets, ids = encoder(ranks_path, pattern).encode(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, id_lists(offsets, ids)], names=[*batch.schema.names, ids_col])

    return base.mapInArrow(run, base.withColumn(ids_col, F.lit(None).cast("array<int>")).schema)


def bpe_decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds bytes_col (binary): the tokens' bytes joined; null ids decode to null.

    An id outside the vocabulary is an error. Other columns stay; a column
    called bytes_col is replaced.
    """
    base = df.drop(bytes_col)
    at = base.columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        offsets, values = list_slices(column)
        tokens = vocabulary(ranks_path).take(pa.array(values[offsets[0] : offsets[-1]]))
        edge = np.frombuffer(tokens.buffers()[1], np.int32)[: len(tokens) + 1][offsets - offsets[0]] if len(tokens) else np.zeros(len(offsets), np.int32)
        joined = pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(edge), tokens.buffers()[2]])
        decoded = pc.if_else(column.is_null(), pa.scalar(None, pa.binary()), joined)
        return pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, bytes_col])

    return map_arrow(base, run, base.withColumn(bytes_col, F.lit(None).cast("binary")).schema)
