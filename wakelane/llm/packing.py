"""Best-fit packing of token sequences by large-item matching.

Only how many pieces have each length matters for the plan, and lengths are at
most the capacity. So Spark counts pieces by length, the plan is made from that
histogram (at most `capacity` rows, whatever the corpus), and pieces take their
places by their rank among pieces of equal length, found by partition counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakelane.llm.chunks import id_lists
from wakelane.llm.common import gathered, map_arrow, tuned, written
from wakelane.llm.hf_tokens import encoder

CAPACITY = 2048
PIECE_SCHEMA = "part int, row long, doc_id long, piece int, start long, length int, local_rank long, ids_crc32 long, ids array<int>"
#: Bytes of text encoded together.
BATCH_BYTES = 2 << 20


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Kinds of bins as (how many, their lengths), together holding all counts.

    Lengths above a third of the capacity go at most two to a bin: from the
    longest down, each takes the longest partner that fits. Shorter ones then go,
    from the longest down, each into the smallest gap that holds it; what fits
    nowhere opens bins. Bins of one history are handled together, so the work
    depends on the capacity and not on the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    sizes: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(gap: int, count: int, lengths: tuple[int, ...]) -> None:
        if not count:
            return
        if not gap:
            done.append((count, lengths))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        gaps[gap].append((count, lengths))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at < 0:
            put(capacity - n, left.pop(n), (n,))
            large.pop()
            continue
        m = large[at]
        pairs = left[n] // 2 if m == n else min(left[n], left[m])
        if not pairs:  # one of its own kind is over
            at -= 1
            if at < 0:
                put(capacity - n, left.pop(n), (n,))
                large.pop()
                continue
            m = large[at]
            pairs = min(left[n], left[m])
        put(capacity - n - m, pairs, (n, m))
        for x in (n, m):
            left[x] -= pairs
        for x in {n, m}:
            if not left[x]:
                del left[x], large[bisect_left(large, x)]

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(sizes, n)
            if at == len(sizes):
                each = capacity // n
                full, over = divmod(todo, each)
                put(capacity - each * n, full, (n,) * each)
                if over:
                    put(capacity - over * n, 1, (n,) * over)
                break
            gap = sizes[at]
            count, lengths = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            times = gap // n  # best fit goes on in the bin it has just used while that holds more
            used = min(count, todo // times)
            if used:
                put(gap - times * n, used, lengths + (n,) * times)
                todo -= used * times
                put(gap, count - used, lengths)
            else:
                put(gap - todo * n, 1, lengths + (n,) * todo)
                put(gap, count - 1, lengths)
                todo = 0
    return done + [kind for at in gaps.values() for kind in at]


def places(kinds: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first bin, copies side by side, offset of its runs of places.

    A run gives `count` bins, each with `times` pieces of the length in a row.
    """
    seen: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for count, lengths in kinds:
        offset = i = 0
        while i < len(lengths):
            n = lengths[i]
            times = 1
            while i + times < len(lengths) and lengths[i + times] == n:
                times += 1
            rows.setdefault(n, []).append((seen.get(n, 0), first, times, offset))
            seen[n] = seen.get(n, 0) + count * times
            offset += n * times
            i += times
        first += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}


def crc_of(ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """Unsigned crc32 of each slice of ids as little-endian unsigned 32-bit integers."""
    buffer = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return pa.array([zlib.crc32(buffer[a:b]) for a, b in zip((4 * begin).tolist(), (4 * (begin + length)).tolist())], pa.int64())


def pieces_of(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Encodes whole texts and cuts only those longer than the capacity; (part, row) names a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        seen, row = np.zeros(capacity + 1, np.int64), 0
        for batch in gathered(batches, BATCH_BYTES):
            offsets, ids = encode(batch.column(1), end_id)
            pieces = -(-np.diff(offsets) // capacity)
            doc = np.repeat(np.arange(batch.num_rows), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = offsets[doc] + piece * capacity
            length = np.minimum(begin + capacity, offsets[doc + 1]) - begin
            # Rank among the partition's pieces of equal length, in order.
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = {
                "part": np.full(len(doc), part, np.int32),
                "row": row + np.arange(len(doc)),
                "doc_id": batch.column(0).take(pa.array(doc)),
                "piece": piece.astype(np.int32),
                "start": piece * capacity,
                "length": length.astype(np.int32),
                "local_rank": rank,
                "ids_crc32": crc_of(ids, begin, length),
                "ids": id_lists(np.append(begin, offsets[-1]), ids),
            }
            row += len(doc)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


class Packed(NamedTuple):
    """What pack() gives: the places of all pieces, and the written pieces with their ids."""

    places: DataFrame
    pieces: DataFrame

    def sequences(self) -> DataFrame:
        """sequence_id, ids: the ids of each whole sequence, its pieces by offset. Here alone ids are shuffled."""
        rows = self.places.select("part", "row", "sequence_id", "offset").join(self.pieces.select("part", "row", "ids"), ["part", "row"])
        whole = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        return whole.select("sequence_id", F.flatten("p.ids").alias("ids"))


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> Packed:
    """Places (part, row, doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, and the pieces.

    Null and empty texts are sequences of end_id alone; equal texts and repeated
    ids are pieces like any other; a null id stays null; an empty table packs
    nothing. Columns of other names are not read.

    The pieces are written to the shared folder with their rank among the pieces
    of their length in their own partition. Partition counts by length give each
    partition the ranks before it, so no task sees all pieces of one length.
    Ids stay in the files: only lengths and ranks are read and shuffled.
    """
    spark = tuned(df.sparkSession)
    pieces = written(pieces_of(df, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = ["part", "row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            first, bin0, times, offset = table.value[int(n)]
            k = np.searchsorted(first, rank[rows], "right") - 1
            inside = rank[rows] - first[k]
            seq[rows] = bin0[k] + inside // times[k]
            off[rows] = offset[k] + (inside % times[k]) * n
        return pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select(*kept, (F.col("base") + F.col("local_rank")).alias("rank"))
    return Packed(map_arrow(ranked, place, "part int, row long, doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"), pieces)
