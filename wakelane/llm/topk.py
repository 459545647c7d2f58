"""Exact top-k by inner product with pivot-table elimination.

With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) satisfy
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest
neighbours. Distances of every row to many pivots are computed once; for a
query, the largest |d(q', p) - d(x', p)| bounds the distance from below and the
product from above. Rows are evaluated in the order of their bounds until no
bound reaches the k-th product found. Products are exact integers throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.llm.common import map_arrow, tuned

#: Pivots, and the rows (smallest hashes) that they are chosen from. Pivots change the work, never the result.
PIVOTS = 24
PIVOT_SAMPLE = 1024
#: Queries that one task holds, rows that one task reads for them, and rows that it orders by their bounds together.
QUERY_BLOCK = 1 << 16
ROW_BLOCK = 1 << 20
BOUND_BLOCK = 1 << 14
LEAST_SPLITS = 24
#: Integer products below this are exact in double precision; from the second on they do not fit a long.
EXACT_FLOAT, EXACT_LONG = 1 << 53, 1 << 62


def quantised(embedding: Column) -> Column:
    """floor(1024 * x) of each component as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 1024))


def usable(embedding: Column) -> Column:
    """Neither null nor empty, no null and no non-finite component."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite, F.lit(False))


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    """n rows far from each other, beginning with the first."""
    chosen = [0]
    least = np.linalg.norm(rows - rows[0], axis=1)
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
    return rows[chosen]


def lifted(rows: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (rows * rows).sum(1), 0))
    return np.column_stack([rows, rest])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Search:
    """Running top-k of one block of queries over blocks of rows, given their rows of the pivot table."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, table: np.ndarray, top: float, k: int):
        self.ids, self.queries, self.table, self.top, self.k = ids, queries, table, top, k
        self.square = (queries.astype(float) ** 2).sum(1)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, queries.dtype), np.zeros(0, np.int64)) for _ in ids]
        self.evaluated = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, table: np.ndarray) -> None:
        # Rounding of distances is far below this part of the squares' size.
        slack = 1e-9 * (self.square + self.top) + 1
        for i, own in enumerate(self.ids):
            apart = np.abs(table - self.table[i]).max(1)
            bound = (self.square[i] + self.top - apart * apart) / 2 + slack[i]
            scores, names = self.best[i]
            least = scores[-1] if len(scores) == self.k else -np.inf
            order = np.flatnonzero((bound >= least) & (ids != own))
            if not len(order):
                continue
            order = order[np.argsort(-bound[order])]
            at, size = 0, 4 * self.k
            while at < len(order) and bound[order[at]] >= least:
                some = order[at : at + size]
                self.evaluated += len(some)
                found = rows[some] @ self.queries[i]
                scores, names = np.concatenate([scores, found]), np.concatenate([names, ids[some]])
                keep = np.lexsort((names, -scores))[: self.k]
                scores, names = scores[keep], names[keep]
                least = scores[-1] if len(scores) == self.k else -np.inf
                at, size = at + size, 2 * size
            self.best[i] = scores, names

    def result(self) -> pa.RecordBatch:
        query = np.repeat(self.ids, [len(s) for s, _ in self.best])
        score = np.concatenate([s for s, _ in self.best] or [np.zeros(0, np.int64)])
        name = np.concatenate([n for _, n in self.best] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(name, pa.int64()), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query row.

    Candidates are all rows with another id; ties go to the smaller id. Rows
    whose vector is unusable or whose id is null take no part, as query or
    candidate; vectors meet only those of their own length. Rows that repeat an
    id are candidates each, and one query (of different vectors, the first in
    array order). Fewer than k candidates give fewer rows; an empty table gives
    none. Products are taken in double precision where all of them are exact
    there, else in 64-bit integers; components so large that a product might
    not fit a long are an error. Other columns are not read.

    The pivot table is made once. A query row goes to every split of the rows,
    and a row to every block of queries: a stated query set against all rows, in
    blocks of bounded size.
    """
    spark = tuned(df.sparkSession)
    v = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    v = v.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    dims = {r["d"]: r for r in v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("queries"), F.max(square).alias("top"), F.max(F.array_max(F.transform("v", F.abs))).alias("size")).collect()}
    if any(d * int(r["size"]) ** 2 >= EXACT_LONG for d, r in dims.items()):
        raise ValueError("a component is too large for products that fit a long")
    exact = {d: np.float64 if d * int(r["size"]) ** 2 < EXACT_FLOAT else np.int64 for d, r in dims.items()}
    pivots = {}
    for d, r in dims.items():
        some = v.where(F.size("v") == d).orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()
        pivots[d] = farthest_first(lifted(np.array([x["v"] for x in some], float), r["top"]), PIVOTS), r["top"]
    total, queries = sum(r["n"] for r in dims.values()), sum(r["queries"] for r in dims.values())
    splits, blocks = max(LEAST_SPLITS, -(-total // ROW_BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    shared = spark.sparkContext.broadcast(pivots)
    part = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The pivot table's rows: distances of lifted rows to the pivots of their length."""
        column, sizes = batch.column(1), pc.list_value_length(batch.column(1)).to_numpy()
        out = np.zeros((batch.num_rows, PIVOTS))
        for d in np.unique(sizes):
            mine = np.flatnonzero(sizes == d)
            points, top = shared.value[int(d)]
            found = distances(lifted(column.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), int(d)).astype(float), top), points)
            out[mine, : found.shape[1]] = found
        table = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, PIVOTS, dtype=np.int32)), pa.array(out.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, table], names=[*batch.schema.names, "t"])

    v = map_arrow(v.select("id", "v", "q"), measure, "id long, v array<long>, q boolean, t array<double>")
    first = v.where("q").groupBy("id").agg(F.min(F.struct("v", "t")).alias("x")).select("id", "x.v", "x.t")
    asked = first.select(F.size("v").alias("d"), part("id", blocks, 1).alias("b"), every(splits).alias("s"), F.lit(0).alias("kind"), "id", "v", "t")
    rows = v.select(F.size("v").alias("d"), part("id", splits, 2).alias("s"), F.lit(1).alias("kind"), "id", "v", "t", every(blocks).alias("b")).select(*asked.columns)
    dealt = asked.unionByName(rows).repartition(max(splits * blocks, 1), "d", "b", "s").sortWithinPartitions("d", "b", "s", "kind", "id")

    def run(batches):
        key, search, held, n = None, None, [], 0

        def take(d):
            """What is held as ids, vectors and pivot distances; holds nothing afterwards."""
            ids, rows, table = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return ids, rows.reshape(len(ids), d), table.reshape(len(ids), PIVOTS)

        def flush():
            nonlocal search, n
            if held and kind_held == 0:
                search = Search(*take(key[0]), shared.value[key[0]][1], k)
            elif held and search:
                search.add(*take(key[0]))
            held.clear()
            n = 0

        kind_held = 0
        for batch in batches:
            d, b, s, kind, name = (batch.column(i).to_numpy() for i in range(5))
            keys = np.column_stack([d, b, s, kind])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if tuple(keys[lo, :3].tolist()) != key:
                    flush()
                    if search:
                        yield search.result()
                    key, search = tuple(keys[lo, :3].tolist()), None
                elif kind[lo] != kind_held or kind[lo] and n >= BOUND_BLOCK:
                    flush()
                kind_held = kind[lo]
                held.append((name[lo:hi], *(batch.column(i).slice(lo, hi - lo).flatten().to_numpy().astype(t) for i, t in ((5, exact[key[0]]), (6, float)))))
                n += hi - lo
        flush()
        if search:
            yield search.result()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
