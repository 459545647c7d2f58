"""Shared primitives: tie ranks, distributed prefix sums, sliding frames, pair tables, kNN joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.functions.storage import written


def tie_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average rank of value within keys, equal values sharing theirs.

    Counts by value come first, so a window sees each distinct value once.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        ranks = counts.withColumn(name, F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    else:  # distinct values of a whole table: a distributed sum
        ranks = prefix_sum(counts, [value], ["_n"]).select(value, (F.col("cum__n") - (F.col("_n") - 1) / 2).alias(name))
    names = [*keys, value]
    ranks = ranks.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), name)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    return df.join(ranks, on).select(*df.columns, name)


def placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in order, range partitioned, with _p (partition) and _r (row in it, from 0), as a written table.

    Writing settles the partitions: whatever is counted on it later, in however
    many branches of a plan, sees the same ones.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(rows, "placed").select(*df.columns, F.shiftright("_id", 33).alias("_p"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_r"))


def prefix_sum(df: DataFrame, order: Sequence[str], values: Sequence[str], descending: bool = False) -> DataFrame:
    """Running sums `cum_<value>` over the whole table, without a one-task window.

    Rows are range partitioned, sorted and summed up as a stream once, and
    written with their partition; one total per partition gives each its base.
    Equal order keys must not span rows: aggregate by the order first. Null
    values add nothing.
    """
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    added = [f"cum_{v}" for v in values]
    kinds = {v: "long" if dict(df.dtypes)[v] in ("tinyint", "smallint", "int", "bigint") else "double" for v in values}
    at = [df.columns.index(v) for v in values]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = [0] * len(values)
        for b in batches:
            sums = []
            for k, v in enumerate(values):
                x = pc.fill_null(b.column(at[k]).cast(pa.int64() if kinds[v] == "long" else pa.float64()), 0)
                sums.append(pc.add(pc.cumulative_sum(x), total[k]))
                total[k] = sums[-1][-1].as_py() if len(x) else total[k]
            yield pa.RecordBatch.from_arrays([*b.columns, *sums], names=[*b.schema.names, *added])

    schema = rows.withColumns({f"cum_{v}": F.lit(None).cast(kinds[v]) for v in values}).schema
    local = written(rows.mapInArrow(run, schema), "prefix-sum")
    totals = local.groupBy("_p").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = totals.select("_p", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values))
    out = local.join(base, "_p")
    return out.select(*df.columns, *((F.col(f"cum_{v}") + F.col(f"_b_{v}")).alias(f"cum_{v}") for v in values))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """Dense row number from 0 within keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def sliding_frames(df: DataFrame, keys: Sequence[str], size: int, step: int, idx: str = "idx", win: str = "win") -> DataFrame:
    """Each row once per window it lies in; incomplete windows at the end are dropped.

    A row is copied at most ceil(size / step) times; sizes are row counts.
    """
    length = df.groupBy(*keys).agg((F.max(idx) + 1).alias("_n"))
    last = F.floor(F.col(idx) / step)
    first = F.greatest(F.lit(0), F.floor((F.col(idx) - size) / step) + 1)
    wins = F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))
    out = df.join(length, list(keys)).withColumn(win, F.explode(wins))
    return out.where((F.col(win) * step <= F.col(idx)) & (F.col(idx) < F.col(win) * step + size) & (F.col(win) * step + size <= F.col("_n"))).drop("_n")


def pair_table(ids: DataFrame, key: str) -> DataFrame:
    """P5: every unordered pair (a < b) of a table of identifiers."""
    a, b = ids.select(F.col(key).alias("a")).distinct(), ids.select(F.col(key).alias("b")).distinct()
    return a.join(b, F.col("a") < F.col("b"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row number from 1 by order within keys; without keys by written range partitions and their counts (P6), never in one task.

    Rows of equal order get different numbers.
    """
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return indexed(df, [], order, name).withColumn(name, F.col(name) + 1)


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, size: str | None = None) -> DataFrame:
    """Row number from 0 by order within keys, and on demand the key's size; a key of any size is spread over range partitions.

    Each partition holds a run of each key it has; a table of one row per
    partition and key, with where the run begins and how many rows of the key
    earlier partitions hold, is joined back.
    """
    rows = placed(df, [F.asc(c) for c in [*keys, *order]])
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    runs = rows.select(F.col("_p").alias("_q"), "_r", *named).groupBy("_q", *ks).agg(F.min("_r").alias("_first"), F.count("*").alias("_c"))
    own = Window.partitionBy(*ks) if ks else Window.partitionBy(F.lit(0))  # one row per partition of a key
    earlier = own.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).withColumn("_all", F.sum("_c").over(own))
    same = [F.col("_p") == F.col("_q"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    out = rows.join(runs, same)
    return out.select(*df.columns, (F.col("_r") - F.col("_first") + F.col("_before")).alias(name), *([F.col("_all").alias(size)] if size else []))


def connected(edges: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """id, label: the smallest id of each connected component of links (a, b), by alternating stars.

    A large star links each node's larger neighbours to its smallest one, a
    small star links its smaller neighbours (and itself) to that one; both keep
    the components, and every round about halves the way to the smallest id,
    so a chain of n nodes takes some log n rounds. Ids need an order. Each
    round is a written table; a hub's links stay rows of their own. The number
    of links after each round is put into `trace`.
    """
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    turned = lambda d: d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sum_of = lambda d: d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    state = sum_of(links)
    while True:
        both = turned(links)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))  # links point from larger to smaller ids
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        links = written(small, "links")
        now = sum_of(links)
        if trace is not None:
            trace.append(now["n"])
        if now == state:
            break
        state = now
    return ids.join(links.select(F.col("a").alias("id"), F.col("b").alias("_l")), "id", "left").select("id", F.coalesce("_l", "id").alias("label"))


#: Subjects of one block of pair_blocks: a task holds two blocks.
PAIR_SUBJECTS = 16


def pair_blocks(subjects: DataFrame, key: str, per_pairs, schema: str, subjects_a_block: int = PAIR_SUBJECTS) -> DataFrame:
    """All pairs a < b of subjects, one row each, by blocks: a task holds two blocks of subjects and does all pairs between them.

    A subject's row is sent once per block, not once per partner. per_pairs
    takes the rows of a task (a pandas frame) and the places (i, j) of its
    pairs, and returns the values of the columns that follow a and b in schema.
    """
    import pandas as pd  # not above: the tasks of a kNN join load this module too and do without

    kind = dict(subjects.dtypes)[key]
    blocks = max(1, -(-subjects.count() // subjects_a_block))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = subjects.withColumn("_b", own).withColumn("_o", other).withColumns({"_x": F.least("_b", "_o"), "_y": F.greatest("_b", "_o")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        b, names = pdf["_b"].to_numpy(), pdf[key].to_numpy()
        i, j = np.triu_indices(len(pdf), 1)
        x, y = int(pdf["_x"].iloc[0]), int(pdf["_y"].iloc[0])
        keep = np.ones(len(i), bool) if x == y else b[i] != b[j]
        i, j = i[keep], j[keep]
        return pd.DataFrame({"a": names[i], "b": names[j], **per_pairs(pdf, i, j)})

    return dealt.groupBy("_x", "_y").applyInPandas(run, f"a {kind}, b {kind}, {schema}")


#: A kNN join's blocks of rows and of queries: BLOCK vectors or less while they are at most SPREAD blocks, so that there are
#: enough tasks, and MOST beyond, which a vector is shipped least often with; longer vectors than WIDTH make blocks smaller.
BLOCK, SPREAD, MOST, WIDTH = 8192, 8, 32768, 64
#: Queries of one matrix product in a task and distances that it makes, both at most, and candidates measured at a time.
PRODUCT_BLOCK, DISTANCES, CANDIDATES = 64, 1 << 19, 1 << 16


def nearest(ids: np.ndarray, queries: np.ndarray, names: np.ndarray, rows: np.ndarray, k: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids and distances of each query's k nearest rows of another id; ties by id.

    A matrix product gives squared distances up to rounding; the rows that can
    be among the k nearest within that rounding are then measured exactly.
    """
    square = np.einsum("ij,ij->i", rows, rows)
    step = max(1, min(PRODUCT_BLOCK, DISTANCES // len(names)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(ids), step):
        own, q = ids[lo : lo + step], queries[lo : lo + step]
        if metric == "cityblock":
            near = np.stack([np.abs(rows - x).sum(1) for x in q])
            slack = np.zeros(len(q))
        else:
            mine = (q * q).sum(1)
            near = (-2 * q) @ rows.T
            near += square
            near += mine[:, None]
            slack = 1e-10 * (mine + square.max())
        near[own[:, None] == names[None]] = np.inf
        kth = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
        i, j = np.nonzero((near <= (kth + slack)[:, None]) & np.isfinite(near))
        d = np.empty(len(i))
        for at in range(0, len(i), CANDIDATES):  # many where rows are copies of each other
            apart = rows[j[at : at + CANDIDATES]] - q[i[at : at + CANDIDATES]]
            d[at : at + CANDIDATES] = np.abs(apart).sum(1) if metric == "cityblock" else np.sqrt((apart * apart).sum(1))
        best = np.lexsort((names[j], d, i))
        i, j, d = i[best], j[best], d[best]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((own[i[keep]], names[j[keep]], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def block_count(vec_col: str) -> Column:
    """Blocks of a key's vectors, an aggregate."""
    full = F.count("*") * F.greatest(F.max(F.size(vec_col)), F.lit(WIDTH)) / WIDTH  # in vectors of WIDTH components
    return F.greatest(F.ceil(full / MOST), F.least(F.lit(SPREAD).cast("long"), F.ceil(full / BLOCK))).cast("int")


def numpy_of(column: pa.Array) -> np.ndarray:
    """A column's values. Numbers come by DLPack: to_numpy() loads pandas, which takes some 25 MB of each process of a task."""
    plain = (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)) and not column.null_count
    return np.from_dlpack(column) if plain else column.to_numpy(zero_copy_only=False)


def arrow_of(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values as a column. Numbers go by their buffer, as pa.array() loads pandas too."""
    if values.dtype.kind in "iuf" and pa.from_numpy_dtype(values.dtype) == kind:
        return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(values)])
    return pa.array(values, kind)


def stacked(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix, without an object a row."""
    if column.null_count or pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors must not be null, and must be of one length")
    return numpy_of(pc.list_flatten(column).cast(pa.float64())).reshape(len(column), -1)


def nearest_in_batches(batches: Iterator[pa.RecordBatch], k: int, keys: Sequence[str], metric: str = "euclidean") -> Iterator[pa.RecordBatch]:
    """nearest() of one task: (keys, query_id, id, dist) from batches of (keys, id, vec, kind), where kind 0 are queries and 1 rows.

    A batch is split into its queries and rows as it comes in and let go, so
    that each vector is held once.
    """
    asked, names, rows = [], [], []
    for b in batches:
        if b.num_rows:
            stored, ids, vec = numpy_of(b["kind"]) == 1, numpy_of(b["id"]), stacked(b["vec"])
            asked.append((ids[~stored], vec[~stored]))
            names.append(ids[stored])
            rows.append(vec[stored])
            same, kind = [b[c][0] for c in keys], b.schema.field("id").type
            del b, ids, vec
    if not sum(map(len, names)):
        return
    names, rows = np.concatenate(names), np.concatenate(rows)
    for ids, queries in asked:
        if len(ids):
            found = nearest(ids, queries, names, rows, k, metric)
            columns = [*(pa.repeat(c, len(found[0])) for c in same), arrow_of(found[0], kind), arrow_of(found[1], kind), arrow_of(found[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "query_id", "id", "dist"])


def knn_join(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", keys: Sequence[str] = (), metric: str = "euclidean") -> DataFrame:
    """The k nearest other rows of each query: (keys, query_id, id, dist, rank).

    Each key's queries and rows are dealt into as many blocks as their counts
    ask for, so a task holds at most about MOST queries and MOST rows whatever
    the input; every block of queries meets every block of rows, and blocks'
    candidates are merged. Ties go to the smaller id.
    """
    blocks = lambda df, name: df.groupBy(*keys).agg(block_count(vec_col).alias(name))
    with_blocks = lambda df, sizes: df.join(sizes, list(keys)) if keys else df.join(F.broadcast(sizes))
    sizes = with_blocks(blocks(queries, "_qn"), blocks(rows, "_rn"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = lambda df, kind: with_blocks(df.select(*keys, F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.lit(kind).alias("kind")), sizes)
    q = base(queries, 0).where("_rn > 0").withColumn("qb", own("_qn")).withColumn("rb", every("_rn"))
    r = base(rows, 1).where("_qn > 0").withColumn("rb", own("_rn")).withColumn("qb", every("_qn"))
    dealt = q.drop("_qn", "_rn").unionByName(r.drop("_qn", "_rn"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return nearest_in_batches(batches, k, keys, metric)

    kind = dict(queries.dtypes)
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keys), f"query_id {kind[id_col]}", f"id {kind[id_col]}", "dist double"])
    found = dealt.groupBy(*keys, "qb", "rb").applyInArrow(near, schema)
    order = Window.partitionBy(*keys, "query_id").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
