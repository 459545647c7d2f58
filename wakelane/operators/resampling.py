"""Bootstrap and permutation replicates (2.J) by counts: each block of a cell's rows gives its part of every replicate's sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.functions.draws import block_base, drawn_counts, hashes, permuted_counts, permuted_sums, resampled_sums, resampled_wins
from wakelane.operators.primitives import indexed

#: Rows of a block, and blocks of a cell: larger cells have larger blocks.
BLOCK, BLOCKS = 1 << 14, 1024


def base_of(seed: int, keys: Sequence[str]) -> Column:
    """32 bits of the md5 of seed and keys: where a cell's draws begin."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def block_size(n: Column, block: int) -> Column:
    return F.greatest(F.lit(block).cast("long"), F.ceil(n / BLOCKS))


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[Column], seed: int, block: int) -> DataFrame:
    """keys, _blk, _i (number in the cell), _n (its size), _size (of blocks), _base, and the columns."""
    names = [c for c in dict.fromkeys(order) if c not in keys]
    rows = indexed(df.select(*keys, *names, *columns), keys, [c for c in order if c not in keys], "_i", "_n")
    rows = rows.withColumn("_size", block_size(F.col("_n"), block)).withColumn("_base", base_of(seed, keys))
    return rows.withColumn("_blk", F.floor(F.col("_i") / F.col("_size"))).drop(*names)


def _cut(n: int, size: int) -> np.ndarray:
    return np.array([min(size, n - at) for at in range(0, n, size)])


def _fields(df: DataFrame, keys: Sequence[str], *more: str) -> str:
    kind = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kind[k]}" for k in keys), *more])


def _keyed(pdf: pd.DataFrame, keys: Sequence[str], **columns) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    return pd.DataFrame({**{k: pdf[k].iloc[:1].repeat(n).to_numpy() for k in keys}, **columns})


def bootstrap_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """keys, b, m: mean of as many values as the cell has, drawn with replacement, for each replicate.

    Rows are drawn by their number in the order; null values take no part.
    """
    rows = _blocks(df.where(F.col(v).isNotNull()), keys, order, [F.col(v).cast("double").alias("_v")], seed, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        n, size, k, base = (int(pdf[c].iloc[0]) for c in ("_n", "_size", "_blk", "_base"))
        sizes = _cut(n, size)
        counts = drawn_counts(base, k, sizes, replicates, n)
        return _keyed(pdf, keys, b=np.arange(replicates), n=np.full(replicates, n), s=resampled_sums(block_base(base, k, len(sizes)), counts, pdf._v.to_numpy()))

    sums = rows.groupBy(*keys, "_blk").applyInPandas(run, _fields(rows, keys, "b int, n long, s double"))
    return sums.groupBy(*keys, "b").agg((F.sum("s") / F.first("n")).alias("m"))


def first_draws(df: DataFrame, keys: Sequence[str], order: Sequence[str], v: str, most: int, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """keys, b, j, v: the first `most` values drawn in each replicate, in turn; only drawn rows leave a task."""
    rows = _blocks(df, keys, order, [F.col(v).cast("double").alias("_v")], seed, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        n, base, first = (int(pdf[c].iloc[0]) for c in ("_n", "_base", "_i"))
        b, j = np.divmod(np.arange(replicates * most), most)
        row = (hashes(base, b, j) * np.uint64(n) >> np.uint64(32)).astype(np.int64) - first
        mine = np.flatnonzero((row >= 0) & (row < len(pdf)))
        return _keyed(pdf, keys, b=b[mine], j=j[mine], v=pdf._v.to_numpy()[row[mine]])

    return rows.groupBy(*keys, "_blk").applyInPandas(run, _fields(rows, keys, "b int, j int, v double"))


def permuted_group_sums(df: DataFrame, keys: Sequence[str], group: str, order: Sequence[str], v: str, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """keys, b (from 1), g (place of the group in order), n, s: size and sum of each group after each permutation of labels.

    The groups of a cell are few, as they are compared. Null values take no part.
    """
    some = df.where(F.col(v).isNotNull())
    rows = _blocks(some, keys, [group, *order], [F.col(v).cast("double").alias("_v")], seed, block)
    sizes = some.groupBy(*keys, group).agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(group, "_c"))), lambda x: x["_c"]).alias("_groups"))
    rows = rows.join(sizes, list(keys)) if keys else rows.join(F.broadcast(sizes))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        n, size, k, base = (int(pdf[c].iloc[0]) for c in ("_n", "_size", "_blk", "_base"))
        groups, cut = np.array(pdf._groups.iloc[0]), _cut(n, size)
        counts = permuted_counts(base, k, cut, replicates, groups)
        sums = permuted_sums(block_base(base, k, len(cut)), counts, pdf._v.to_numpy())
        b, g = np.divmod(np.arange(sums.size), len(groups))
        return _keyed(pdf, keys, b=b + 1, g=g, n=groups[g], s=sums.ravel())

    parts = rows.groupBy(*keys, "_blk").applyInPandas(run, _fields(rows, keys, "b int, g int, n long, s double"))
    return parts.groupBy(*keys, "b", "g").agg(F.first("n").alias("n"), F.sum("s").alias("s"))


def resampled_deltas(df: DataFrame, keys: Sequence[str], group: str, a, b, v: str, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """keys, b, delta: Cliff's delta of group a over b with both groups drawn anew, for each replicate.

    Blocks are runs of distinct values, counted by group first; a value with
    more rows than a block is a block of its own, which costs no draws. Cells
    that lack a group are left out; null values take no part.
    """
    counts = df.where(F.col(v).isNotNull() & F.col(group).isin(a, b)).groupBy(*keys, F.col(v).cast("double").alias("_v")).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    whole = counts.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb")).where("_na > 0 AND _nb > 0")
    counts = counts.join(whole, list(keys)) if keys else counts.join(F.broadcast(whole))
    both, size = F.col("_a") + F.col("_b"), block_size(F.col("_na") + F.col("_nb"), block)
    below = F.sum(both).over(Window.partitionBy(*keys).orderBy("_v")) - both
    rows = counts.withColumn("_blk", 2 * F.floor(below / size) + (both > size).cast("long")).select(*keys, "_blk", "_v", "_a", "_b")
    totals = rows.groupBy(*keys, "_blk").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    every = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_blk", "_a", "_b"))).alias("_sizes"))
    heads = every.select(*keys, F.explode("_sizes._blk").alias("_blk"), F.transform("_sizes", lambda x: F.array(x["_blk"], x["_a"], x["_b"])).alias("_sizes"), base_of(seed, keys).alias("_base"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head, pdf = pdf[pdf._base.notna()], pdf[pdf._base.isna()].sort_values("_v")
        sizes, base, mine = np.stack([np.asarray(x) for x in head._sizes.iloc[0]]), int(head._base.iloc[0]), int(pdf._blk.iloc[0])
        k = int(np.searchsorted(sizes[:, 0], mine))
        drawn = [drawn_counts(base + i, k, sizes[:, i], replicates, int(sizes[:, i].sum())) for i in (1, 2)]
        wins, x, y = resampled_wins(block_base(base, k, len(sizes)), *drawn, pdf._a.to_numpy(np.int64), pdf._b.to_numpy(np.int64))
        return _keyed(pdf, keys, blk=np.full(replicates, k), b=np.arange(replicates), wins=wins, x=x, y=y)

    parts = rows.unionByName(heads, allowMissingColumns=True).groupBy(*keys, "_blk").applyInPandas(run, _fields(rows, keys, "blk int, b int, wins double, x double, y double"))
    earlier = Window.partitionBy(*keys, "b").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # blocks of a cell: at most 2 * BLOCKS + 1
    won = F.col("wins") + F.col("x") * F.coalesce(F.sum("y").over(earlier), F.lit(0.0))
    return parts.withColumn("_w", won).groupBy(*keys, "b").agg((2 * F.sum("_w") / (F.sum("x") * F.sum("y")) - 1).alias("delta"))
