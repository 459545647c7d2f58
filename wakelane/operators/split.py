"""Splits (2.F): seeded, by subject, by time. Draws are P2 hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.functions.columns import hash_order
from wakelane.functions.storage import written
from wakelane.operators.primitives import prefix_sum


def cut(position: Column, n: Column, train: float, val: float) -> Column:
    """train for the first int(n * train) rows, val for the next int(n * val), test for the rest."""
    a = F.floor(n * F.lit(train) + 1e-9)
    b = a + F.floor(n * F.lit(val) + 1e-9)
    return F.when(position < a, "train").when(position < b, "val").otherwise("test")


def stratified_split(df: DataFrame, label: str, key: str, seed: int, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """per label, rows in hash order are cut by the shares. A label is a key: give many-rowed labels a finer stratum."""
    whole = Window.partitionBy(label)
    place = F.row_number().over(whole.orderBy(hash_order(seed, key), key)) - 1
    return df.withColumn("split", cut(place, F.count("*").over(whole), train, val))


def subject_split(df: DataFrame, subjects: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows of listed subjects with their split; rows with a null in columns go."""
    return df.dropna(subset=list(columns)).join(subjects.select(key, "split"), key)


def subject_time_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], train: float = 0.6, val: float = 0.2) -> DataFrame:
    """per subject, the first rows in time train, the next validate, the rest test."""
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy(*order)) - 1
    return df.withColumn("split", cut(place, F.count("*").over(whole), train, val))


#: Runs of cuts on each side.
CUT_BLOCKS = 1024


def time_cuts(daily: DataFrame, order: Sequence[str], train: float = 0.6, test: float = 0.2, window: float = 0.1, least: int = 100) -> DataFrame:
    """one row (i, j) of cuts near the shares with the best class balance.

    daily holds rows (n) and positives (pos) per time step: cuts fall between
    steps, so candidates are steps, not rows. Loss: twice the gaps of the three
    positive rates to the whole, plus the gaps of the sizes. Ties: smallest i,
    then j. With fewer than 3 * least rows the plain shares are cut. The loss
    has a part of i, one of j, and one of both. Cuts of each side are put into
    CUT_BLOCKS runs; one pair of each two runs bounds the loss from above, the
    runs' ends bound it from below, and only pairs of runs that may hold the
    best one are searched.
    """
    run = prefix_sum(daily, order, ["n", "pos"]).select(F.col("cum_n").alias("i"), F.col("cum_pos").alias("p"))
    total = daily.agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    c = run.join(F.broadcast(total))
    first = F.round(F.col("rows") * train)
    second = F.round(F.col("rows") * (1 - test))
    reach = F.greatest(F.lit(1), F.round(F.col("rows") * window))
    rate = F.col("positives") / F.col("rows")
    gap = lambda pos, n: F.abs(pos / n - rate)
    i, j, p, q, n = (F.col(x) for x in ("i", "j", "p", "q", "rows"))
    head = 2 * gap(p, i) + F.abs(i / n - train)
    tail = 2 * gap(F.col("positives") - q, n - j) + F.abs((n - j) / n - test)
    middle = 2 * gap(q - p, j - i) + F.abs((j - i) / n - (1 - train - test))
    inside = lambda at, lo, hi: (at >= F.greatest(F.lit(least), lo)) & (at <= hi)
    block = lambda at, lo: F.floor((at - lo) * CUT_BLOCKS / (2 * reach + 1))
    a = c.where(inside(i, first - reach, F.least(first + reach, n - 2 * least))).withColumns({"head": head, "x": block(i, first - reach)})
    b = c.withColumnsRenamed({"i": "j", "p": "q"}).where(inside(j, second - reach, F.least(second + reach, n - least))).withColumns({"tail": tail, "y": block(j, second - reach)}).select("j", "q", "tail", "y")
    ends = lambda k: [f(k).alias(f"{k}{e}") for e, f in ((0, F.min), (1, F.max))]
    # At most CUT_BLOCKS rows a side, whatever the steps.
    xs = a.groupBy("x", "rows", "positives").agg(F.min("head").alias("least_head"), *ends("i"), *ends("p"), F.min_by(F.struct("i", "p", "head"), F.struct("head", "i")).alias("u"))
    ys = b.groupBy("y").agg(F.min("tail").alias("least_tail"), *ends("j"), *ends("q"), F.min_by(F.struct("j", "q", "tail"), F.struct("tail", "j")).alias("v"))
    pairs = written(xs.join(F.broadcast(ys), F.col("j1") >= F.col("i0") + least), "cuts")
    loss = F.round(F.col("head") + middle + F.col("tail"), 9)
    bound = pairs.select("u.*", "v.*", "rows", "positives").where(j >= i + least).agg(F.min(loss).alias("_u"))
    far = lambda value, lo, hi: F.greatest(F.lit(0.0), lo - value, value - hi)
    near, wide = F.greatest(F.col("j0") - F.col("i1"), F.lit(least)), F.col("j1") - F.col("i0")
    low = F.col("least_head") + F.col("least_tail") + 2 * far(rate, F.greatest(F.col("q0") - F.col("p1"), F.lit(0)) / wide, (F.col("q1") - F.col("p0")) / near) + far(F.lit(1 - train - test), near / n, wide / n)
    open_ = pairs.join(F.broadcast(bound)).where(F.col("_u").isNull() | (low <= F.col("_u") + 1e-8)).select("x", "y")
    best = a.join(open_, "x").join(b, "y").where(j >= i + least).agg(F.min(F.struct(loss.alias("loss"), "i", "j")).alias("b"))
    return best.join(F.broadcast(total)).select(F.coalesce("b.i", F.round(F.col("rows") * train)).cast("long").alias("i"), F.coalesce("b.j", F.round(F.col("rows") * (1 - test))).cast("long").alias("j"))


def group_shuffle_split(df: DataFrame, group: str, seed: int, test: float = 0.3) -> DataFrame:
    """whole groups to test, the share of groups rounded up, by hash order."""
    g = df.select(group).distinct()
    n = F.broadcast(g.agg(F.ceil(F.count("*") * test).alias("_t")))
    place = F.row_number().over(Window.orderBy(hash_order(seed, group), group))  # one row per group
    side = g.withColumn("_k", place).join(n).select(group, F.when(F.col("_k") <= F.col("_t"), "test").otherwise("train").alias("split"))
    return df.join(side, group)


def finetune_split(df: DataFrame, targets: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """others train; of the target subjects' rows every second in hash order validates, the rest test."""
    marked = df.join(targets.select(group, F.lit(1).alias("_t")).distinct(), group, "left")
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, key), key))
    return marked.withColumn("split", F.when(F.col("_t").isNull(), "train").when(place % 2 == 1, "val").otherwise("test")).drop("_t")


def mode_split(df: DataFrame, targets: DataFrame, group: str, order: Sequence[str], mode: str) -> DataFrame:
    """source_only trains and validates on others and tests on targets; mixed trains on all, validates and tests on targets."""
    timed = subject_time_split(df, [group], order)
    marked = timed.join(targets.select(group, F.lit(1).alias("_t")).distinct(), group, "left")
    target, split = F.col("_t").isNotNull(), F.col("split")
    if mode == "source_only":
        use = F.when(~target & split.isin("train", "val"), split).when(target & (split == "test"), split)
    elif mode == "mixed":
        use = F.when((split == "train") | target, split)
    else:
        raise ValueError(f"unknown mode {mode}")
    return marked.withColumn("split", use).where("split IS NOT NULL").drop("_t")


def split_summary(df: DataFrame, label: str) -> DataFrame:
    """rows, positives and rate per split and in total."""
    return df.rollup("split").agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("rate")).withColumn("split", F.coalesce("split", F.lit("total")))


def lacks_class(df: DataFrame, label: str) -> bool:
    """F8: whether some split has one class only; callers then fall back to F1."""
    return bool(df.groupBy("split").agg(F.count_distinct(label).alias("c")).where("c < 2").limit(1).count())


def stratified_kfold(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """fold 0 .. k-1, dealt per label in hash order."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key)) - 1
    return df.withColumn("fold", (place % k).cast("int"))


def stratified_subsample(df: DataFrame, label: str, key: str, cap: int, seed: int) -> DataFrame:
    """at most cap rows, each class its share and at least one."""
    size = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = F.broadcast(size.agg(F.sum("_c").alias("_n")))
    quota = size.join(total).select(label, F.greatest(F.lit(1), F.floor(F.col("_c") * F.least(F.lit(1.0), F.lit(cap) / F.col("_n")))).alias("_q"))
    place = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key))
    return df.withColumn("_k", place).join(F.broadcast(quota), label).where("_k <= _q").drop("_k", "_q")
