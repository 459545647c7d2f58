"""Rank statistics, resampling and variance decomposition over result grids (2.J), many cells at once."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.functions.columns import hash_uniform, normal_cdf
from wakelane.functions.pairs import grid_inversions, inversions, median_difference
from wakelane.functions.tails import NEMENYI_Q, chi2_p, mann_whitney_p, shapiro_w, t_crit, t_p
from wakelane.operators.joins import paired
from wakelane.operators.primitives import tie_rank
from wakelane.operators.resampling import bootstrap_means, first_draws, permuted_group_sums, resampled_deltas


def describe_cells(df, keys, v):
    """J1."""
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def ties(df, keys, v):
    """Sum of t^3 - t over values of each cell, and its size N."""
    t = df.groupBy(*keys, v).agg(F.count("*").alias("_t"))
    return t.groupBy(*keys).agg(F.sum(F.pow("_t", 3) - F.col("_t")).alias("ties"), F.sum("_t").alias("all_n"))


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys)) if keys else a.join(F.broadcast(b))


def kruskal_wallis(df, keys, group, v):
    """H with tie correction, degrees, p and eta squared; cells where every group has two values."""
    r = tie_rank(df, keys, v)
    g = r.groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum("rank").alias("R"))
    s = g.groupBy(*keys).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.sum(F.col("R") * F.col("R") / F.col("n")).alias("q"))
    s = _join(s, ties(df, keys, v), keys).where("least >= 2 AND k >= 2 AND ties < pow(all_n, 3) - all_n")
    n = F.col("all_n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3) - n))
    s = s.withColumn("H", h)
    return s.select(*keys, F.col("all_n").alias("N"), "k", "H", F.greatest(F.lit(0.0), (F.col("H") - F.col("k") + 1) / (n - F.col("k"))).alias("eta2"), chi2_p("H", (F.col("k") - 1).cast("double")).alias("p"))


def mann_whitney(df, keys, group, a, b, v):
    """U of a over b, two-sided p, Cliff's delta with label.

    p is exact where a group has at most 8 values and none are tied, else normal
    with tie and continuity correction.
    """
    two = df.where(F.col(group).isin(a, b))
    r = tie_rank(two, keys, v)
    s = r.groupBy(*keys).agg(F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("ra"), F.count_if(F.col(group) == a).alias("n"), F.count_if(F.col(group) == b).alias("m")).where("n > 0 AND m > 0")
    s = _join(s, ties(two, keys, v), keys)
    n, m, N = F.col("n"), F.col("m"), F.col("all_n")
    u = F.col("ra") - n * (n + 1) / 2
    sd = F.sqrt(n * m / 12 * (N + 1 - F.col("ties") / F.nullif(N * (N - 1), F.lit(0))))
    z = F.greatest(F.lit(0.0), F.abs(u - n * m / 2) - 0.5) / F.nullif(sd, F.lit(0.0))
    delta = 2 * u / (n * m) - 1
    s = s.withColumn("U", u)
    exact = F.when((F.least(n, m) <= 8) & (F.col("ties") == 0), mann_whitney_p(F.col("U"), n.cast("double"), m.cast("double")))
    return s.select(*keys, "n", "m", "U", F.coalesce(exact, 2 * (1 - normal_cdf(z))).alias("p"), delta.alias("delta"), magnitude(delta, (0.147, 0.33, 0.474), ("negligible", "small", "medium", "large")).alias("size"))


def magnitude(c: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    out = F.when(F.abs(c) < cuts[0], names[0])
    for cut, name in zip(cuts[1:], names[1:]):
        out = out.when(F.abs(c) < cut, name)
    return out.otherwise(names[-1])


def wilcoxon(pairs, keys, a, b, least: int = 6):
    """Signed ranks of a - b per cell with at least `least` pairs; zeros are dropped; W, z and p (W = 0, p = 1 if all are)."""
    d = pairs.withColumn("_d", F.round(F.col(a) - F.col(b), 12))
    size = d.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    r = tie_rank(d.where("_d <> 0").withColumn("_a", F.abs("_d")), keys, "_a")
    s = r.groupBy(*keys).agg(F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col("_d") < 0, F.col("rank")).otherwise(0.0)).alias("wm"), F.count("*").alias("m"))
    s = s.join(ties(d.where("_d <> 0").withColumn("_a", F.abs("_d")), keys, "_a"), list(keys))
    out = size.join(s, list(keys), "left")
    m = F.col("m")
    w = F.coalesce(F.least("wp", "wm"), F.lit(0.0))
    z = F.abs(w - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    return out.select(*keys, "n", w.alias("W"), F.coalesce(2 * (1 - normal_cdf(z)), F.lit(1.0)).alias("p"))


def paired_t(pairs, keys, a, b):
    """T of a - b, its p, and Cohen's d by pooled deviation with label."""
    s = pairs.withColumn("_d", F.col(a) - F.col(b)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_d").alias("m"), F.stddev_samp("_d").alias("sd"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb")).where("n >= 2")
    t = F.col("m") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    d = (F.col("ma") - F.col("mb")) / F.nullif(F.sqrt((F.col("va") + F.col("vb")) / 2), F.lit(0.0))
    s = s.withColumn("t", t).withColumn("d", d)
    return s.select(*keys, "n", "t", t_p("t", (F.col("n") - 1).cast("double")).alias("p"), "d", magnitude(F.col("d"), (0.2, 0.5, 0.8, 1.0), ("negligible", "small", "medium", "large", "very large")).alias("size"))


def complete_blocks(df, keys, block, group, v):
    """Rows of the blocks that have every group of their cell."""
    k = df.groupBy(*keys).agg(F.count_distinct(group).alias("_k"))
    full = df.groupBy(*keys, block).agg(F.count_distinct(group).alias("_c"))
    full = _join(full, k, keys).where("_c = _k").drop("_c")
    return df.groupBy(*keys, block, group).agg(F.avg(v).alias(v)).join(full, [*keys, block])


def friedman(df, keys, block, group, v, least: int = 3):
    """Chi squared over complete blocks with tie term, p, and Cohen's w."""
    rows = complete_blocks(df, keys, block, group, v)
    r = tie_rank(rows, [*keys, block], v)
    s = r.groupBy(*keys, group).agg(F.sum("rank").alias("R"), F.count("*").alias("n"), F.first("_k").alias("k")).groupBy(*keys).agg(F.sum(F.col("R") * F.col("R")).alias("q"), F.max("n").alias("n"), F.max("k").alias("k"))
    t = ties(rows, [*keys, block], v).groupBy(*keys).agg(F.sum("ties").alias("ties"))
    s = _join(s, t, keys).where((F.col("n") >= least) & (F.col("k") >= 2))
    n, k = F.col("n"), F.col("k")
    chi = (12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)) / F.nullif(1 - F.col("ties") / (n * k * (k * k - 1)), F.lit(0.0))
    s = s.withColumn("chi2", chi)
    return s.select(*keys, "n", "k", "chi2", chi2_p("chi2", (k - 1).cast("double")).alias("p"), (F.col("chi2") / (n * (k - 1))).alias("w"))


def nemenyi(df, keys, block, group, v):
    """Mean descending rank of each group over complete blocks, and the critical difference."""
    rows = complete_blocks(df, keys, block, group, v).withColumn("_v", -F.col(v))
    r = tie_rank(rows, [*keys, block], "_v").groupBy(*keys, group).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"), F.first("_k").alias("k"))
    q = F.element_at(F.array(*map(F.lit, NEMENYI_Q)), F.least(F.greatest(F.col("k"), F.lit(2)), F.lit(10)).cast("int") - 1)
    return r.select(*keys, group, "mean_rank", "n", (q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n")))).alias("cd"))


def dunn(df, keys, group, v):
    """Tie-corrected z and p of each pair of groups."""
    r = tie_rank(df, keys, v).groupBy(*keys, group).agg(F.avg("rank").alias("m"), F.count("*").alias("n"))
    t = ties(df, keys, v)
    a = r.select(*keys, F.col(group).alias("a"), F.col("m").alias("ma"), F.col("n").alias("na"))
    b = r.select(*keys, F.col(group).alias("b"), F.col("m").alias("mb"), F.col("n").alias("nb"))
    p = (a.join(b, list(keys)) if keys else a.crossJoin(b)).where("a < b")
    p = _join(p, t, keys)
    N = F.col("all_n")
    se = F.sqrt((N * (N + 1) / 12 - F.col("ties") / (12 * (N - 1))) * (1 / F.col("na") + 1 / F.col("nb")))
    z = (F.col("ma") - F.col("mb")) / F.nullif(se, F.lit(0.0))
    return p.select(*keys, "a", "b", z.alias("z"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p"))


def scheirer_ray_hare(df, a, b, v):
    """H and p of two factors and their interaction on global ranks."""
    r = tie_rank(df, [], v)
    total = F.broadcast(r.agg(F.count("*").alias("all_n"), F.avg("rank").alias("gm"), F.var_samp("rank").alias("ms")))
    ss = lambda *f: r.groupBy(*f).agg(F.count("*").alias("n"), F.avg("rank").alias("m")).join(total).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ss"), F.max("ms").alias("ms"), F.count("*").alias("c"))
    sa, sb, sab = ss(a), ss(b), ss(a, b)
    one = sa.select(F.col("ss").alias("a"), "ms", F.col("c").alias("ca")).join(sb.select(F.col("ss").alias("b"), F.col("c").alias("cb"))).join(sab.select(F.col("ss").alias("ab")))
    rows = F.explode(F.array(F.struct(F.lit(a).alias("effect"), (F.col("a") / F.col("ms")).alias("H"), (F.col("ca") - 1).alias("df")), F.struct(F.lit(b).alias("effect"), (F.col("b") / F.col("ms")).alias("H"), (F.col("cb") - 1).alias("df")), F.struct(F.lit(f"{a}:{b}").alias("effect"), ((F.col("ab") - F.col("a") - F.col("b")) / F.col("ms")).alias("H"), ((F.col("ca") - 1) * (F.col("cb") - 1)).alias("df"))))
    return one.select(rows.alias("r")).select("r.*").withColumn("p", chi2_p("H", F.col("df").cast("double")))


def brown_forsythe(df, keys, group, v):
    """Levene's F on absolute gaps to group medians."""
    med = df.groupBy(*keys, group).agg(F.median(v).alias("_med"))
    z = df.join(med, [*keys, group]).withColumn("z", F.abs(F.col(v) - F.col("_med")))
    g = z.groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("s"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.pow("m", 2)).alias("q"), F.sum(F.col("n") * F.col("s")).alias("w")).where("k >= 2 AND all_n > k")
    return t.select(*keys, (((F.col("q") - F.col("all_n") * F.pow("gm", 2)) / (F.col("k") - 1)) / F.nullif(F.col("w") / (F.col("all_n") - F.col("k")), F.lit(0.0))).alias("F_stat"))


def hodges_lehmann(df, keys, group, a, b, v):
    """Median of all differences a - b inside a cell, by selection without forming pairs.

    Values are counted by Spark; a cell's task holds its distinct values with
    their counts (16 bytes each), not its rows. Null and NaN values take no part;
    cells that lack a group are left out.
    """
    some = df.where(F.col(group).isin(a, b) & F.col(v).isNotNull()).select(*keys, (F.col(group) == a).alias("_a"), F.col(v).cast("double").alias("_v")).where(~F.isnan("_v"))
    counts = some.groupBy(*keys, "_a", "_v").agg(F.count("*").alias("_n"))

    def run(pdf):
        x, y = pdf[pdf["_a"]], pdf[~pdf["_a"]]
        shift = median_difference(*(d[c].to_numpy() for d in (x, y) for c in ("_v", "_n"))) if len(x) and len(y) else None
        return pdf[list(keys)].head(1).assign(shift=shift)

    types = dict(df.dtypes)
    return counts.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "shift double"])).where("shift IS NOT NULL")


def shapiro(df, keys, v):
    """W, p and rejection per cell."""

    def run(pdf):
        w, p = shapiro_w(pdf[v].to_numpy(float))
        return pdf[list(keys)].head(1).assign(W=w, p=p, rejected=bool(p < 0.05))

    types = dict(df.dtypes)
    return df.select(*keys, v).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", W double, p double, rejected boolean")


def adjust_p(df, keys, p):
    """Bonferroni, Benjamini-Hochberg and monotone Holm within keys; null p are left out of the count."""
    some = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*keys).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*keys))
    rows = some.withColumn("_k", F.row_number().over(w)).withColumn("_m", m)
    up = Window.partitionBy(*keys).orderBy("_k")
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(up.rowsBetween(0, Window.unboundedFollowing)))
    holm = F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*df.columns, F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias("bonferroni"), bh.alias("bh"), holm.alias("holm"))


def bootstrap_ci(df, keys, order, v, replicates=200, seed=1):
    """Percentile interval of the mean; null values take no part."""
    means = bootstrap_means(df, keys, order, v, replicates, seed)
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(q[0].alias("lo"), q[1].alias("hi"))


def normal_ppf(p: Column) -> Column:
    """Normal quantile: a logistic start and five Newton steps, each bound to a variable so that the expression stays small."""
    step = lambda z, _: z - (normal_cdf(z) - p) / (F.exp(-z * z / 2) * 0.3989422804014327)
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.log(p / (1 - p)) * 0.5887, step)


def bootstrap_bca(df, keys, order, v, replicates=200, seed=1):
    """Bias-corrected interval; acceleration from closed-form leave-one-out means."""
    base = df.groupBy(*keys).agg(F.avg(v).alias("m0"), F.count("*").alias("n"))
    jack = df.join(base, list(keys)).withColumn("_d", (F.col(v) - F.col("m0")) / (F.col("n") - 1))
    acc = jack.groupBy(*keys).agg((F.sum(F.pow("_d", 3)) / F.nullif(6 * F.pow(F.sum(F.pow("_d", 2)), 1.5), F.lit(0.0))).alias("a"))
    means = bootstrap_means(df, keys, order, v, replicates, seed).join(base, list(keys))
    below = means.groupBy(*keys).agg(F.avg((F.col("m") < F.col("m0")).cast("double")).alias("share"), F.sort_array(F.collect_list("m")).alias("ms"))
    s = below.join(acc, list(keys)).withColumn("z0", normal_ppf(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("share")))))
    at = lambda z: F.col("z0") + (F.col("z0") + z) / (1 - F.coalesce("a", F.lit(0.0)) * (F.col("z0") + z))
    shares = F.transform(F.array(at(-1.959964), at(1.959964)), normal_cdf)
    place = lambda p: F.greatest(F.lit(1), F.least(F.size("ms"), F.ceil(p * F.size("ms")).cast("int")))
    ends = F.transform(shares, lambda p: F.element_at("ms", place(p)))
    return s.select(*keys, ends.alias("_e")).select(*keys, F.col("_e")[0].alias("lo"), F.col("_e")[1].alias("hi"))


def cliff_delta_ci(df, keys, group, a, b, v, replicates=100, seed=1):
    """Percentile interval of Cliff's delta over resamples of both groups."""
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return resampled_deltas(df, keys, group, a, b, v, replicates, seed).groupBy(*keys).agg(q[0].alias("lo"), q[1].alias("hi"))


def permutation_test(df, keys, group, order, v, replicates=200, seed=1):
    """T = sum of |group mean - grand mean|; p = (1 + shuffles with T at least as large) / (B + 1)."""
    seen = df.where(F.col(v).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum(v).cast("double").alias("s")).select(*keys, F.lit(0).alias("b"), "n", "s")
    made = permuted_group_sums(df, keys, group, order, v, replicates, seed).select(*keys, "b", "n", "s")
    every = Window.partitionBy(*keys, "b")  # groups of a replicate
    rows = seen.unionByName(made).withColumn("g", F.sum("s").over(every) / F.sum("n").over(every))
    t = rows.groupBy(*keys, "b").agg(F.round(F.sum(F.abs(F.col("s") / F.col("n") - F.col("g"))), 12).alias("T"))
    one = t.where("b = 0").select(*keys, F.col("T").alias("_t"))
    more = _join(t, one, keys).groupBy(*keys).agg(F.max("_t").alias("T"), F.count_if((F.col("b") > 0) & (F.col("T") >= F.col("_t"))).alias("_more"))
    return more.select(*keys, "T", ((F.col("_more") + 1) / (replicates + 1)).alias("p"))


def t_ci(df, keys, v):
    """Half width of the 95 % interval of the mean."""
    s = describe_cells(df, keys, v).where("n >= 2")
    return s.select(*keys, "mean", "n", (t_crit((F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt("n")).alias("half"))


def required_n(df, keys, v, target: float, most: int = 300):
    """Smallest n whose half width at the cell's deviation is within target (at most 300)."""
    n = df.sparkSession.range(2, most + 1).select(F.col("id").alias("_n")).withColumn("_c", t_crit((F.col("_n") - 1).cast("double")) / F.sqrt("_n"))
    s = describe_cells(df, keys, v).where("std IS NOT NULL")
    return s.join(F.broadcast(n), F.col("_c") * F.col("std") <= target).groupBy(*keys).agg(F.min("_n").alias("required_n"))


def subsets(spark, seeds: Sequence[int], k: int, most: int = 400) -> DataFrame:
    """subset, seed: all k-subsets of the seeds, or an even stride through them beyond `most`."""
    every = list(combinations(sorted(seeds), k))
    step = max(1, -(-len(every) // most))
    return spark.createDataFrame([(i, s) for i, c in enumerate(every[::step]) for s in c], "subset int, seed int")


def sigma_rank(df, keys, group, seed_col, v, subs):
    """Deviation of each group's rank by mean over seed subsets; mean and largest over groups."""
    m = df.join(F.broadcast(subs.withColumnRenamed("seed", seed_col)), seed_col).groupBy(*keys, "subset", group).agg(F.avg(v).alias("m"))
    r = m.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "subset").orderBy(F.desc("m"), group)))
    s = r.groupBy(*keys, group).agg(F.stddev_pop("r").alias("s"))
    return s.groupBy(*keys).agg(F.avg("s").alias("mean_sigma"), F.max("s").alias("max_sigma"))


def ci_width_by_k(df, keys, order, v, most, replicates=100, seed=1):
    """Width of the bootstrap interval from the first k of each replicate's draws."""
    d = first_draws(df, keys, order, v, most, replicates, seed)
    w = Window.partitionBy(*keys, "b").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    m = d.withColumn("m", F.avg("v").over(w)).withColumn("k", F.col("j") + 1)
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return m.groupBy(*keys, "k").agg((q[1] - q[0]).alias("width"))


def running_adequacy(df, keys, order, v, flat: float = 0.01):
    """Running mean in order, and whether its last three values lie within `flat`."""
    w = Window.partitionBy(*keys).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, order, F.row_number().over(w).alias("n"), F.avg(v).over(up).alias("mean"), F.stddev_samp(v).over(up).alias("std"))
    last = w.rowsBetween(-2, 0)
    return rows.withColumn("flat", (F.col("n") >= 3) & (F.round(F.max("mean").over(last) - F.min("mean").over(last), 9) <= flat))


def adequacy(df, keys, order, v, flat: float = 0.01, target: float = 0.05, chance: float = 0.5, chance_upper: float = 0.6, replicates: int = 2000, seed: int = 1):
    """Whether each key has enough values, judged at its last one: n, mean, half (of the 95 % t interval), flat, upper, adequate.

    Above the chance level a key is adequate if its interval is narrow and its
    running mean flat; else if the upper end of the resampled mean lies under
    chance_upper. Keys with one value have no half width and no verdict.
    """
    ran = running_adequacy(df, keys, order, v, flat).groupBy(*keys).agg(F.max_by(F.struct("n", "mean", "std", "flat"), F.col("n")).alias("_l")).select(*keys, "_l.*")
    half = t_crit((F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt("n")
    upper = bootstrap_ci(df, keys, [order], v, replicates, seed).select(*keys, F.col("hi").alias("upper"))
    out = _join(ran.withColumn("half", half), upper, keys)
    good = F.when(F.col("mean") > chance, (F.col("half") <= target) & F.col("flat")).otherwise(F.col("upper") < chance_upper)
    return out.select(*keys, "n", "mean", "half", "flat", "upper", F.when(F.col("n") > 1, good).alias("adequate"))


def domain_gap(df, keys, level, inside, outside, block, v):
    """Mean and deviation of out - in over common blocks."""
    m = df.groupBy(*keys, block).pivot(level, [inside, outside]).agg(F.avg(v)).withColumn("gap", F.col(outside) - F.col(inside)).where("gap IS NOT NULL")
    return m.groupBy(*keys).agg(F.avg("gap").alias("gap"), F.stddev_samp("gap").alias("std"), F.count("*").alias("n"))


def best_condition(df, keys, group, v):
    """Group with the highest mean per cell, the first name on ties."""
    m = df.groupBy(*keys, group).agg(F.round(F.avg(v), 9).alias("m"))
    w = Window.partitionBy(*keys).orderBy(F.desc("m"), group)
    return m.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*keys, F.col(group).alias("best"), "m")


def mean_rank(df, keys, group, v):
    """Average over cells of each group's descending rank by mean."""
    m = df.groupBy(*keys, group).agg(F.round(F.avg(v), 9).alias("m")).withColumn("_m", -F.col("m"))
    return tie_rank(m, keys, "_m").groupBy(group).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("cells"))


def kendall_w(df, block, item, v):
    """Concordance of the ranks that complete blocks give items."""
    rows = complete_blocks(df, [], block, item, v)
    r = tie_rank(rows, [block], v).groupBy(item).agg(F.sum("rank").alias("R"), F.count("*").alias("m"))
    return r.agg((12 * F.var_pop("R") * F.count("*") / (F.pow(F.max("m"), 2) * (F.pow(F.count("*"), 3) - F.count("*")))).alias("w"), F.max("m").alias("m"), F.count("*").alias("n"))


def spearman(df, keys, a, b):
    """Pearson correlation of tie ranks."""
    r = tie_rank(tie_rank(df, keys, a, "_ra"), keys, b, "_rb")
    return r.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


#: Rows of a block of the inversion count, and blocks of a cell along each axis: larger cells have larger blocks.
TAU_BLOCK, TAU_BLOCKS = 1 << 16, 512


def _tau_places(counts, keys, value, block, name):
    """Block of each value of a cell in order, by rows before it; a value with more rows than a block is (odd) block of its own; and its tied pairs."""
    t = counts.groupBy(*keys, value).agg(F.sum("_w").alias("_t"), F.max("_n").alias("_n"))
    size = F.greatest(F.lit(block).cast("long"), F.ceil(F.col("_n") / TAU_BLOCKS))
    before = F.sum("_t").over(Window.partitionBy(*keys).orderBy(value)) - F.col("_t")
    return t.select(*keys, value, (2 * F.floor(before / size) + (F.col("_t") > size).cast("long")).alias(name), (F.col("_t") * (F.col("_t") - 1) / 2).alias("_pairs"))


def kendall_tau(df, keys, a, b, block=TAU_BLOCK):
    """Tau-b by counting inversions in n log n; rows with a null take no part, cells of one row have no tau.

    Rows are cut into blocks along a and along b. Discordant pairs in one block
    of a, and pairs of one block of b in different ones of a, are counted in
    tasks of a block; pairs apart in both come from the grid of block counts.
    A value of many rows is a block by itself and needs no task.
    """
    keys = list(keys)
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.count("*").alias("_w"))
    size = counts.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * (F.col("_w") - 1) / 2).alias("_both")).where("_n > 1")
    counts = _join(counts, size, keys)
    px, py = (_tau_places(counts, keys, c, block, n) for c, n in (("_x", "_bx"), ("_y", "_by")))
    rows = counts.join(px.drop("_pairs"), [*keys, "_x"]).join(py.drop("_pairs"), [*keys, "_y"])
    kind = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "d long"])
    out = lambda pdf, d: pdf[keys].head(1).assign(d=d)

    def inside(pdf):  # pairs of one block of a
        o = np.lexsort((pdf["_y"], pdf["_x"]))
        return out(pdf, inversions(pdf["_y"].to_numpy()[o], pdf["_w"].to_numpy()[o]))

    def across(pdf):  # pairs of one block of b in different blocks of a
        o = np.lexsort((pdf["_y"], pdf["_bx"]))
        return out(pdf, inversions(pdf["_y"].to_numpy()[o], pdf["_w"].to_numpy()[o]))

    def apart(pdf):
        return out(pdf, grid_inversions(*(pdf[c].to_numpy() for c in ("_bx", "_by", "_w"))))

    large = rows.where(F.col("_n") > block)
    found = rows.where("_bx % 2 = 0").groupBy(*keys, "_bx").applyInPandas(inside, schema)
    found = found.unionByName(large.where("_by % 2 = 0").groupBy(*keys, "_by").applyInPandas(across, schema))
    found = found.unionByName(large.groupBy(*keys, "_bx", "_by").agg(F.sum("_w").alias("_w")).groupBy(*keys).applyInPandas(apart, schema))
    zero = F.lit(0.0)
    parts = [size.select(*keys, (F.col("_n") * (F.col("_n") - 1) / 2).alias("n0"), F.col("_both").alias("n3")), found.select(*keys, F.col("d").cast("double").alias("d")), px.select(*keys, F.col("_pairs").alias("n1")), py.select(*keys, F.col("_pairs").alias("n2"))]
    terms = parts[0]
    for part in parts[1:]:
        terms = terms.unionByName(part, allowMissingColumns=True)
    terms = terms.groupBy(*keys).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("n0", "n1", "n2", "n3", "d")))
    apart_x, apart_y = F.col("n0") - F.col("n1"), F.col("n0") - F.col("n2")
    return terms.select(*keys, ((apart_x - F.col("n2") + F.col("n3") - 2 * F.col("d")) / F.nullif(F.sqrt(apart_x * apart_y), zero)).alias("tau"))


def linear_fit(df, keys, x, y):
    """Slope, intercept and correlation."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def _effects(marginals: DataFrame, factors: Sequence[str], keys: Sequence[str], most: int) -> DataFrame:
    """Sums of squares of each effect up to order `most`, by inclusion and exclusion of marginal sums n m^2.

    With subset sums Q(S) = sum over its cells of n * mean^2, the effect of S is
    sum over T in S of (-1)^(|S|-|T|) Q(T): only 2^factors numbers are combined.
    """
    q = marginals.groupBy(*keys, "gid").agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    k = len(factors)
    gid = {frozenset(c): sum(1 << (k - 1 - i) for i in range(k) if factors[i] not in c) for r in range(k + 1) for c in combinations(factors, r)}
    wide = q.groupBy(*keys).agg(*(F.max(F.when(F.col("gid") == g, F.col("q"))).alias(f"_q{g}") for g in gid.values()))
    rows = []
    for r in range(1, most + 1):
        for c in combinations(factors, r):
            ss = sum(((-1) ** (r - len(t)) * F.col(f"_q{gid[frozenset(t)]}") for n in range(r + 1) for t in combinations(c, n)), F.lit(0.0))
            rows.append(F.struct(F.lit(":".join(c)).alias("effect"), F.lit(r).alias("order"), ss.alias("ss")))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("e")).select(*keys, "e.*")


def sobol(df, factors: Sequence[str], v, keys: Sequence[str] = (), weight: str | None = None, most: int | None = None):
    """Effect, order, ss, share of the total sum of squares, by one cube over the factors.

    Marginal means are weighted by rows (or a weight column), so on unbalanced
    grids effects need not sum to the total.
    """
    w = F.col(weight) if weight else F.lit(1)
    base = df.select(*keys, *factors, w.alias("_w"), F.col(v).alias("_v"))
    if keys:
        cubes = base.groupingSets([[*(F.col(k) for k in keys), *(F.col(f) for f in c)] for r in range(len(factors) + 1) for c in combinations(factors, r)], *keys, *factors)
    else:
        cubes = base.cube(*factors)
    bits = sum(F.grouping(f) * (1 << (len(factors) - 1 - i)) for i, f in enumerate(factors))
    marginals = cubes.agg(bits.alias("gid"), F.sum("_w").alias("n"), (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("m"))
    total = base.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("_v") * F.col("_v")) - F.pow(F.sum(F.col("_w") * F.col("_v")), 2) / F.sum("_w")).alias("_sst"))
    e = _effects(marginals, factors, keys, most or len(factors))
    return _join(e, total, keys).select(*keys, "effect", "order", "ss", (F.col("ss") / F.nullif(F.col("_sst"), F.lit(0.0))).alias("s"))


def sobol_total(effects: DataFrame, factors: Sequence[str]) -> DataFrame:
    """First-order and total index of each factor."""
    f = F.explode(F.array(*map(F.lit, factors)))
    rows = effects.withColumn("factor", f).where(F.array_contains(F.split("effect", ":"), F.col("factor")))
    return rows.groupBy("factor").agg(F.max(F.when(F.col("order") == 1, F.col("s"))).alias("s1"), F.sum("s").alias("st"))


def bootstrap_sobol(df, factors, v, block, replicates=50, seed=1):
    """Percentile interval of first-order indices over resampled blocks; blocks are summed once per cell."""
    cells = df.groupBy(*factors, block).agg(F.avg(v).alias("_m"))
    blocks = df.select(block).distinct()
    w = Window.orderBy(block)  # one row per block
    named = blocks.withColumn("_i", F.row_number().over(w) - 1)
    n = F.broadcast(blocks.agg(F.count("*").alias("_n")))
    slots = named.join(n).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    weights = slots.withColumn("_p", F.floor(hash_uniform(seed, F.col("b"), F.col("_i")) * F.col("_n"))).groupBy("b", F.col("_p").alias("_i")).agg(F.count("*").alias("_k")).join(named, "_i").select("b", block, "_k")
    s = sobol(cells.join(weights, block), factors, "_m", ["b"], "_k", 1)
    q = F.percentile("s", F.array(F.lit(0.025), F.lit(0.975)))
    return s.groupBy("effect").agg(q[0].alias("lo"), q[1].alias("hi"))


def coverage(df, keys, cells, block):
    """Least and most blocks over the sub-cells of each key, empty sub-cells counting 0.

    A key lacks a sub-cell if it has fewer of them than there are: no grid of
    keys and sub-cells is formed.
    """
    n = df.groupBy(*keys, *cells).agg(F.count_distinct(block).alias("b"))
    every = df.select(*cells).distinct().agg(F.count("*").alias("_all"))  # one row
    found = n.groupBy(*keys).agg(F.min("b").alias("_least"), F.max("b").alias("most"), F.count("*").alias("_c")).join(F.broadcast(every))
    return found.select(*keys, F.when(F.col("_c") < F.col("_all"), F.lit(0).cast("long")).otherwise(F.col("_least")).alias("least"), "most")


def closed_sets(patterns: dict[int, int], columns: int) -> dict[int, int]:
    """Close-by-one over bitsets: each column set that is all that some rows have in common, with the number of those rows.

    patterns: rows by the bits of the columns they have.
    """
    distinct = list(patterns.items())
    full, out = (1 << columns) - 1, {}

    def closure(of):
        common = full
        for bits, _ in of:
            common &= bits
        return common

    stack = [(closure(distinct), distinct, 0)] if distinct else []
    while stack:
        bits, rows, start = stack.pop()
        out[bits] = sum(n for _, n in rows)
        for j in range(start, columns):
            if not bits >> j & 1:
                some = [p for p in rows if p[0] >> j & 1]
                if some:
                    more = closure(some)
                    # Each set is met once: from its own first columns only.
                    if (more ^ bits) & ((1 << j) - 1) == 0:
                        stack.append((more, some, j + 1))
    return out


def largest_rectangle(cover, row, col, least, most_columns: int = 62):
    """Columns, rows, area of the largest block of rows that have `least` blocks in all of a column set.

    Ties: the first by the columns' names. Rows are counted by their set of
    columns (a bitset) in Spark, so equal rows are one; the closed sets are
    searched among those. At most most_columns columns, else an error.
    """
    names = [r[0] for r in cover.select(col).distinct().orderBy(col).limit(most_columns + 1).collect()]
    if len(names) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    bit = F.create_map(*(x for i, c in enumerate(names) for x in (F.lit(c), F.lit(1 << i).cast("long")))) if names else F.create_map()
    ok = cover.where(F.col("least") >= least).select(row, col).distinct().groupBy(row).agg(F.bit_or(F.element_at(bit, F.col(col))).alias("bits"))
    patterns = {r["bits"]: r["n"] for r in ok.groupBy("bits").agg(F.count("*").alias("n")).collect()}
    sets = [(",".join(map(str, (c for i, c in enumerate(names) if bits >> i & 1))), n, n * bits.bit_count()) for bits, n in closed_sets(patterns, len(names)).items() if bits]
    best = sorted(sets, key=lambda s: (-s[2], s[0]))[:1]
    return cover.sparkSession.createDataFrame(best, "columns string, rows long, area long")


def min_detectable(df, keys, v, z: float = 1.959964):
    """Z / sqrt(n)."""
    return df.groupBy(*keys).agg((F.lit(z) / F.sqrt(F.count(v))).alias("mdd"))


def compare_to_baseline(df, keys, block, group, base, v):
    """T, d, W and means against the baseline on common blocks, per cell and condition."""
    p = paired(df, keys, block, group, base, v)
    by = [*keys, group]
    means = p.groupBy(*by).agg(F.avg("value").alias("mean"), F.avg("base_value").alias("base_mean"))
    return paired_t(p, by, "value", "base_value").drop("n").withColumnRenamed("p", "p_t").join(wilcoxon(p, by, "value", "base_value").withColumnRenamed("p", "p_w"), by).join(means, by)


def compare_intervals(df, keys, block, group, base, v, replicates: int = 2000, seed: int = 1):
    """Percentile intervals of the mean of each condition and of the baseline, on their common blocks."""
    p = paired(df, keys, block, group, base, v)
    by = [*keys, group]
    order = [block, "value", "base_value"]  # a block may hold several pairs
    own = bootstrap_ci(p, by, order, "value", replicates, seed)
    other = bootstrap_ci(p, by, order, "base_value", replicates, seed).withColumnsRenamed({"lo": "base_lo", "hi": "base_hi"})
    return own.join(other, by)


def ci_overlap(df, group, base, v, z: float = 1.959964):
    """Normal intervals of the mean, and whether they lie apart from the baseline's."""
    s = describe_cells(df, [group], v)
    half = z * F.col("std") / F.sqrt("n")
    s = s.select(group, (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))
    b = F.broadcast(s.where(F.col(group) == base).select(F.col("lo").alias("bl"), F.col("hi").alias("bh")))
    return s.join(b).select(group, "lo", "hi", ((F.col("lo") > F.col("bh")) | (F.col("hi") < F.col("bl"))).alias("separable"))


def multiseed_confusion(df, keys):
    """Sum, mean and deviation of counts over seeds; null keys are cells too."""
    return df.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("tn", "fp", "fn", "tp") for n, f in (("sum", F.sum), ("mean", F.avg), ("std", F.stddev_samp))))


def ratio_sensitivity(one, other, keys, group, base, v):
    """Per cell, whether two grids agree on the best group, and the change of its mean."""
    a, b = best_condition(one, keys, group, v), best_condition(other, keys, group, v)
    both = a.join(b.select(*keys, F.col("best").alias("best2"), F.col("m").alias("m2")), list(keys))
    return both.select(*keys, (F.col("best") == F.col("best2")).alias("same"), (F.col("m2") - F.col("m")).alias("change"))


def tradeoff(df, keys, group, base, recall, precision):
    """Cells where a group gains recall and loses precision beyond a negligible Cliff's delta."""
    names = [r[0] for r in df.select(group).distinct().where(F.col(group) != base).orderBy(group).collect()]  # a few conditions
    out = None
    for g in names:
        d = lambda v, n: mann_whitney(df, keys, group, g, base, v).select(*keys, F.col("delta").alias(n))  # noqa: B023, E731
        one = d(recall, "d_recall").join(d(precision, "d_precision"), list(keys)).withColumn(group, F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("tradeoff", (F.col("d_recall") > 0.147) & (F.col("d_precision") < -0.147))


def rank_reversal(df, mode, blocks, group, v):
    """Spearman correlation between modes of the groups' mean ranks over blocks."""
    m = df.groupBy(mode, *blocks, group).agg(F.avg(v).alias("_v"))
    r = tie_rank(m, [mode, *blocks], "_v").groupBy(mode, group).agg(F.round(F.avg("rank"), 9).alias("r"))
    a, b = r.select(F.col(mode).alias("a"), group, F.col("r").alias("ra")), r.select(F.col(mode).alias("b"), group, F.col("r").alias("rb"))
    return spearman(a.join(b, group).where("a < b"), ["a", "b"], "ra", "rb")


def sobol_pairwise(df, factors, v):
    """First and second order shares, pair terms and the residual not below 0."""
    s = sobol(df, factors, v, most=2)
    clipped = s.select("effect", "order", F.when(F.col("order") == 2, F.greatest("s", F.lit(0.0))).otherwise(F.col("s")).alias("s"))
    rest = clipped.agg(F.greatest(F.lit(0.0), 1 - F.sum("s")).alias("s")).select(F.lit("residual").alias("effect"), F.lit(0).alias("order"), "s")
    return clipped.unionByName(rest)


def ofat_lines(df, factor, others, v):
    """Each combination of the other factors is a line; mean and deviation of its values over lines."""
    lines = df.groupBy(*others, factor).agg(F.avg(v).alias("m"))
    return lines.groupBy(factor).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.count("*").alias("lines"))


def block_means(df, keys, v):
    """J40."""
    return df.groupBy(*keys).agg(F.avg(v).alias(v))
