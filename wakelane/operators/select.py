"""Feature scoring and selection (2.H) over a long table (f, v, y)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakelane.operators.metrics import roc_auc


def class_stats(df: DataFrame, keys: Sequence[str] = ("f",)) -> DataFrame:
    """Counts, means and variances of both classes per feature, in one pass."""
    side = lambda k: F.when(F.col("y") == k, F.col("v"))
    out = []
    for k in (0, 1):
        out += [F.count(side(k)).alias(f"n{k}"), F.avg(side(k)).alias(f"m{k}"), F.var_pop(side(k)).alias(f"p{k}"), F.var_samp(side(k)).alias(f"s{k}")]
    return df.groupBy(*keys).agg(*out, F.corr("v", "y").alias("corr"), F.covar_samp("v", "y").alias("cov"), F.stddev_pop("v").alias("sv"), F.stddev_pop("y").alias("sy"))


def feature_indices(df: DataFrame, variant: str = "filter") -> DataFrame:
    """H1-H3 per feature: fisher, correlation, t. Variant `filter` or `index` (the two definitions in use)."""
    s = class_stats(df)
    gap = F.col("m1") - F.col("m0")
    if variant == "filter":
        cols = [(gap * gap / (F.col("p0") + F.col("p1") + 1e-10)).alias("fisher"), F.coalesce(F.abs(F.nanvl("corr", F.lit(0.0))), F.lit(0.0)).alias("correlation"), F.abs(gap / F.sqrt(F.col("s1") / F.col("n1") + F.col("s0") / F.col("n0"))).alias("t")]
    else:
        cols = [(F.abs(gap) / (F.col("s1") + F.col("s0") + 1e-6)).alias("fisher"), (F.col("cov") / (F.col("sv") * F.col("sy") + 1e-12)).alias("correlation"), (F.abs(gap) / F.sqrt(F.col("s1") / F.col("n1") + F.col("s0") / F.col("n0") + 1e-6)).alias("t")]
    return s.select("f", *cols)


def mutual_information(df: DataFrame, bins: int = 0) -> DataFrame:
    """H4: nats between a feature and the label, on raw values or (bins > 0) equal-frequency bins."""
    if bins:
        q = df.groupBy("f").agg(F.percentile("v", F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("_q"))
        df = df.join(q, "f").withColumn("v", F.size(F.filter("_q", lambda x: x <= F.col("v"))).cast("double")).drop("_q")
    joint = df.groupBy("f", "v", "y").agg(F.count("*").alias("c"))
    by_v = F.sum("c").over(Window.partitionBy("f", "v"))
    by_y = F.sum("c").over(Window.partitionBy("f", "y"))
    n = F.sum("c").over(Window.partitionBy("f"))
    rows = joint.select("f", "c", by_v.alias("a"), by_y.alias("b"), n.alias("n"))
    return rows.groupBy("f").agg(F.greatest(F.lit(0.0), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("a") * F.col("b"))))).alias("mi"))


def feature_index_table(df: DataFrame, bins: int = 8) -> DataFrame:
    """H5: the four indices, each scaled to 0-1 over features (0 if they hardly differ)."""
    t = feature_indices(df).join(mutual_information(df, bins), "f")
    names = ["fisher", "correlation", "t", "mi"]
    ends = F.broadcast(t.agg(*(g(c).alias(f"_{k}_{c}") for c in names for k, g in (("a", F.min), ("b", F.max)))))
    span = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}")
    return t.join(ends).select("f", *(F.when(span(c) < 1e-10, 0.0).otherwise((F.col(c) - F.col(f"_a_{c}")) / span(c)).alias(c) for c in names))


def anova_f(df: DataFrame, k: int | None = None) -> DataFrame:
    """H6: F of each feature over the classes of y; the k best with their rank."""
    g = df.groupBy("f", "y").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = g.groupBy("f").agg(F.sum("n").alias("N"), F.count("*").alias("c"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("s")).alias("within"))
    between = F.col("q") - F.col("N") * F.col("gm") * F.col("gm")
    out = t.select("f", (between / (F.col("c") - 1) / (F.col("within") / (F.col("N") - F.col("c")))).alias("f_stat"))
    if k is None:
        return out
    best = Window.orderBy(F.desc("f_stat"), "f")  # one row per feature
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: H9: levels L, M, H of each index code 0, 1, 2; rule weight by their sum.
RULES = [(c, 1.0 if sum(c) >= 6 else 0.5 if sum(c) >= 3 else 0.0) for c in product(range(3), repeat=4)]


def fuzzy_importance(indices: DataFrame, params: Sequence[tuple[float, float]] = ((0.0, 0.2), (0.5, 0.2), (1.0, 0.2))) -> DataFrame:
    """H9: weighted mean of 81 product rules over Gaussian memberships; selected above 0.5, all if none is."""
    names = ["fisher", "correlation", "t", "mi"]
    member = lambda c, k: F.exp(-0.5 * F.pow((F.col(c) - params[k][0]) / (abs(params[k][1]) + 1e-10), 2))
    m = indices.select("f", *(member(c, k).alias(f"{c}{k}") for c in names for k in range(3)))
    # A sum of products over all combinations factorises by the level sum: a convolution over the four indices.
    sums = {0: F.lit(1.0)}
    for c in names:
        step: dict = {}
        for total, value in sums.items():
            for k in range(3):
                term = value * F.col(f"{c}{k}")
                step[total + k] = step[total + k] + term if total + k in step else term
        sums = step
    fire = sum(sums[k] for k in range(1, 9)) + sums[0]
    weighted = sum(sums[k] for k in (6, 7, 8)) + 0.5 * sum(sums[k] for k in (3, 4, 5))
    out = m.select("f", (weighted / (fire + 1e-10)).alias("importance"))
    top = F.broadcast(out.agg(F.max("importance").alias("_top")))
    return out.join(top).select("f", "importance", ((F.col("importance") > 0.5) | (F.col("_top") <= 0.5)).alias("selected"))


def univariate_auc(df: DataFrame) -> DataFrame:
    """max(AUC, 1 - AUC) of each feature."""
    return roc_auc(df, ["f"], "y", "v").select("f", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
