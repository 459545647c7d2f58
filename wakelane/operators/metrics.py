"""Curves, thresholds and metrics of scored rows (2.I), per group where keys are given.

Scores are aggregated by value first, so curves and ranks cost one shuffle of
rows and one of distinct scores; nothing needs all rows of a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.functions.columns import safe_div


def by_score(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """keys, score, n, pos, and tp, fp from the highest score down, totals P and N."""
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    got = counts.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum(F.col("n") - F.col("pos")).over(down))
    return got.withColumn("np", F.sum("pos").over(whole)).withColumn("nn", F.sum(F.col("n") - F.col("pos")).over(whole))


def roc_curve(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Thr, fpr, tpr at each distinct score."""
    return by_score(df, keys, y, score).select(*keys, F.col("score").alias("thr"), (F.col("fp") / F.col("nn")).alias("fpr"), (F.col("tp") / F.col("np")).alias("tpr"))


def roc_auc(df: DataFrame, keys: Sequence[str], y: str, score: str, flip: bool = False) -> DataFrame:
    """Area by tie ranks; flip turns areas below 0.5 round and says so; null with one class."""
    c = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    s = c.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))
    inverted = auc < 0.5
    return s.select(*keys, (F.when(inverted, 1 - auc).otherwise(auc) if flip else auc).alias("auc"), (inverted if flip else F.lit(False)).alias("inverted"))


def pr_curve(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Thr, precision, recall at each distinct score, score ties together."""
    return by_score(df, keys, y, score).select(*keys, F.col("score").alias("thr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), safe_div(F.col("tp"), F.col("np")).alias("recall"))


def average_precision(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Sum of precision times gain in recall."""
    c = by_score(df, keys, y, score)
    return c.groupBy(*keys).agg(F.sum(F.col("pos") / F.nullif(F.col("np"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("auc_pr"))


def counts(df: DataFrame, keys: Sequence[str], y: str, pred: Column) -> DataFrame:
    """tn, fp, fn, tp."""
    t, p = F.col(y) == 1, pred
    return df.groupBy(*keys).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def rates() -> list[Column]:
    """Accuracy, precision, recall, specificity, F1, F2, error; 0 where undefined (F2 null)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return [
        safe_div(tn + tp, tn + fp + fn + tp).alias("accuracy"), p.alias("precision"), r.alias("recall"), safe_div(tn, tn + fp).alias("specificity"),
        safe_div(2 * p * r, p + r).alias("f1"), F.when(4 * p + r > 0, 5 * p * r / F.nullif(4 * p + r, F.lit(0.0))).alias("f2"), safe_div(fp + fn, tn + fp + fn + tp).alias("mse"),
    ]


def classification_metrics(df: DataFrame, keys: Sequence[str], y: str, pred: Column) -> DataFrame:
    """I8-I10, I14."""
    c = counts(df, keys, y, pred)
    return c.select(*keys, "tn", "fp", "fn", "tp", *rates())


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    t = df.groupBy(F.col(y).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(y) == F.col(pred)).alias("hit"))
    g = df.groupBy(F.col(pred).alias("class")).agg(F.count("*").alias("guessed"))
    rows = t.join(g, "class", "full").fillna(0)
    p, r = safe_div(F.col("hit"), F.col("guessed")), safe_div(F.col("hit"), F.col("support"))
    return rows.select("class", p.alias("precision"), r.alias("recall"), safe_div(2 * p * r, p + r).alias("f1"), "support")


def precision_at_min_recall(df, keys, y, score, least: float = 0.7) -> DataFrame:
    """Best precision among thresholds with recall >= least; the end point (1, 0) counts if least is 0."""
    c = pr_curve(df, keys, y, score)
    best = F.max(F.when(F.col("recall") >= least, F.col("precision")))
    return c.groupBy(*keys).agg((F.lit(1.0) if least <= 0 else F.coalesce(best, F.lit(0.0))).alias("precision"))


def best_threshold_pr(df, keys, y, score, beta: float = 1.0) -> DataFrame:
    """Threshold with the highest F-beta, the lowest one on ties."""
    b = beta * beta
    f = (1 + b) * F.col("precision") * F.col("recall") / (b * F.col("precision") + F.col("recall") + 1e-8)
    c = pr_curve(df, keys, y, score).withColumn("f", F.round(f, 12))
    best = F.max(F.struct("f", (-F.col("thr")).alias("t"))).alias("b")
    return c.groupBy(*keys).agg(best).select(*keys, (-F.col("b.t")).alias("thr"), F.col("b.f").alias("fbeta"))


def best_threshold_grid(df, keys, y, score, points: int = 1001, beta: float = 1.0) -> DataFrame:
    """Best of an even grid over 0-1 (score >= t), the lowest on ties; scores are bucketed, never copied per point."""
    step = 1.0 / (points - 1)
    k = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor(F.col(score) / step + 1e-9))).cast("int")
    c = df.withColumn("_k", k).groupBy(*keys, "_k").agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("tp", F.sum("pos").over(down)).withColumn("all", F.sum("n").over(down)).withColumn("np", F.sum("pos").over(Window.partitionBy(*keys)))
    b = beta * beta
    f = F.round(safe_div((1 + b) * F.col("tp"), b * F.col("np") + F.col("all")), 12)
    # F changes only at filled buckets; the lowest point with the same rows lies after the next lower bucket.
    low = Window.partitionBy(*keys).orderBy("_k")
    c = c.withColumn("t", F.coalesce(F.lag("_k").over(low) + 1, F.lit(0))).withColumn("f", f)
    best = F.max(F.struct("f", (-F.col("t")).alias("t"))).alias("b")
    return c.groupBy(*keys).agg(best).select(*keys, (-F.col("b.t") * step).alias("thr"), F.col("b.f").alias("fbeta"))


def score_spread(df, keys, score, at: float = 0.5) -> DataFrame:
    """Population deviation of scores and share predicted positive."""
    return df.groupBy(*keys).agg(F.stddev_pop(score).alias("sigma"), F.avg((F.col(score) >= at).cast("int")).alias("positive_rate"))


def subject_metrics(df, subject: str, y: str, pred: Column) -> DataFrame:
    """I16: metrics per subject, those without positives left out."""
    return classification_metrics(df, [subject], y, pred).where("tp + fn > 0")


def ensemble(long: DataFrame, row: str, score: str, weight: str, at: float = 0.5) -> DataFrame:
    """Majority, any, mean and weighted mean over models."""
    hit = (F.col(score) >= at).cast("int")
    return long.groupBy(row).agg((F.sum(hit) > F.count("*") / 2).alias("majority"), (F.max(hit) == 1).alias("any_positive"), F.avg(score).alias("mean"), (F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("weighted"))


def trial_convergence(df, keys, order: str, value: str) -> DataFrame:
    """Best so far, gain over ten trials, mean of the last five."""
    w = Window.partitionBy(*keys).orderBy(order)
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("best", best).withColumn("gain", F.col("best") - F.lag("best", 10).over(w)).withColumn("rolling", F.avg(value).over(w.rowsBetween(-4, 0)))


def mean_roc(curves: DataFrame, keys: Sequence[str], curve: str, points: int = 501) -> DataFrame:
    """Mean and deviation over curves of tpr interpolated at even fpr; (0, 0) begins and (1, 1) ends each.

    Each stretch between two points of a curve writes the grid points inside
    it, so no curve is joined to the whole grid.
    """
    ends = curves.select(*keys, curve).distinct()
    pts = curves.select(*keys, curve, "fpr", "tpr").unionByName(ends.select("*", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))).unionByName(ends.select("*", F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))
    pts = pts.groupBy(*keys, curve, "fpr").agg(F.max("tpr").alias("tpr"))
    w = Window.partitionBy(*keys, curve).orderBy("fpr")
    seg = pts.withColumn("x1", F.lead("fpr").over(w)).withColumn("y1", F.lead("tpr").over(w))
    n = points - 1
    lo, hi = F.ceil(F.col("fpr") * n - 1e-9), F.coalesce(F.ceil(F.col("x1") * n - 1e-9) - 1, F.lit(n))
    grid = seg.where(lo <= hi).withColumn("k", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    x = F.col("k") / n
    y = F.when(F.col("x1").isNull(), F.col("tpr")).otherwise(F.col("tpr") + (F.col("y1") - F.col("tpr")) * (x - F.col("fpr")) / (F.col("x1") - F.col("fpr")))
    return grid.groupBy(*keys, "k").agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("sigma"))


def auc_trapezoid(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under stored (fpr, tpr) points from (0, 0)."""
    w = Window.partitionBy(*keys).orderBy("fpr", "tpr")
    x0, y0 = F.coalesce(F.lag("fpr").over(w), F.lit(0.0)), F.coalesce(F.lag("tpr").over(w), F.lit(0.0))
    return curves.withColumn("_a", (F.col("fpr") - x0) * (F.col("tpr") + y0) / 2).groupBy(*keys).agg(F.sum("_a").alias("auc"))


def threshold_compare(df, keys, y, score, fixed: float = 0.5) -> DataFrame:
    """F1 at the best grid threshold beside that at the fixed one."""
    best = best_threshold_grid(df, keys, y, score)
    at = classification_metrics(df, keys, y, F.col(score) >= fixed).select(*keys, F.col("f1").alias("f1_fixed"))
    return best.select(*keys, "thr", F.col("fbeta").alias("f1_best")).join(at, list(keys))


def confusion_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, false positive and false negative rates per cell."""
    s = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")))
    return s.select("*", safe_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), safe_div(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))
