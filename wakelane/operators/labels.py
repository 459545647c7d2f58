"""Labels (2.E): band ratios, bins, event ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.operators.joins import interval_join


def band_ratio(theta: Sequence[str], alpha: Sequence[str], beta: Sequence[str]) -> Column:
    """(mean theta + mean alpha) / mean beta over channels; alpha and beta of 0 become 1e-10."""
    mean = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs)
    filled = lambda c: F.when(c == 0, 1e-10).otherwise(c)
    return (mean(theta) + filled(mean(alpha))) / filled(mean(beta))


def trimmed(df: DataFrame, keys: Sequence[str], v: str, k: float = 3.0) -> DataFrame:
    """Rows within mean +- k population deviations of their series."""
    m, s = F.avg(v), F.stddev_pop(v)
    stats = df.groupBy(*keys).agg(m.alias("_m"), s.alias("_s"))
    return df.join(stats, list(keys)).where(F.abs(F.col(v) - F.col("_m")) <= k * F.col("_s")).drop("_m", "_s")


def bin_linear(df: DataFrame, keys: Sequence[str], v: str, name: str = "label") -> DataFrame:
    """1-9 by eight inner points of an even grid of ten between the trimmed extremes; degenerate series are 1."""
    fit = trimmed(df, keys, v).groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    rows = df.join(fit, list(keys), "left")
    step = (F.col("_hi") - F.col("_lo")) / 9
    passed = sum(((F.col(v) >= F.col("_lo") + step * k).cast("int") for k in range(1, 9)), F.lit(0))
    label = F.when(F.col("_lo").isNull() | (F.col("_hi") <= F.col("_lo")), 1).otherwise(F.coalesce(passed, F.lit(0)) + 1)
    return rows.select(*df.columns, label.cast("int").alias(name))


def bin_percentile(df: DataFrame, keys: Sequence[str], v: str, name: str = "label") -> DataFrame:
    """1-8 by the percentiles 200/9 ... 700/9 and 100/9 of the trimmed values; 9 never occurs."""
    points = [100.0 / 9 * k / 100 for k in range(1, 8)]
    fit = trimmed(df, keys, v).groupBy(*keys).agg(F.percentile(v, F.array(*map(F.lit, points))).alias("_q"))
    rows = df.join(fit, list(keys), "left")
    passed = sum(((F.col(v) >= F.col("_q")[k]).cast("int") for k in range(7)), F.lit(0))
    return rows.select(*df.columns, (F.coalesce(passed, F.lit(0)) + 1).cast("int").alias(name))


def event_ranges(events: DataFrame, keys: Sequence[str], span: DataFrame, before: float = 20.0, after: float = 10.0) -> DataFrame:
    """(keys, range_no, start, end, label): baseline, event, baseline around each event [t_start, t_end).

    Baselines of neighbours share their overlap at its midpoint; span holds
    t_min and t_max of each series.
    """
    w = Window.partitionBy(*keys).orderBy("t_start", "t_end")
    e = events.join(span, list(keys)).withColumn("_no", F.row_number().over(w)).withColumn("_p", F.lag("t_end").over(w)).withColumn("_n", F.lead("t_start").over(w))
    s, t = F.col("t_start"), F.col("t_end")
    pre = F.greatest(s - before, F.col("t_min"))
    ended = F.col("_p") + after
    pre = F.when(F.col("_p").isNull(), pre).otherwise(F.greatest(pre, F.least(ended, (ended + (s - before)) / 2)))
    post = F.least(t + after, F.col("t_max"))
    begins = F.col("_n") - before
    post = F.when(F.col("_n").isNull(), post).otherwise(F.least(post, F.greatest(begins, (post + begins) / 2)))
    parts = F.array(F.struct(pre.alias("start"), s.alias("end"), F.lit(0).alias("label"), F.lit(0).alias("k")), F.struct(s.alias("start"), t.alias("end"), F.lit(1).alias("label"), F.lit(1).alias("k")), F.struct(t.alias("start"), post.alias("end"), F.lit(0).alias("label"), F.lit(2).alias("k")))
    out = e.select(*keys, "_no", F.explode(parts).alias("r"))
    kept = (F.col("r.k") == 1) | (F.col("r.start") < F.col("r.end"))
    return out.where(kept).select(*keys, (F.col("_no") * 3 + F.col("r.k")).alias("range_no"), "r.start", "r.end", "r.label")


def label_by_events(rows: DataFrame, events: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """E5: rows inside some range with its label, others dropped."""
    span = rows.groupBy(*keys).agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"))
    return interval_join(rows, event_ranges(events, keys, span), t, keys, "start", "end", "label", "range_no")


def pad_or_truncate(rows: DataFrame, labels: DataFrame, keys: Sequence[str], idx: str, label: str) -> DataFrame:
    """Labels matched to rows by index: missing ones are null, surplus ones go."""
    return rows.join(labels.select(*keys, idx, label), [*keys, idx], "left")
