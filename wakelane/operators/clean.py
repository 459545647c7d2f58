"""Projection, filtering and cleaning (2.B)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakelane.functions.columns import hash_uniform

EEG_WORDS = ("Channel_", "EEG", "Theta", "Alpha", "Beta", "Gamma", "Delta")
LIMIT = 1e6


def clean_name(name: str) -> str:
    name = re.sub(r"[﻿\r\n]", "", name).strip()
    return re.sub(r"_+", "_", re.sub(r"[()\s]+", "_", name)).rstrip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """B1: byte-order marks and line ends go, spaces and parentheses become one underscore."""
    return df.toDF(*map(clean_name, df.columns))


def drop_eeg_columns(df: DataFrame) -> DataFrame:
    """B2: columns named after EEG channels or bands go."""
    return df.drop(*(c for c in df.columns if any(w in c for w in EEG_WORDS)))


def clean_features(df: DataFrame, ids: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Numeric columns other than ids."""
    return df.select(*(f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in ids))


def align_columns(df: DataFrame, expected: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Exactly the expected columns in order; missing ones are filled."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in expected))


def common_columns(*dfs: DataFrame) -> list[DataFrame]:
    """Each table cut to the columns of all, in the first one's order."""
    names = [c for c in dfs[0].columns if all(c in d.columns for d in dfs)]
    return [d.select(*names) for d in dfs]


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def fix_nonfinite(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Infinities and NaN become the column's mean (of fit_on, else of df), then +-1e6 bounds columns that exceed it."""
    stats = (fit_on if fit_on is not None else df).agg(*(F.avg(finite(c)).alias(f"_m_{c}") for c in columns))
    rows = df.join(F.broadcast(stats))  # one row
    return rows.select(*(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.coalesce(finite(c), F.col(f"_m_{c}")))).alias(c) if c in columns else c for c in df.columns))


def scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations."""
    return df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame, eps: float = 0.0) -> DataFrame:
    """(x - mean) / deviation of fit_on; constant columns stay centred; eps is added to the deviation."""
    rows = df.join(F.broadcast(scaler(fit_on, columns)))
    scaled = lambda c: (F.col(c) - F.col(f"_m_{c}")) / (F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) if not eps else F.col(f"_s_{c}") + eps)
    return rows.select(*(scaled(c).alias(c) if c in columns else c for c in df.columns))


def prepare_eval_features(df: DataFrame, expected: Sequence[str], fit_on: DataFrame) -> DataFrame:
    """Align, non-finite to 0, bound by 1e6, standardise with the training scaler."""
    rows = align_columns(df, expected)
    rows = rows.select(*(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.coalesce(finite(c), F.lit(0.0)))).alias(c) for c in expected))
    return standardize(rows, expected, fit_on)


def minmax_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame) -> DataFrame:
    """To 0-1 by the extremes of fit_on; constant columns become 0."""
    ends = fit_on.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))))
    rows = df.join(F.broadcast(ends))
    span = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}")
    return rows.select(*(F.when(span(c) == 0, 0.0).otherwise((F.col(c) - F.col(f"_a_{c}")) / F.nullif(span(c), F.lit(0.0))).alias(c) if c in columns else c for c in df.columns))


def outlier_interpolate(df: DataFrame, keys: Sequence[str], x: str, idx: str = "idx", k: float = 3.0) -> DataFrame:
    """Values outside mean +- k deviations are replaced on the line through their valid neighbours.

    Before the first and after the last valid point the line of the two nearest
    valid ones goes on; a series with fewer than two keeps null there.
    """
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    rows = df.join(stats, list(keys)).withColumn("_v", F.when(F.abs(F.col(x) - F.col("_m")) <= k * F.col("_s"), F.struct(F.col(idx).alias("i"), F.col(x).alias("x"))))
    near = Window.partitionBy(*keys).orderBy(idx)
    before, after = near.rowsBetween(Window.unboundedPreceding, 0), near.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_p", F.last("_v", True).over(before)).withColumn("_n", F.first("_v", True).over(after))
    valid = rows.where(F.col("_v").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    ends = valid.select(*keys, F.slice("_all", 1, 2).alias("_first"), F.slice("_all", -2, 2).alias("_last"), F.size("_all").alias("_c")).where("_c >= 2")
    rows = rows.join(ends, list(keys), "left")
    line = lambda a, b: a["x"] + (b["x"] - a["x"]) * (F.col(idx) - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
    filled = F.when(F.col("_v").isNotNull(), F.col(x)).when(F.col("_p").isNull(), line(F.col("_first")[0], F.col("_first")[1])).when(F.col("_n").isNull(), line(F.col("_last")[0], F.col("_last")[1])).otherwise(line(F.col("_p"), F.col("_n")))
    return rows.select(*(filled.alias(c) if c == x else c for c in df.columns))


def normal_draw(seed: int, *keys) -> Column:
    """A standard normal from two P2 uniforms (Box-Muller)."""
    u = F.greatest(hash_uniform(seed, *keys), F.lit(2.0**-33))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * hash_uniform(seed + 1, *keys))


def jitter(df: DataFrame, columns: Sequence[str], sigma: float, seed: int, key: str) -> DataFrame:
    """Adds N(0, sigma) noise, drawn by row key and column."""
    return df.select(*((F.col(c) + sigma * normal_draw(seed, F.lit(c), F.col(key))).alias(c) if c in columns else c for c in df.columns))


def filter_by_mode(df: DataFrame, targets: DataFrame, mode: str, key: str = "subject_id") -> DataFrame:
    """source_only leaves targets out, target_only and domain_train keep them, mixed and joint keep all."""
    if mode in ("mixed", "joint_train"):
        return df
    if mode not in ("source_only", "target_only", "domain_train"):
        raise ValueError(f"unknown mode {mode}")
    return df.join(targets.select(key).distinct(), key, "left_anti" if mode == "source_only" else "left_semi")


#: Pattern of each part of an experiment tag (fixed values of the tag format).
TAG_PARTS = {
    "ranking": r"(?:^|_)(knn|lof|median|mean|medoid|centroid_umap|isolation_forest)(?:_|$)",
    "distance": r"(?:^|_)(mmd|wasserstein|dtw)(?:_|$)",
    "level": r"(?:^|_)(in_domain|mid_domain|out_domain)(?:_|$)",
    "imbalance": r"(?:^|_)(subjectwise_smote|sw_smote|smote_tomek|smote_enn|smote_rus|smote|undersample_rus|rus|balanced_rf|easyensemble|baseline)(?:_|$)",
    "mode": r"(?:^|_)(source_only|target_only|mixed|domain_train)(?:_|$)",
    "seed": r"(?:^|_)s(\d+)(?:_|$)",
    "ratio": r"(?:^|_)ratio(\d+[._]\d+)(?:_|$)",
}


def parse_tag(tag: str) -> list[Column]:
    """One column per part of the tag; null where it has none."""
    part = {n: F.nullif(F.regexp_extract(tag, p, 1), F.lit("")) for n, p in TAG_PARTS.items()}
    part["seed"] = part["seed"].cast("int")
    part["ratio"] = F.replace(part["ratio"], F.lit("_"), F.lit(".")).cast("double")
    return [c.alias(n) for n, c in part.items()]


def binary_label(kss: str, event: str | None = None, keep_middle: bool = False) -> Column:
    """1-5 is 0, 8 and 9 are 1, 6 and 7 null (or 6 is 0 with keep_middle); an event label wins."""
    k = F.col(kss)
    label = F.when(k <= (6 if keep_middle else 5), 0).when(k >= 8, 1)
    return F.coalesce(F.col(event), label) if event else label
