"""Joins (2.D): nearest in time, intervals, paired and missing cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, t: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every left row with the right row nearest in time; on a tie the earlier one, among equal times the last.

    Both sides are put into one sorted stream per key; windows give each left
    row its previous and next right row, so no range join is formed.
    """
    value = F.struct(F.col(t), *columns)
    a = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType))
    b = right.select(*keys, t, F.lit(0).alias("_side"), value.alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(t, F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_b", F.last("_r", ignorenulls=True).over(before)).withColumn("_a", F.first("_r", ignorenulls=True).over(after)).where("_side = 1")
    gap_b, gap_a = F.col(t) - F.col(f"_b.{t}"), F.col(f"_a.{t}") - F.col(t)
    best = F.when(F.col("_a").isNull() | (gap_b <= gap_a), F.col("_b")).otherwise(F.col("_a"))
    return found.withColumn("_n", best).select(*left.columns, F.col(f"_n.{t}").alias(f"{t}_right"), *(F.col(f"_n.{c}").alias(c) for c in columns))


def interval_join(rows: DataFrame, ranges: DataFrame, t: str, keys: Sequence[str], start: str, end: str, label: str, order: str) -> DataFrame:
    """Label of each row's range [start, end); where ranges overlap the last one by order wins; others are dropped.

    Equal rows have equal labels, so they are counted first, joined once and
    given back as often as they came.
    """
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("_times"))
    named = ranges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(label).alias("_label"), F.col(order).alias("_o"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col(t) >= F.col("_s"), F.col(t) < F.col("_e")]
    got = each.join(named, on)
    best = got.groupBy(*rows.columns, "_times").agg(F.max_by("_label", "_o").alias(label))
    return best.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*rows.columns, label)


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_right") -> DataFrame:
    """D3: rows of both sides with equal, non-null keys; columns of the right side that the left has, too, get the suffix."""
    return left.join(_renamed(left, right, keys, suffix), list(keys))


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_right", fill: Mapping[str, object] | None = None) -> DataFrame:
    """Every left row, with nulls (or `fill`, by column) where the right side has no equal key; names as in D3."""
    out = left.join(_renamed(left, right, keys, suffix), list(keys), "left")
    return out.fillna(dict(fill)) if fill else out


def _renamed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    taken = set(left.columns) - set(keys)
    return right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c in taken})


def paired(df: DataFrame, keys: Sequence[str], block: str, condition: str, base, value: str) -> DataFrame:
    """Values of each other condition next to the base's, on common cells and blocks."""
    a = df.where(F.col(condition) == F.lit(base)).select(*keys, block, F.col(value).alias("base_value"))
    b = df.where(F.col(condition) != F.lit(base)).select(*keys, block, condition, F.col(value).alias("value"))
    return b.join(a, [*keys, block])


def missing_cells(found: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Combinations of the factors' own values that have no row; factors are lists of a few values."""
    grid = None
    for f in factors:
        values = found.select(f).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    return grid.join(found.select(*factors).distinct(), list(factors), "left_anti")
