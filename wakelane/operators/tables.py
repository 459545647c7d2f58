"""Tables of results for reports (2.L): grids brought together, pivots, comparisons, orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a rebalancing ratio is shown at the end of a condition's name.
RATIO_TAGS = {0.1: "r01", 0.5: "r05"}


def load_grid(*parts: DataFrame, condition: str = "condition", ratio: str | None = None, tags: Mapping[float, str] = RATIO_TAGS, where: Mapping[str, Sequence] | None = None) -> DataFrame:
    """L2: result rows of several sources as one grid.

    Columns that a source lacks are null. Where a source has the ratio column,
    its conditions are named <condition>_<tag> (ratios without a tag: by the
    number itself). `where` keeps the rows with one of the listed values, by
    column; rows with a null there go.
    """
    out = None
    for part in parts:
        if ratio and ratio in part.columns:
            tag = F.col(ratio).cast("string")
            for value, name in tags.items():
                tag = F.when(F.col(ratio) == value, name).otherwise(tag)
            part = part.withColumn(condition, F.when(tag.isNull(), F.col(condition)).otherwise(F.concat(condition, F.lit("_"), tag))).drop(ratio)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for column, values in (where or {}).items():
        out = out.where(F.col(column).isin(*values))
    return out


def summary_table(df: DataFrame, row: str | Sequence[str], column: str, values: Sequence, v: str) -> DataFrame:
    """L3: per row and listed column value, mean, deviation and number: <value>_mean, <value>_std, <value>_n (null where there is none)."""
    return df.groupBy(*_list(row)).pivot(column, list(values)).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(F.lit(1)).alias("n"))


def comparison_table(df: DataFrame, rows: Sequence[str], column: str, base, other, v: str) -> DataFrame:
    """L4: means of two column values side by side, and other - base (null where one is missing)."""
    m = df.groupBy(*rows).pivot(column, [base, other]).agg(F.avg(v))
    return m.withColumn("delta", F.col(f"`{other}`") - F.col(f"`{base}`"))


def improvement_summary(comparison: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """Per key, how many comparisons improved, tied and got worse, and the mean and median change; nulls are left out."""
    some = comparison.where(F.col(delta).isNotNull())
    count = lambda c: F.count_if(c)
    return some.groupBy(*keys).agg(count(F.col(delta) > 0).alias("improved"), count(F.col(delta) == 0).alias("tied"), count(F.col(delta) < 0).alias("worse"), F.avg(delta).alias("mean"), F.median(delta).alias("median"))


def read_test_row(df: DataFrame, keys: Sequence[str], split: str, order: str, test="test") -> DataFrame:
    """The row of each key that is of the test split, else its last one by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce(F.col(split) == F.lit(test), F.lit(False))), F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def source_target_pivot(df: DataFrame, row: str | Sequence[str], column: str, source, target, metrics: Sequence[str]) -> DataFrame:
    """Means of the metrics under source and target: <value>_<metric>."""
    aggs = [F.avg(m).alias(m) for m in metrics]
    out = df.groupBy(*_list(row)).pivot(column, [source, target]).agg(*aggs)
    # With one metric Spark names the columns by the values alone.
    return out if len(aggs) > 1 else out.withColumnsRenamed({str(v): f"{v}_{metrics[0]}" for v in (source, target)})


def pooled_table(df: DataFrame, row: str | Sequence[str], v: str, column: str | None = None, values: Sequence = ()) -> DataFrame:
    """Mean, deviation and number of each row over all else, and if a column is named the mean under each of its listed values."""
    keys = _list(row)
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))
    if column is None:
        return out
    wide = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).pivot(column, list(values)).agg(F.avg(v))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return out.join(wide, same).drop(*(f"_k{i}" for i in range(len(keys))))


def ranking_table(df: DataFrame, row: str, cells: Sequence[str], v: str, best: int | None = None) -> DataFrame:
    """Place of each row by its mean within each cell (1 is best; ties by name), on demand the `best` first of each cell."""
    m = df.groupBy(*cells, row).agg(F.round(F.avg(v), 9).alias("m"))
    out = m.withColumn("place", F.row_number().over(Window.partitionBy(*cells).orderBy(F.desc("m"), row)))
    return out if best is None else out.where(F.col("place") <= best)


def ordered_sort(df: DataFrame, column: str, order: Sequence, then: Sequence[str] = (), place: str = "place") -> DataFrame:
    """Rows by the place of their value in a stated order, values outside it last, then by other columns; the place is added."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column)) - 1 if order else F.lit(-1)
    at = F.when(F.coalesce(at, F.lit(-1)) < 0, len(order)).otherwise(at).cast("int")
    return df.withColumn(place, at).orderBy(place, *then)


def _list(c: str | Sequence[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)
