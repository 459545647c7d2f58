"""Class rebalancing (2.G). Draws are P2 hashes; neighbours come from the blocked exact join P4."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakelane.functions.columns import hash_order, hash_uniform
from wakelane.operators.clean import normal_draw
from wakelane.operators.primitives import knn_join, numbered


def class_sizes(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """keys, lo (rows of the minority, label 1) and hi (of the majority, label 0)."""
    return df.groupBy(*keys).agg(F.count_if(F.col(y) == 1).alias("_lo"), F.count_if(F.col(y) == 0).alias("_hi"))


def _with(df: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(sizes, list(keys)) if keys else df.join(F.broadcast(sizes))


def random_undersample(df: DataFrame, y: str, key: str, ratio: float, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Keeps int(minority / ratio) majority rows with the smallest hashes; per key where keys are given."""
    majority = numbered(df.where(F.col(y) == 0).withColumn("_h", hash_order(seed, key)), keys, ["_h", key], "_place")
    rows = _with(majority, class_sizes(df, keys, y), keys)
    kept = rows.where((F.col("_lo") == 0) | (F.col("_place") <= F.floor(F.col("_lo") / ratio)))
    return df.where(F.col(y) == 1).unionByName(kept.select(*df.columns))


def interpolate(a: str, b: str, u: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + u * (q - p))


def _near(source: DataFrame, minority: DataFrame, k: int, id_col: str, vec_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, parent and _near: its k nearest minority rows, nearest first."""
    near = knn_join(source, minority, k, id_col, vec_col, keys)
    return near.groupBy(*keys, F.col("query_id").alias("parent")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s.id).alias("_near"))


def smote(df: DataFrame, y: str, ratio: float, seed: int, k: int = 5, id_col: str = "id", vec_col: str = "vec", keys: Sequence[str] = (), parents: DataFrame | None = None) -> DataFrame:
    """New minority rows until minority is int(majority * ratio): keys, n, parent, neighbour, vec.

    New row n has parent number n modulo the minority's size in hash order, one
    of its min(k, minority - 1) neighbours, and a place between them, drawn by
    (seed, n). Groups with fewer than two minority rows get none.
    """
    minority = df.where(F.col(y) == 1)
    source = minority if parents is None else parents
    near = _near(source, minority, k, id_col, vec_col, keys)
    sizes = class_sizes(df, keys, y).withColumn("_new", F.floor(F.col("_hi") * ratio).cast("long") - F.col("_lo")).where("_new > 0 AND _lo >= 2")
    ranked = numbered(source.select(*keys, F.col(id_col).alias("parent"), F.col(vec_col).alias("_a"), hash_order(seed, id_col).alias("_h")), keys, ["_h", "parent"], "_place").drop("_h")
    rows = _with(_with(ranked, source.groupBy(*keys).agg(F.count("*").alias("_m")), keys), sizes, keys).join(near, [*keys, "parent"])
    made = rows.where("_place <= _new").withColumn("n", F.explode(F.sequence(F.col("_place").cast("long"), F.col("_new"), F.col("_m").cast("long"))))
    label = [F.col(c) for c in keys]
    pick = F.floor(hash_uniform(seed + 1, *label, F.col("n")) * F.size("_near")).cast("int") + 1
    chosen = made.withColumn("neighbour", F.element_at("_near", pick)).withColumn("_u", hash_uniform(seed + 2, *label, F.col("n")))
    other = minority.select(*keys, F.col(id_col).alias("neighbour"), F.col(vec_col).alias("_b"))
    return chosen.join(other, [*keys, "neighbour"]).select(*keys, "n", "parent", "neighbour", interpolate("_a", "_b", F.col("_u")).alias(vec_col))


def danger(df: DataFrame, y: str, m: int = 10, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Minority rows with at least half, but not all, of m neighbours in the majority."""
    near = knn_join(df.where(F.col(y) == 1), df, m, id_col, vec_col).join(df.select(F.col(id_col).alias("id"), F.col(y).alias("_y")), "id")
    hard = near.groupBy("query_id").agg(F.count_if(F.col("_y") == 0).alias("_c"), F.count("*").alias("_n")).where("2 * _c >= _n AND _c < _n")
    return df.join(hard.select(F.col("query_id").alias(id_col)), id_col, "left_semi")


def borderline_smote(df: DataFrame, y: str, ratio: float, seed: int, **names) -> DataFrame:
    """G2 with parents in danger only."""
    return smote(df, y, ratio, seed, parents=danger(df, y, **names), **names)


def adasyn_counts(df: DataFrame, y: str, ratio: float, k: int = 5, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """How many new rows each minority row gets: its share of majority neighbours among all shares."""
    near = knn_join(df.where(F.col(y) == 1), df, k, id_col, vec_col).join(df.select(F.col(id_col).alias("id"), F.col(y).alias("_y")), "id")
    share = near.groupBy(F.col("query_id").alias(id_col)).agg(F.avg((F.col("_y") == 0).cast("int")).alias("share"))
    need = F.broadcast(class_sizes(df, [], y).select((F.floor(F.col("_hi") * ratio) - F.col("_lo")).alias("_g")))
    total = F.broadcast(share.agg(F.sum("share").alias("_s")))
    return share.join(need).join(total).select(id_col, "share", F.round(F.col("share") / F.nullif(F.col("_s"), F.lit(0.0)) * F.col("_g")).cast("long").alias("new_rows"))


def adasyn(df: DataFrame, y: str, ratio: float, seed: int, k: int = 5, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The new rows of adasyn_counts: parent, i (from 1 for each parent), neighbour, vec.

    A new row lies between its parent and one of the parent's k nearest minority
    rows; both the neighbour and the place are drawn by (seed, parent, i).
    """
    minority = df.where(F.col(y) == 1)
    made = adasyn_counts(df, y, ratio, k, id_col, vec_col).where("new_rows > 0").select(F.col(id_col).alias("parent"), F.explode(F.sequence(F.lit(1).cast("long"), "new_rows")).alias("i"))
    rows = made.join(_near(minority, minority, k, id_col, vec_col), "parent")
    pick = F.floor(hash_uniform(seed + 1, "parent", "i") * F.size("_near")).cast("int") + 1
    chosen = rows.select("parent", "i", F.element_at("_near", pick).alias("neighbour"), hash_uniform(seed + 2, "parent", "i").alias("_u"))
    side = lambda c, v: minority.select(F.col(id_col).alias(c), F.col(vec_col).alias(v))
    return chosen.join(side("parent", "_a"), "parent").join(side("neighbour", "_b"), "neighbour").select("parent", "i", "neighbour", interpolate("_a", "_b", F.col("_u")).alias(vec_col))


def tomek_links(df: DataFrame, y: str, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Rows without the majority members of mutual nearest neighbours of different classes."""
    near = knn_join(df, df, 1, id_col, vec_col).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    label = df.select(F.col(id_col).alias("_i"), F.col(y).alias("_y"))
    mutual = near.join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    pairs = mutual.join(label.select(F.col("_i").alias("a"), F.col("_y").alias("ya")), "a").join(label.select(F.col("_i").alias("b"), F.col("_y").alias("yb")), "b")
    return df.join(pairs.where("ya = 0 AND yb = 1").select(F.col("a").alias(id_col)), id_col, "left_anti")


def enn(df: DataFrame, y: str, k: int = 3, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Rows without the majority rows that have any neighbour of the other class."""
    near = knn_join(df.where(F.col(y) == 0), df, k, id_col, vec_col).join(df.select(F.col(id_col).alias("id"), F.col(y).alias("_y")), "id")
    return df.join(near.where("_y = 1").select(F.col("query_id").alias(id_col)).distinct(), id_col, "left_anti")


def with_smote(df: DataFrame, y: str, ratio: float, seed: int, id_col: str = "id", vec_col: str = "vec", after=None) -> DataFrame:
    """Rows and new rows (negative ids), then `after` (tomek_links, enn or an undersampling)."""
    new = smote(df, y, ratio, seed, id_col=id_col, vec_col=vec_col).select((-F.col("n")).alias(id_col), F.lit(1).alias(y), vec_col)
    both = df.select(id_col, y, vec_col).unionByName(new)
    return after(both) if after else both


def augment_minority(df: DataFrame, y: str, ratio: float, seed: int, sigma: float, method: str = "jitter", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Copies of minority rows up to int(majority * ratio), jittered by sigma times each
    component's deviation, scaled by N(1, sigma) per row, or both: n, parent, vec."""
    minority = df.where(F.col(y) == 1)
    sizes = class_sizes(df, [], y).withColumn("_new", F.floor(F.col("_hi") * ratio).cast("long") - F.col("_lo")).where("_new > 0")
    sd = minority.select(F.posexplode(vec_col)).groupBy("pos").agg(F.stddev_pop("col").alias("s")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda t: t.s).alias("_sd"))
    ranked = numbered(minority.select(F.col(id_col).alias("parent"), F.col(vec_col).alias("_v"), hash_order(seed, id_col).alias("_h")), [], ["_h", "parent"], "_place").drop("_h")
    rows = ranked.join(F.broadcast(sizes)).join(F.broadcast(sd)).where("_place <= _new")
    rows = rows.withColumn("n", F.explode(F.sequence(F.col("_place").cast("long"), F.col("_new"), F.col("_lo").cast("long"))))
    vec = F.col("_v")
    if method in ("jitter", "jitter_scale"):
        noise = F.transform(F.col("_sd"), lambda s, i: s * sigma * normal_draw(seed, F.col("n"), i))
        vec = F.zip_with(vec, noise, lambda a, b: a + b)
    if method in ("scale", "jitter_scale"):
        factor = 1 + sigma * normal_draw(seed + 7, F.col("n"))
        vec = F.transform(vec, lambda a: a * factor)
    return rows.select("n", "parent", vec.alias(vec_col))


def adaptive_sigma(long: DataFrame) -> DataFrame:
    """Median over features of |mean| / deviation, of deviation / |mean|, and of the class gap, as one row.

    snr: noise falls as the signal rises; cv: as spread over level; interclass:
    by the distance of the class means in deviations.
    """
    level = F.when(F.avg("v") == 0, 1e-10).otherwise(F.abs(F.avg("v")))
    spread = F.when(F.stddev_pop("v") == 0, 1e-10).otherwise(F.stddev_pop("v"))
    gap = F.abs(F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v"))))
    per = long.groupBy("f").agg((level / spread).alias("snr"), (spread / level).alias("cv"), (gap / spread).alias("d"))
    return per.agg(F.median("snr").alias("snr"), F.median("cv").alias("cv"), F.median("d").alias("interclass"))


def sigma_modes(long: DataFrame) -> DataFrame:
    """jitter_sigma and scale_sigma of each method (snr, cv, interclass, conservative), within fixed bounds.

    Null values take no part in a feature's moments. Without rows of both
    classes interclass is as snr.
    """
    one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    level = F.when(F.avg("v") == 0, 1e-10).otherwise(F.abs(F.avg("v")))
    spread = F.when(F.stddev_pop("v") == 0, 1e-10).otherwise(F.stddev_pop("v"))
    per = long.groupBy("f").agg((level / spread).alias("snr"), (spread / level).alias("cv"), F.pow(F.avg(one) - F.avg(zero), 2).alias("gap"), F.stddev_pop(one).alias("s1"), (F.stddev_pop(one) / (F.abs(F.avg(one)) + 1e-10)).alias("cv1"))
    s = per.agg(F.median("snr").alias("snr"), F.median("cv").alias("cv"), F.sqrt(F.sum("gap")).alias("gap"), F.avg("s1").alias("s1"), F.median("cv1").alias("cv1"))
    clip = lambda c, lo, hi: F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))
    jitter, scale = clip(0.1 / (1 + F.col("snr")), 0.005, 0.1), clip(F.col("cv") * 0.5, 0.02, 0.2)
    apart = clip(F.col("s1") / F.nullif(F.col("gap"), F.lit(0.0)) * 0.5, 0.005, 0.1)
    modes = {
        "snr": (jitter, scale),
        "cv": (clip(F.col("cv") * 0.1, 0.01, 0.1), clip(F.col("cv") * 0.3, 0.05, 0.2)),
        "interclass": (F.when(F.col("gap") == 0, 0.1).otherwise(F.coalesce(apart, jitter)), F.when(F.col("gap").isNull(), scale).otherwise(clip(F.col("cv1") * 0.3, 0.02, 0.15))),
        "conservative": (F.lit(0.01), F.lit(0.05)),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("method"), j.alias("jitter_sigma"), c.alias("scale_sigma")) for k, (j, c) in modes.items()))
    return s.select(F.inline(rows))


def augmentation_overlap(long: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """One row on new minority rows: mean_shift, std_change, overlap_score (mean distance to the minority's centre over that to the majority's).

    Both tables are in long form (f, v; y in the first, id_col in the second);
    without new rows all three are 0.
    """
    one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    centres = long.groupBy("f").agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.stddev_pop(one).alias("s1"))
    moved = new.groupBy("f").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).join(centres, "f")
    norm = lambda c: F.sqrt(F.sum(c * c))
    whole = moved.agg((norm(F.col("m") - F.col("m1")) / (norm(F.col("m1")) + 1e-10)).alias("a"), ((F.avg("s") - F.avg("s1")) / (F.avg("s1") + 1e-10)).alias("b"))
    far = new.join(centres, "f").groupBy(id_col).agg(norm(F.col("v") - F.col("m1")).alias("d1"), norm(F.col("v") - F.col("m0")).alias("d0"))
    ratio = far.agg((F.avg("d1") / (F.avg("d0") + 1e-10)).alias("c"))
    shown = [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("a", "mean_shift"), ("b", "std_change"), ("c", "overlap_score"))]
    return whole.join(F.broadcast(ratio)).select(*shown)


def augmentation_quality(long: DataFrame, new: DataFrame) -> DataFrame:
    """Per feature, shift of the mean and change of the deviation from rows to new rows."""
    s = lambda d, k: d.groupBy("f").agg(F.avg("v").alias(f"m{k}"), F.stddev_pop("v").alias(f"s{k}"))
    return s(long, 0).join(s(new, 1), "f").select("f", (F.col("m1") - F.col("m0")).alias("shift"), ((F.col("s1") - F.col("s0")) / F.nullif(F.col("s0"), F.lit(0.0))).alias("sigma_change"))


def domain_mixup(df: DataFrame, subject: str, y: str, seed: int, n: int, alpha: float = 0.2, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """N blends of two rows of different subjects; the weight is Beta(alpha, alpha), the label a draw by it.

    Row i of the first side is the row at hash place i, the partner the row at
    another place; partners of the same subject are left out.
    """
    rows = df.select(F.col(id_col).alias("i"), F.col(subject).alias("s"), F.col(y).alias("y"), F.col(vec_col).alias("v"))
    m = F.lit(n)
    a = rows.withColumn("k", F.floor(hash_uniform(seed, "i") * m))
    b = rows.withColumn("k", F.floor(hash_uniform(seed + 1, "i") * m))
    first = a.groupBy("k").agg(F.min_by(F.struct("i", "s", "y", "v"), "i").alias("a"))
    second = b.groupBy("k").agg(F.min_by(F.struct("i", "s", "y", "v"), "i").alias("b"))
    # Beta(alpha, alpha) by Johnk's ratio of powered uniforms.
    x, z = F.pow(hash_uniform(seed + 2, "k"), 1 / alpha), F.pow(hash_uniform(seed + 3, "k"), 1 / alpha)
    pairs = first.join(second, "k").where("a.s <> b.s").withColumn("w", F.coalesce(x / F.nullif(x + z, F.lit(0.0)), F.lit(0.5)))
    label = F.when(hash_uniform(seed + 4, "k") < F.col("w"), F.col("a.y")).otherwise(F.col("b.y"))
    mixed = F.zip_with("a.v", "b.v", lambda p, q: F.col("w") * p + (1 - F.col("w")) * q)
    return pairs.select("k", F.col("a.i").alias("first"), F.col("b.i").alias("second"), "w", label.alias("y"), mixed.alias(vec_col))


#: Groups in which partial matrices of all tasks are merged before the driver merges theirs.
MERGES = 32


def merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred products) of the union of several parts."""
    n, mean, m2 = parts[0]
    for k, mu, c in parts[1:]:
        gap, all_n = mu - mean, n + k
        m2 = m2 + c + np.outer(gap, gap) * (n * k / all_n)
        mean = mean + gap * (k / all_n)
        n = all_n
    return n, mean, m2


def covariance(df: DataFrame, vec_col: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance in one pass: each task makes a matrix product of its rows, centred.

    d x d numbers a task are shuffled, and MERGES such matrices reach the
    driver. An empty table is an error.
    """
    schema = "part int, n long, mean array<double>, m2 array<double>"

    def partial(batches):
        held = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                mean = x.mean(0)
                own = (len(x), mean, (x - mean).T @ (x - mean))
                held = merged([held, own]) if held else own
        if held:
            n, mean, m2 = held
            part = zlib.crc32(mean.tobytes()) % MERGES
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([m2.ravel().tolist()])], names=["part", "n", "mean", "m2"])

    def join(pdf):
        n, mean, m2 = merged([(int(n), np.asarray(mu), np.asarray(c).reshape(len(mu), -1)) for n, mu, c in zip(pdf["n"], pdf["mean"], pdf["m2"])])
        return pd.DataFrame({"part": pdf["part"][:1], "n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})

    rows = df.select(vec_col).mapInArrow(partial, schema).groupBy("part").applyInPandas(join, schema).collect()
    if not rows:
        raise ValueError("no rows to take a covariance of")
    n, mean, m2 = merged([(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(len(r["mean"]), -1)) for r in sorted(rows, key=lambda r: r["part"])])
    return mean, m2 / max(n - 1, 1)


def coral_align(source: DataFrame, target: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(x - ms) (Cs + I)^-1/2 (Ct + I)^1/2 + mt; the matrix is d x d, rows are mapped by a matrix product a batch."""
    (ms, cs), (mt, ct) = covariance(source, vec_col), covariance(target, vec_col)

    def power(c: np.ndarray, p: float) -> np.ndarray:
        w, v = np.linalg.eigh(c + np.eye(len(c)))
        return (v * np.maximum(w, 1e-12) ** p) @ v.T

    a = power(cs, -0.5) @ power(ct, 0.5)
    at = source.columns.index(vec_col)

    def run(batches):
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            y = (x - ms) @ a + mt if b.num_rows else x
            moved = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * len(mt), pa.array(y.ravel()))
            yield b.set_column(at, b.schema.names[at], moved)

    return source.mapInArrow(run, source.withColumn(vec_col, F.col(vec_col).cast("array<double>")).schema)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """N / (2 n_c) per class; 1 where only one class is there."""
    c = df.groupBy(y).agg(F.count("*").alias("_c"))
    t = F.broadcast(c.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k")))
    return c.join(t).select(y, F.when(F.col("_k") < 2, 1.0).otherwise(F.col("_n") / (2 * F.col("_c"))).alias("weight"))


def expected_class_counts(df: DataFrame) -> DataFrame:
    """Rows expected after each method from columns method, ratio, neg, pos."""
    neg, pos, ratio = F.col("neg"), F.col("pos"), F.col("ratio")
    over = F.greatest(pos, F.floor(neg * ratio))
    return df.select("*", F.when(F.col("method") == "rus", F.least(neg, F.floor(pos / ratio))).otherwise(neg).alias("expected_neg"), F.when(F.col("method").isin("smote", "adasyn", "borderline"), over).otherwise(pos).alias("expected_pos"))
