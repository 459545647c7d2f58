"""Pair counts, selections, closed sets and resampling by counts against plain versions."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelane.functions import draws, pairs
from wakelane.functions.tails import t_quantile
from wakelane.operators import resampling, stats


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (2, 2), (60, 5), (200, 1000)])
def test_inversions(n, top):
    rng = np.random.default_rng(n)
    v, w = rng.integers(0, top, n), rng.integers(1, 4, n)
    assert pairs.inversions(v, w) == sum(int(w[i] * w[j]) for i, j in itertools.combinations(range(n), 2) if v[i] > v[j])


def test_grid_inversions():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 9, 80) * 3, rng.integers(0, 7, 80) - 2, rng.integers(1, 5, 80)
    assert pairs.grid_inversions(x, y, w) == sum(int(w[i] * w[j]) for i in range(80) for j in range(80) if x[i] < x[j] and y[i] > y[j])


@pytest.mark.parametrize("n, m, digits", [(1, 1, 1), (2, 3, 0), (40, 31, 1), (33, 33, 9)])
def test_median_difference(n, m, digits):
    rng = np.random.default_rng(n)
    x, y = np.round(rng.normal(size=n), digits), np.round(rng.normal(size=m) * 3, digits)
    got = pairs.median_difference(*np.unique(x, return_counts=True), *np.unique(y, return_counts=True))
    assert got == pytest.approx(float(np.median(np.subtract.outer(x, y))), abs=1e-15)


def test_closed_sets():
    rng = np.random.default_rng(3)
    rows = [int(b) for b in rng.integers(0, 64, 12)]
    patterns = {b: rows.count(b) for b in rows}
    want = {}
    for k in range(1, 13):
        for some in itertools.combinations(rows, k):
            bits = 63
            for b in some:
                bits &= b
            want[bits] = sum(b & bits == bits for b in rows)
    assert stats.closed_sets(patterns, 6) == want


def test_rectangle_of_forty_columns(spark):
    rows = [(f"r{i}", f"c{j:02}", 1) for i in range(30) for j in range(40) if (i + j) % 7 or j < 12] + [("x", "c01", 0)]
    got = stats.largest_rectangle(spark.createDataFrame(rows, "r string, c string, least long"), "r", "c", 1).collect()
    has = [{j for j in range(40) if (i + j) % 7 or j < 12} for i in range(30)]
    kinds = [set.intersection(*(h for i, h in enumerate(has) if i % 7 in some)) for k in range(1, 8) for some in itertools.combinations(range(7), k)]
    best = max(len(c) * sum(c <= h for h in has) for c in kinds)
    assert len(got) == 1 and got[0].area == best


def test_draws_add_up_over_blocks():
    sizes, n = np.array([50, 50, 50, 7]), 157
    counts = np.stack([draws.drawn_counts(9, k, sizes, 4000, n) for k in range(4)])
    assert (counts.sum(0) == n).all() and np.abs(counts.mean(1) - sizes).max() < 0.5
    assert abs(counts[0].var() - n * 50 / 157 * 107 / 157) < 3
    groups = np.array([100, 57])
    parts = np.stack([draws.permuted_counts(9, k, sizes, 3000, groups) for k in range(4)])
    assert (parts.sum(0) == groups).all() and (parts.sum(2) == sizes[:, None]).all()
    assert np.abs(parts[:, :, 0].mean(1) - sizes * 100 / 157).max() < 0.3


def test_resampled_sums_and_weights():
    rng = np.random.default_rng(2)
    v = np.sort(np.round(rng.normal(size=300), 1))
    counts = np.full(500, 300)
    sums = draws.resampled_sums(77, counts, v)
    for b in (0, 7, 499):
        pick = (draws.hashes(77, np.full(300, b), np.arange(300)) * np.uint64(300) >> np.uint64(32)).astype(int)
        assert sums[b] == pytest.approx(v[pick].sum())
    value, times = np.unique(v, return_counts=True)
    w = draws.resampled_weights(77, counts, times, 0)
    assert w.shape == (500, len(value)) and (w.sum(1) == 300).all() and np.allclose(w @ value, sums)
    assert np.abs(w.mean(0) - times).max() < 1


def test_permuted_sums_are_of_permutations():
    v = 2.0 ** np.arange(12)
    got = draws.permuted_sums(5, np.tile([3, 4, 5], (200, 1)), v).astype(int)
    assert (got.sum(1) == 4095).all() and ([[int(x).bit_count() for x in r] for r in got] == np.tile([3, 4, 5], (200, 1))).all()
    assert len({tuple(r) for r in got.tolist()}) > 190


def test_t_quantiles():
    for df, c in ((1, 12.7062), (2, 4.3027), (5, 2.5706), (10, 2.2281), (30, 2.0423), (120, 1.9799)):
        assert abs(t_quantile(df) - c) < 5e-5


def naive_tau(a, b):
    s = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i, j in itertools.combinations(range(len(a)), 2)]
    x, y, z = sum(p * p for p, _ in s), sum(q * q for _, q in s), sum(p * q for p, q in s)
    return z / np.sqrt(x * y) if x and y else None


@pytest.mark.parametrize("block", [1 << 16, 16, 5])
def test_kendall_tau(spark, block):
    rng = np.random.default_rng(4)
    cells = {g: (np.round(rng.normal(size=n), d), np.round(rng.normal(size=n), d)) for g, (n, d) in enumerate([(150, 1), (90, 0), (40, 9), (2, 9), (1, 1), (30, 0)])}
    cells[5] = (np.zeros(30), cells[5][1])
    rows = [(g, float(x), float(y)) for g, (a, b) in cells.items() for x, y in zip(a, b)] + [(0, None, 1.0), (0, 1.0, None)]
    rows += [(0, 0.25, float(k % 7)) for k in range(60)]  # a value of many rows
    a0 = np.r_[cells[0][0], np.full(60, 0.25)], np.r_[cells[0][1], np.arange(60) % 7.0]
    got = {r.g: r.tau for r in stats.kendall_tau(spark.createDataFrame(rows, "g int, p double, q double"), ["g"], "p", "q", block).collect()}
    want = {0: naive_tau(*a0)} | {g: naive_tau(*c) for g, c in cells.items() if g in (1, 2, 3, 5)}
    assert set(got) == set(want) and all(got[g] == (w if w is None else pytest.approx(w, abs=1e-12)) for g, w in want.items())


def test_large_cells_finish(spark):
    t = time.time()
    one = spark.range(100_000).select(F.lit(1).alias("g"), F.rand(1).alias("p"), (F.rand(1) + F.rand(2)).alias("q")).cache()
    tau = stats.kendall_tau(one, ["g"], "p", "q", 1 << 13).first().tau
    assert 0.4 < tau < 0.6 and stats.kendall_tau(one, [], "p", "p").first().tau == pytest.approx(1)
    two = one.select("g", F.explode(F.array(F.struct(F.lit("a").alias("k"), (F.col("p") + 0.25).alias("v")), F.struct(F.lit("b").alias("k"), F.col("q").alias("v")))).alias("s")).select("g", "s.*")
    shift = stats.hodges_lehmann(two, ["g"], "k", "a", "b", "v").first()["shift"]
    assert abs(shift + 0.25) < 0.01 and time.time() - t < 120


def values(spark, n=900):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(("a", "b", "c")[i % 3], i, float(x)) for i, x in enumerate(rng.normal(size=n) + np.arange(n) % 3)], "k string, i int, v double").repartition(5)


def test_blocks_change_draws_but_not_their_law(spark):
    rows = values(spark)
    for block in (1 << 14, 100):
        m = resampling.bootstrap_means(rows, [], ["i"], "v", 1500, 3, block).agg(F.avg("m").alias("m"), F.stddev("m").alias("s"), F.count("*").alias("n")).first()
        mean, sd = rows.agg(F.avg("v"), F.stddev_pop("v")).first()
        assert m.n == 1500 and abs(m.m - mean) < 0.01 and abs(m.s / (sd / 30) - 1) < 0.08
        d = resampling.resampled_deltas(rows, [], "k", "a", "b", "v", 1000, 3, block).agg(F.avg("delta").alias("m"), F.stddev("delta").alias("s"), F.count("*").alias("n")).first()
        true = stats.mann_whitney(rows, [], "k", "a", "b", "v").first().delta
        assert d.n == 1000 and abs(d.m - true) < 0.01 and 0.02 < d.s < 0.06
        s = resampling.permuted_group_sums(rows, [], "k", ["i"], "v", 800, 3, block)
        by = s.groupBy("g").agg(F.avg(F.col("s") / F.col("n")).alias("m"), F.stddev(F.col("s") / F.col("n")).alias("d"), F.count("*").alias("n")).collect()
        assert len(by) == 3 and all(r.n == 800 and abs(r.m - mean) < 0.02 and abs(r.d / (sd * (1 / 300 - 1 / 900) ** 0.5) - 1) < 0.12 for r in by)


def test_deltas_equal_pairs_in_each_replicate(spark):
    """One value per block of its own: a replicate's delta is that of the drawn values."""
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 5, 9)] + [("b", float(x)) for x in (2, 3, 5, 5)], "k string, v double")
    got = [r.delta for r in resampling.resampled_deltas(rows, [], "k", "a", "b", "v", 50, 8).orderBy("b").collect()]
    base = int(rows.select(resampling.base_of(8, [])).first()[0])
    a, b = np.array([1, 2, 2, 5, 9.0]), np.array([2, 3, 5, 5.0])
    for r in range(50):
        x = a[(draws.hashes(base, np.full(5, r), np.arange(5)) * np.uint64(5) >> np.uint64(32)).astype(int)]
        y = b[(draws.hashes(int(draws.mix(np.array([base + 1], np.uint64))[0]), np.full(4, r), np.arange(4)) * np.uint64(4) >> np.uint64(32)).astype(int)]
        assert got[r] == pytest.approx(np.sign(np.subtract.outer(x, y)).mean())


def test_replicates_of_a_million_rows(spark):
    t = time.time()
    rows = spark.range(1_000_000).select("id", F.rand(3).alias("v"))
    m = resampling.bootstrap_means(rows, [], ["id"], "v", 2000, 3).agg(F.stddev("m").alias("s"), F.count("*").alias("n")).first()
    assert m.n == 2000 and abs(m.s / (12**-0.5 / 1000) - 1) < 0.08 and time.time() - t < 300


def test_empty_cells(spark):
    none = spark.createDataFrame([], "k string, i int, v double")
    assert stats.bootstrap_ci(none, ["k"], ["i"], "v", 20).count() == 0
    assert stats.permutation_test(none, [], "k", ["i"], "v", 20).where("T IS NOT NULL").count() == 0
    assert stats.cliff_delta_ci(none, [], "k", "a", "b", "v", 20).where("lo IS NOT NULL").count() == 0
    assert stats.kendall_tau(none, ["k"], "i", "v").count() == 0 and stats.hodges_lehmann(none, ["k"], "k", "a", "b", "v").count() == 0
