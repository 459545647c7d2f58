"""Exact top-k against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelane.llm import topk

SCHEMA = "vec_id long, embedding array<float>, q int, score string"


def brute(rows, queries, k):
    use = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i in sorted({i for i, _ in use if queries(i)}):
        q = next(v for j, v in use if j == i)
        best = sorted((-int(q @ v), j) for j, v in use if j != i and len(v) == len(q))[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def check(spark, rows, k=10, every=10):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k).collect()
    assert {tuple(r) for r in got} == brute(rows, lambda i: i % every == 0, k)
    assert len(got) == len({tuple(r) for r in got})


def test_random_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(0, [1.0, 2.0]), (10, None), (20, [nan, 1.0]), (30, [inf, 1.0]), (40, [None, 1.0]), (50, []), (60, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [-1.0, 0.5]), (70, [1.0])])


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_an_outlier_keeps_products_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(100, [1e5] * 8), (101, [-1e5, 3.0] * 4), (102, [99999.5, 1e5] * 4)]
    check(spark, rows)


def test_too_large_is_an_error(spark):
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e9], 1, "")], SCHEMA), F.col("vec_id") == 0)


def test_bounds_skip_rows_that_cannot_win():
    rng = np.random.default_rng(2)
    rows = np.floor(np.concatenate([rng.normal(size=(200, 4)) * 5 + 1000, rng.normal(size=(2000, 4)) * 5 - 1000]))
    top = (rows * rows).sum(1).max()
    pivots = topk.farthest_first(topk.lifted(rows, top), 8)
    table = topk.distances(topk.lifted(rows, top), pivots)
    search = topk.Search(np.array([0]), rows[:1], table[:1], top, 10)
    search.add(np.arange(len(rows)), rows, table)
    want = sorted((-float(rows[0] @ r), i) for i, r in enumerate(rows) if i)[:10]
    assert list(zip(search.best[0][0], search.best[0][1])) == [(-s, i) for s, i in want]
    assert search.evaluated < len(rows) / 2
