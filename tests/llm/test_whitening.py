"""Whitening against rational and numpy brute force: polynomial, roots, vectors, rows, ties and odd vectors."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from wakelane.llm import whitening as wh
from wakelane.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def poly(a):
    """det(t - A) by the Faddeev-LeVerrier recurrence in fractions, constant term first."""
    d = len(a)
    m, c = np.zeros((d, d), object), [Fraction(1)]
    eye = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a.dot(m) + c[-1] * eye
        c.append(-Fraction(a.dot(m).trace()) / k)
    return [int(v) for v in reversed(c)]


def scatter(rng, n, d, spread=300):
    x = rng.integers(-spread, spread, (n, d)).astype(object)
    s = x.sum(0)
    return n * x.T.dot(x) - np.outer(s, s)


@pytest.mark.parametrize("n, d", [(4, 1), (3, 5), (30, 4), (50, 9)])
def test_polynomial(spark, n, d):
    a = scatter(np.random.default_rng(n), n, d)
    assert wh.characteristic_polynomial(spark, a) == poly(a)


def test_polynomial_with_zero_pivots(spark):
    a = np.array([[2, 0, 0, 1], [0, 2, 0, 0], [0, 0, 5, 0], [1, 0, 0, 2]], object)
    assert wh.characteristic_polynomial(spark, a) == poly(a)
    assert wh.characteristic_polynomial(spark, np.zeros((3, 3), object)) == [0, 0, 0, 1]


def test_roots_with_multiplicity():
    c = [1]
    for r in (7, 7, 7, 3, 1, 0):
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    assert [wh.roots_above(c, x, 1) for x in (-1, 0, 1, 2, 6, 13, 14)] == [6, 5, 5, 4, 3, 3, 0]
    got = wh.largest_roots(c, 8, 18)
    assert [round(float(x), 12) for x in got] == [7, 7, 7, 3, 1]


def test_close_roots():
    c = [10**40 * 7 + 0, -(2 * 10**40 + 7 * 10**0), 10**0]  # roots far apart, the small one near 3.5
    got = wh.largest_roots(c, 2, 3 * 10**40)
    disc = Decimal(2 * 10**40 + 7) ** 2 - 4 * Decimal(7) * 10**40
    assert abs(got[0] / ((2 * 10**40 + 7 + disc.sqrt()) / 2) - 1) < Decimal(10) ** -25 and abs(float(got[1]) - 3.5) < 1e-12


def test_exact_sums_of_large_entries():
    rng = np.random.default_rng(5)
    for top in (300, 1 << 30, (1 << 62) + 12345):
        x = rng.integers(-top, top, (3000, 3))
        x[0] = -(1 << 63) if top > 1 << 40 else x[0]
        o = x.astype(object)
        assert (wh.gram(x) == o.T.dot(o)).all() and (wh.column_sums(x) == o.sum(0)).all()


def brute(rows, k=4):
    """vec_id -> (n, deviation, [(whitened up to sign, explained)])."""
    use = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in use}), float)
    n, mean = len(fit), fit.mean(0)
    e, vec = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    order = np.argsort(-e)[:k]
    s = [sum(c) for c in zip(*{tuple(x) for _, x in use})]
    return [(i, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x) - mean) @ vec[:, order] / np.sqrt(e[order]), e[order] / e.sum()) for i, x in use]


def check(df, rows, k=4):
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    want = brute(rows, k)
    signs = {}
    for i, n, deviation, whitened, explained in want:
        mine = sorted(got[i, deviation], key=lambda r: r.component)[:: max(1, len(got[i, deviation]) // k)]
        for j, r in enumerate(mine):
            assert r.n == n and r.component == j + 1 and abs(r.explained - explained[j]) < 1e-12 and r.identity_error < 1e-9
            if abs(whitened[j]) > 1e-6:
                sign = signs.setdefault(j, np.sign(r.whitened * whitened[j]))
                assert abs(r.whitened - sign * whitened[j]) < 1e-8
    assert sum(map(len, got.values())) == k * len(want)


def test_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 6)) * [3, 2, 1.5, 1, 0.5, 0.1]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(base)]
    rows += [*rows[:40], (None, rows[3][1], 1), (901, None, 0), (902, [], 0), (903, [1.0] * 5 + [float("nan")], 0), (904, [1.0] * 5 + [None], 0), (905, [1.0] * 5 + [float("inf")], 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = wh.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out, [r for r in rows if r[0] != 906])


def test_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert wh.whiten(make([])).count() == 0
    assert wh.whiten(make([(i, [1.0, 2.0], 0) for i in range(9)])).count() == 0
    line = wh.whiten(make([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    square = wh.whiten(make([(i, [float(a), float(b), 0.0], 0) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])])).collect()
    assert len(square) == 8 and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-12 for r in square)
    huge = wh.whiten(make([(0, [3e38, 1.0], 0), (1, [-3e38, 2.0], 0), (2, [0.0, 5.0], 0)])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id < 2} == {None} and all(r.identity_error < 1e-9 for r in huge)


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(QUERIES["op13_whitening"](spark, sf), rows)
