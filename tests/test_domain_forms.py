"""Subject distances, clusters, alignments, cuts and shared models against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelane import registry
from wakelane.functions.columns import hash_order
from wakelane.operators import domain, manymodels, models, primitives, resample, split


def full_table(x, y):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(len(x)), range(len(y))):
        d[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return float(np.sqrt(d[-1, -1]))


def test_dtw_of_many_lengths(monkeypatch):
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=int(n)) for n in rng.integers(1, 40, 60)]
    ys = [rng.normal(size=int(n)) for n in rng.integers(1, 40, 60)]
    want = [full_table(x, y) for x, y in zip(xs, ys)]
    assert domain.dtw_many(xs, ys) == pytest.approx(want)
    monkeypatch.setattr(domain, "DTW_HELD", 100)
    assert domain.dtw_many(xs, ys) == pytest.approx(want)
    assert domain.dtw_many([np.array([]), np.array([2e6])], [np.array([1.0]), np.array([0.0])]) == [None, None]


def test_dtw_of_long_series():
    import time

    t, x = time.time(), np.random.default_rng(2).normal(size=(2, 1000))
    domain.dtw_many([x[0]], [x[1]])
    assert time.time() - t < 1


def test_pair_blocks_give_each_pair_once(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(50)], "s int, v double")
    out = primitives.pair_blocks(rows, "s", lambda p, i, j: {"d": p["v"].to_numpy()[j] - p["v"].to_numpy()[i]}, "d double", 7).collect()
    assert sorted((r.a, r.b) for r in out) == list(itertools.combinations(range(50), 2)) and all(r.d == r.b - r.a for r in out)


def test_mmd_of_pairs(spark):
    rng = np.random.default_rng(3)
    data = {s: rng.normal(size=(12, 3)) + s % 3 for s in range(20)}
    rows = spark.createDataFrame([(s, 100 * s + k, [float(c) for c in v]) for s, m in data.items() for k, v in enumerate(m)], "s int, id int, vec array<double>")
    got = {(r.a, r.b): r.d for r in domain.mmd(rows).collect()}
    assert len(got) == 190 and all(got[p] == pytest.approx(domain.mmd_of(data[p[0]], data[p[1]])) for p in got)


def test_isolation_forest_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(np.r_[rng.normal(size=(390, 3)), rng.normal(size=(10, 3)) + 9])], "id int, vec array<double>").repartition(5)
    trees, size = 6, 32
    vec = {r.id: r.vec for r in points.collect()}
    h = points.crossJoin(spark.range(trees).select(F.col("id").cast("int").alias("tree"))).select("tree", "id", hash_order(1, "tree", "id").alias("h")).collect()
    limit, total = 5, dict.fromkeys(vec, 0.0)

    def grow(x, r, depth):
        lo, hi = (x.min(0), x.max(0)) if len(x) else (0, 0)
        if depth >= limit or len(x) < 2 or not (hi > lo).any():
            return depth + domain.mean_path(len(x))
        f = int(r.choice(np.flatnonzero(hi > lo)))
        at = float(r.uniform(lo[f], hi[f]))
        return f, at, grow(x[x[:, f] < at], r, depth + 1), grow(x[x[:, f] >= at], r, depth + 1)

    for t in range(trees):
        chosen = sorted((x.h, x.id) for x in h if x.tree == t)[:size]
        root = grow(np.array(sorted(vec[i] for _, i in chosen)), np.random.default_rng([1, t]), 0)
        for i, v in vec.items():
            node = root
            while isinstance(node, tuple):
                node = node[2] if v[node[0]] < node[1] else node[3]
            total[i] += node
    got = {r.id: r.score for r in domain.isolation_forest_rank(points, trees, size).collect()}
    assert all(got[i] == pytest.approx(2 ** -(total[i] / trees / domain.mean_path(size)), abs=1e-12) for i in vec)
    assert min(got[i] for i in range(390, 400)) > np.median(list(got.values()))


def test_isolation_forest_of_few_rows(spark):
    few = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id int, vec array<double>")
    assert domain.isolation_forest_rank(few, 3, 16).count() == 5
    assert domain.isolation_forest_rank(few.limit(0), 3, 16).count() == 0


def test_connected_chain_in_few_rounds(spark):
    n, rng = 10_000, random.Random(5)
    names = list(range(n))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(n - 1) if i != 6000] + [(n + 1, n + 1), (n + 2, n + 3)]
    trace: list[int] = []
    got = {r.id: r.label for r in primitives.connected(spark.createDataFrame(edges, "a int, b int"), trace).collect()}
    assert len(trace) < 20
    a, b = min(names[:6001]), min(names[6001:])
    assert got == {**{x: a for x in names[:6001]}, **{x: b for x in names[6001:]}, n + 1: n + 1, n + 2: n + 2, n + 3: n + 2}


def plain_dbscan(p, eps, least):
    near = {i: [j for j in p if j != i and np.sqrt(((p[i] - p[j]) ** 2).sum()) <= eps] for i in p}
    core = {i for i in p if len(near[i]) >= least - 1}
    label = {}
    for i in sorted(core):
        todo = [i] if i not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += [y for y in near[x] if y in core]
    return {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in p}


@pytest.mark.parametrize("dims, eps", [(1, 0.05), (2, 0.3), (5, 1.2)])
def test_dbscan_over_points(spark, dims, eps, monkeypatch):
    monkeypatch.setattr(domain, "GRID_BLOCK", 16)
    rng = np.random.default_rng(dims)
    p = {i: v for i, v in enumerate(np.r_[rng.normal(size=(120, dims)), np.repeat(rng.normal(size=(1, dims)), 40, 0)])}
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in p.items()], "id int, vec array<double>")
    pairs = {(r.a, r.b) for r in domain.neighbours_within(rows, eps).collect()}
    assert pairs == {(i, j) for i, j in itertools.combinations(p, 2) if np.sqrt(((p[i] - p[j]) ** 2).sum()) <= eps}
    got = {r.s: r.cluster for r in domain.dbscan_points(rows, eps, 3).collect()}
    assert got == plain_dbscan(p, eps, 3) and None in got.values()


def test_dbscan_of_a_chain(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_000).alias("id"), F.array(F.col("id") * 0.9).alias("vec"))
    trace: list[int] = []
    got = domain.dbscan_points(rows, 1.0, 3, trace).agg(F.count_distinct("cluster").alias("c"), F.count("cluster").alias("n"), F.min("cluster").alias("m")).first()
    assert (got.c, got.n, len(trace) < 20) == (1, 10_000, True)


def test_covariance_and_alignment(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e4, rng.normal(size=(300, 5)) * 3
    rows = [spark.createDataFrame([(i, [float(c) for c in v], "k") for i, v in enumerate(m)], "id int, vec array<double>, z string").repartition(7) for m in (x, y)]
    mean, cov = resample.covariance(rows[0])
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T), rtol=1e-9)
    out = resample.coral_align(*rows)
    assert out.columns == ["id", "vec", "z"]
    z = np.array([r.vec for r in out.orderBy("id").collect()])
    assert np.allclose(z.mean(0), y.mean(0), atol=1e-7)

    def power(c, p):
        w, v = np.linalg.eigh(c + np.eye(5))
        return (v * w**p) @ v.T

    assert np.allclose(z, (x - x.mean(0)) @ power(np.cov(x.T), -0.5) @ power(np.cov(y.T), 0.5) + y.mean(0), atol=1e-6)


def plain_cuts(n, pos, train=0.6, test=0.2, window=0.1, least=100):
    i, p, rows, positives = np.cumsum(n), np.cumsum(pos), n.sum(), pos.sum()
    first, second, reach = round(rows * train), round(rows * (1 - test)), max(1, round(rows * window))
    rate, best = positives / rows, None
    for a in np.flatnonzero((i >= max(least, first - reach)) & (i <= min(first + reach, rows - 2 * least))):
        for b in np.flatnonzero((i >= max(least, second - reach, i[a] + least)) & (i <= min(second + reach, rows - least))):
            gaps = abs(p[a] / i[a] - rate) + abs((p[b] - p[a]) / (i[b] - i[a]) - rate) + abs((positives - p[b]) / (rows - i[b]) - rate)
            loss = round(2 * gaps + abs(i[a] / rows - train) + abs((i[b] - i[a]) / rows - (1 - train - test)) + abs((rows - i[b]) / rows - test), 9)
            best = min(best or (9, 0, 0), (loss, int(i[a]), int(i[b])))
    return best[1:]


@pytest.mark.parametrize("seed", range(3))
def test_time_cuts(spark, seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 9, 600)
    pos = rng.binomial(n, np.clip(np.sin(np.arange(600) / 70) * 0.3 + 0.4, 0, 1)) if seed else np.zeros(600, int)
    daily = spark.createDataFrame([(t, int(a), int(b)) for t, (a, b) in enumerate(zip(n, pos))], "t int, n long, pos long")
    assert tuple(split.time_cuts(daily, ["t"]).first()) == plain_cuts(n, pos)


def test_time_cuts_of_a_million_steps(spark):
    daily = spark.range(1_000_000).select("id", F.lit(1).cast("long").alias("n"), (F.rand(1) < 0.2 + F.col("id") / 5e6).cast("long").alias("pos"))
    i, j = split.time_cuts(daily, ["id"]).first()
    assert 500_000 <= i <= 700_000 and i + 100 <= j <= 900_000


def rows_of(spark, n=600, d=4, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1)
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(size=n) > 0.8).astype(int)
    return spark.createDataFrame([(i, int(b), [float(c) for c in v]) for i, (v, b) in enumerate(zip(x, y))], "id int, y int, vec array<double>")


def test_shared_logistic_regressions_equal_single_ones(spark):
    from pyspark.ml.classification import LogisticRegression

    rows = split.stratified_kfold(rows_of(spark), "y", "id", 3, 1).cache()
    fitted = [(0, 0.01), (2, 0.01), (1, 0.1)]
    beta = manymodels.fit_logistic(rows, fitted, 3.0)
    for (f, reg), b in zip(fitted, beta):
        m = LogisticRegression(weightCol="w", regParam=reg, maxIter=200, tol=1e-12).fit(models.prepared(rows.where(F.col("fold") != f), 3.0))
        assert np.allclose([*m.coefficients.toArray(), m.intercept], b, atol=1e-5)
    scores = manymodels.score_logistic(rows, fitted, beta)
    assert scores.groupBy("model").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).orderBy("model").collect() == [(0, 0, 0), (1, 2, 2), (2, 1, 1)]


@pytest.mark.parametrize("n, d, reg", [(6, 20, 0.1), (60, 3, 0.1), (80, 2, 0.001)])
def test_svm_is_at_the_optimum(n, d, reg):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=n) > 0.2, 1, -1)
    a, b = manymodels.svm(x @ x.T, y, 1 / (reg * n))
    w = a @ x
    goal = lambda w, b: np.maximum(0, 1 - y * (x @ w + b)).mean() + reg / 2 * w @ w
    # Primal and dual values meet at the optimum only.
    dual = reg * (np.abs(a).sum() - w @ w / 2)
    assert abs(a.sum()) < 1e-9 and goal(w, b) == pytest.approx(dual, rel=1e-4)


def test_left_out_svms_are_of_the_others(spark):
    rows = rows_of(spark, 30, 3)
    got = {r.id: r.score for r in manymodels.leave_one_out(rows, 0.1).collect()}
    x, y = np.array([r.vec for r in rows.orderBy("id").collect()]), np.array([2 * r.y - 1 for r in rows.orderBy("id").collect()])
    for i in range(30):
        rest = np.arange(30) != i
        z = x / x[rest].std(0, ddof=1)
        a, b = manymodels.svm(z[rest] @ z[rest].T, y[rest], 1 / (0.1 * 29))
        assert got[i] == pytest.approx(a @ (z[rest] @ z[i]) + b, abs=1e-6)


def test_left_out_svms_over_blocks(spark, monkeypatch):
    rows = rows_of(spark, 40, 3)
    one = {r.id: r.score for r in manymodels.leave_one_out(rows, 0.1).collect()}
    monkeypatch.setattr(manymodels, "LEFT_OUT_BLOCK", 7)
    assert {r.id: r.score for r in manymodels.leave_one_out(rows, 0.1).collect()} == pytest.approx(one)


def test_training_run(spark):
    rows = rows_of(spark, 4000, 6).withColumn("subject", F.col("id") % 8)
    targets = spark.range(3).select(F.col("id").cast("int").alias("subject"))
    plain = rows.where("subject > 2")
    parts = {r["split"]: (r.n, r.p) for r in split.subject_time_split(plain, ["subject"], ["id"]).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    n, pos = parts["train"]
    want = {"smote": n + max(0, int((n - pos) * 0.8) - pos), "undersample": pos + min(n - pos, int(pos / 0.8)), "none": n, "jitter": n + max(0, int((n - pos) * 0.8) - pos)}
    for method, size in want.items():
        r = models.training_run(rows, targets, "source_only", "subject", ["id"], method=method, ratio=0.8, top=3).first()
        assert (r.n_train, r.n_val, r.n_test) == (size, parts["val"][0], parts["test"][0])
        assert r.tn + r.fp + r.fn + r.tp == r.n_test and r.fn + r.tp == parts["test"][1] and r.auc > 0.85 and r.recall > 0.6


def test_dbscan_writes_no_table_of_pairs(spark, tmp_path, monkeypatch):
    """300 places within eps of each other, 10 points each, have 4,498,500 pairs; the tables written stay near the places' number."""
    size = []
    written = domain.written
    monkeypatch.setattr(domain, "written", lambda df, name: [out := written(df, name), size.append(out.count())][0])
    monkeypatch.setattr(domain, "GRID_BLOCK", 64)
    near = spark.range(3000).select("id", F.array((F.col("id") % 300) / 1000.0, F.lit(0.0)).alias("vec"))
    far = spark.createDataFrame([(5000, [9.0, 0.0]), (5001, [9.5, 0.0]), (5002, [9.9, None]), (5003, [float("nan"), 0.0]), (5004, None), (5005, [20.0, 0.0]), (5006, [20.0, 0.0]), (5007, [20.0, 0.0]), (5008, [21.0, 0.0])], "id long, vec array<double>")
    got = {r.s: r.cluster for r in domain.dbscan_points(near.unionByName(far), 1.0, 3).collect()}
    want = dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5005)) | dict.fromkeys(range(5005, 5009), 5005)
    assert got == want and max(size) < 10_000


def test_grid_is_joined_once(spark):
    """The plan over the result grid reads its few cells, and no longer the tables that it came from."""
    files = registry.QUERIES["j36_tradeoff_pattern"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)
