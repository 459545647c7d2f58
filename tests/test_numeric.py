"""Array kernels and tails against definitions and hand-checkable cases."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakelane.functions import tails
from wakelane.operators import domain, primitives, windows
from wakelane.operators.labels import event_ranges
from wakelane.operators.metrics import classification_metrics, roc_auc
from wakelane.functions.tails import u_exact
from wakelane.operators.stats import adequacy, adjust_p, compare_intervals, mann_whitney


def entropy_by_definition(x, m=2):
    n, r = len(x), 0.2 * np.std(x)
    if n <= m + 1 or r == 0:
        return 0.0
    count = lambda k: sum(np.all(np.abs(x[i : i + k] - x[j : j + k]) <= r) for i in range(n - k) for j in range(i + 1, n - k + 1))
    a, b = count(m + 1), count(m)
    return 10.0 if a == 0 or b == 0 else -math.log(a / b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
def test_sample_entropy(values):
    x = np.array(values, float)
    assert windows.sample_entropy_of(x) == pytest.approx(entropy_by_definition(x))


def test_entropy_cases():
    assert windows.sample_entropy_of(np.ones(30)) == 0.0
    assert windows.sample_entropy_of(np.array([1.0, 100.0, 3.0, 500.0, 9.0])) == 10.0


def test_spectral_finds_the_tone():
    t = np.arange(300) / 60
    got = windows.spectral_of(np.sin(2 * np.pi * 5 * t), 60.0)
    assert got["dominant_freq"] == pytest.approx(5.0) and got["freq_cog"] == pytest.approx(5.0, abs=0.01)
    assert got["spectral_entropy"] == pytest.approx(0, abs=1e-6)


def packet_by_definition(x):
    nodes = [np.array([x[0 : len(x) // 2 * 2 : 2], x[1 : len(x) // 2 * 2 : 2]])]
    for _ in range(3):
        out = []
        for v in nodes:
            n = v.shape[1]
            if n < 4:
                out += [v, np.zeros_like(v)]
                continue
            lo, hi = np.zeros((2, n // 2)), np.zeros((2, n // 2))
            for i in range(n // 2):
                for k in range(4):
                    if 2 * i + k < n:
                        lo[:, i] += windows.GHM_LOW[k] @ v[:, 2 * i + k]
                        hi[:, i] += windows.GHM_HIGH[k] @ v[:, 2 * i + k]
            out += [lo, hi]
        nodes = out
    e = [(v**2).mean() for v in nodes]
    return [x / (sum(e) + 1e-10) for x in reversed(e)]


@pytest.mark.parametrize("n", [16, 17, 64, 180])
def test_multiwavelet(n):
    x = np.random.default_rng(n).normal(size=n)
    assert windows.multiwavelet_of(x) == pytest.approx(packet_by_definition(x))


def test_dtw_against_full_table():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.normal(size=rng.integers(1, 9)), rng.normal(size=rng.integers(1, 9))
        c = np.full((len(x) + 1, len(y) + 1), np.inf)
        c[0, 0] = 0
        for i in range(len(x)):
            for j in range(len(y)):
                c[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(c[i, j], c[i, j + 1], c[i + 1, j])
        assert domain.dtw_many([x], [y])[0] == pytest.approx(math.sqrt(c[-1, -1]))


def test_tails():
    assert tails.t_sf2(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.t_quantile(9) == pytest.approx(2.262157, abs=1e-5)
    assert tails.gammaincc(1.5, 3.0) == pytest.approx(0.1116102, abs=1e-6)
    w, p = tails.shapiro_w(np.random.default_rng(0).normal(size=50))
    assert 0.9 < w <= 1 and 0 <= p <= 1
    assert tails.shapiro_w(np.exp(np.random.default_rng(0).normal(size=50) * 2))[1] < 0.01


def test_event_ranges_by_hand(spark):
    events = spark.createDataFrame([("s", 100.0, 110.0), ("s", 200.0, 210.0)], "k string, t_start double, t_end double")
    span = spark.createDataFrame([("s", 0.0, 300.0)], "k string, t_min double, t_max double")
    got = [(r.start, r.end, r.label) for r in event_ranges(events, ["k"], span).orderBy("range_no").collect()]
    assert got == [(80, 100, 0), (100, 110, 1), (110, 120, 0), (180, 200, 0), (200, 210, 1), (210, 220, 0)]


def test_auc_and_f2_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.4), (1, 1, 0.35), (1, 1, 0.8)], "g int, y int, s double")
    assert roc_auc(df, ["g"], "y", "s").first().auc == pytest.approx(0.75)
    m = classification_metrics(spark.createDataFrame([(1, 1, True), (1, 0, True)], "g int, y int, p boolean"), ["g"], "y", __import__("pyspark").sql.functions.col("p")).first()
    assert (m.precision, m.recall) == (0.5, 1.0) and m.f2 == pytest.approx(0.8333, abs=1e-4)


def test_cliff_and_adjusted_p_by_hand(spark):
    rows = [("c", "a", float(x)) for x in (1, 2, 3)] + [("c", "b", float(x)) for x in (2, 3, 4)]
    assert mann_whitney(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "a", "b", "v").first().delta == pytest.approx(-5 / 9)
    p = spark.createDataFrame([("k", 0.01), ("k", 0.02), ("k", 0.03), ("k", 0.2)], "k string, p double")
    got = {r.p: r for r in adjust_p(p, ["k"], "p").collect()}
    assert [round(got[x].bh, 9) for x in (0.01, 0.02, 0.03, 0.2)] == [0.04, 0.04, 0.04, 0.2]
    assert [round(got[x].holm, 9) for x in (0.01, 0.02, 0.03, 0.2)] == [0.04, 0.06, 0.06, 0.2]


def test_window_kernels_work_on_all_rows_alike(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(20, 33)), np.ones((1, 33)), rng.integers(0, 3, (5, 33)).astype(float)])
    assert windows.sample_entropies(x).tolist() == pytest.approx([entropy_by_definition(r) if r.std() else 0.0 for r in x])
    assert np.allclose(windows.multiwavelets(x), [packet_by_definition(r) for r in x])
    rows = [(f"s{i % 2}", i, k, float(v)) for i, r in enumerate(x) for k, v in enumerate(r[: 33 if i % 3 else 20])]
    df = spark.createDataFrame(rows, "k string, win long, idx int, x double").repartition(5)
    got = {r.win: r for r in windows.per_window(df, ["k", "win"], lambda m: windows.time_statistics(m) | {"h": windows.shannon_entropies(m)}, "n long, h double, " + ", ".join(f"{c} double" for c in windows.TIME)).collect()}
    want = {r.win: r for r in windows.window_features(df, ["k", "win"]).join(windows.shannon_entropy(df, ["k", "win"]), ["k", "win"]).collect()}
    assert len(got) == len(want) == len(x)
    for w, row in want.items():
        assert got[w].h == pytest.approx(row.shannon_entropy, abs=1e-9)
        for c in ("n", *windows.TIME):
            assert got[w][c] == pytest.approx(row[c], abs=1e-9), (w, c)


def test_bandpass_and_welch():
    # Gain of the filter on the unit circle: 1/2 power at the cut-offs, all in the middle, none at the ends.
    gain, sections = windows.butterworth_sections(5, 0.2, 0.4)
    for f, want in ((0.2, 0.5**0.5), (0.4, 0.5**0.5), (0.0, 0.0), (1.0, 0.0), (0.29, 1.0)):
        z = np.exp(-1j * np.pi * f)
        h = gain * np.prod([(1 - z**2) / (1 + a1 * z + a2 * z**2) for _, a1, a2 in sections])
        assert abs(h) == pytest.approx(want, abs=1e-3)
    t = np.arange(2000) / 250
    low, high = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 40 * t)
    kept = windows.bandpass((low + high)[None], 250, 8, 13)[0]
    assert np.abs(kept - low)[800:1200].max() < 1e-3  # away from the ends, where the filter starts
    f, p = windows.welch(low[None], 250, 500)
    assert f[p[0].argmax()] == 10 and (p[0] * (f[1] - f[0])).sum() == pytest.approx(0.5, rel=1e-3)
    assert windows.bandpass(np.ones((2, 16)), 128, 0.5, 4).shape == (2, 16)


def test_exact_mann_whitney_by_enumeration(spark):
    from itertools import combinations

    for n, m in ((1, 3), (3, 4), (5, 5), (2, 9)):
        us = [sum(c) - n * (n - 1) // 2 for c in combinations(range(n + m), n)]
        for u in range(n * m + 1):
            want = min(1.0, 2 * sum(x >= max(u, n * m - u) for x in us) / len(us))
            assert u_exact(u, n, m) == pytest.approx(want)
    rows = [("c", "a", float(x)) for x in (1, 2, 3)] + [("c", "b", float(x)) for x in (4, 5, 6)] + [("t", "a", 1.0), ("t", "b", 1.0), ("t", "b", 2.0)]
    got = {r.k: r.p for r in mann_whitney(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "a", "b", "v").collect()}
    assert got["c"] == pytest.approx(0.1) and 0 < got["t"] <= 1


def test_adequacy_by_hand(spark):
    rows = [("flat", i, 0.8 + 0.001 * (i % 2)) for i in range(6)] + [("wide", i, 0.5 + 0.2 * (i % 2)) for i in range(6)] + [("low", i, 0.4) for i in range(3)] + [("one", 0, 0.9)]
    got = {r.k: r for r in adequacy(spark.createDataFrame(rows, "k string, block int, v double"), ["k"], "block", "v", replicates=50).collect()}
    assert {k: r.adequate for k, r in got.items()} == {"flat": True, "wide": False, "low": True, "one": None}
    assert got["wide"].half == pytest.approx(2.570582 * 0.1095445 / 6**0.5, rel=1e-5)


def test_intervals_hold_the_means(spark):
    rows = [("m", c, s, v + 0.1 * s) for c, v in (("base", 0.0), ("x", 1.0)) for s in range(8)]
    r = compare_intervals(spark.createDataFrame(rows, "k string, c string, block int, v double"), ["k"], "block", "c", "base", "v", 200).first()
    assert r.base_lo < 0.35 < r.base_hi and r.lo < 1.35 < r.hi and r.lo - r.base_lo == pytest.approx(1.0)


def test_knn_join_ships_vectors_seldom(spark, monkeypatch):
    """A row is sent to every block of queries: SPREAD at most until they are of MOST vectors, more for long vectors only."""
    monkeypatch.setattr(primitives, "BLOCK", 20)
    monkeypatch.setattr(primitives, "MOST", 80)
    rng = np.random.default_rng(5)
    v = rng.integers(0, 4, (400, 3)).astype(float)
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "id long, vec array<double>")
    out = primitives.knn_join(rows, rows, 3)
    got = {(r.query_id, r["rank"]): (r.id, r.dist) for r in out.collect()}
    for q in range(400):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [i for i in sorted(range(400), key=lambda i: (d[i], i)) if i != q][:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, d[i]) for i in want]
    count = lambda df: df.agg(primitives.block_count("vec").alias("n")).first()["n"]
    wide = rows.select("id", F.array_repeat(F.col("vec")[0], 640).alias("vec"))
    assert [count(d) for d in (rows.where("id < 90"), rows, rows.union(rows), wide)] == [5, 8, 10, 50]


def test_nearest_among_copies_is_bounded(monkeypatch):
    """All rows are copies: every one is a candidate, and they are measured some at a time."""
    import tracemalloc

    rows = np.ones((4000, 64))
    tracemalloc.start()
    q, i, d = primitives.nearest(np.arange(64), rows[:64], np.arange(4000), rows, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i[:4].tolist() == [1, 2, 0, 2] and not d.any() and peak < 150e6


def test_knn_task_holds_each_vector_once():
    """Batches are let go one by one, and a matrix product's distances are bounded, so a task's memory is little more than its vectors."""
    import tracemalloc

    rng = np.random.default_rng(6)
    vec, kind = rng.normal(size=(40000, 64)), (np.arange(40000) % 5 > 0).astype("int32")
    vec[7], waiting = vec[6], []

    def batches():
        for lo in range(0, 40000, 4000):
            waiting.append(pa.total_allocated_bytes() - base)
            names = [f"{i:05d}" for i in range(lo, lo + 4000)]
            column = pa.array(list(vec[lo : lo + 4000]))
            yield pa.RecordBatch.from_arrays([pa.array(["a"] * 4000), pa.array(names), column, pa.array(kind[lo : lo + 4000])], names=["g", "id", "vec", "kind"])
            del column

    base = pa.total_allocated_bytes()
    tracemalloc.start()
    out = pa.Table.from_batches(primitives.nearest_in_batches(batches(), 2, ["g"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(waiting) < 3 * 4000 * 64 * 8 and peak < 3 * vec.nbytes
    got = list(zip(*(out[c].to_pylist() for c in ("g", "query_id", "id", "dist"))))
    assert len(got) == 16000
    for q in (0, 5, 39995):
        d = np.sqrt(((vec - vec[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(40000) if kind[i] and i != q)[:2]
        assert [(g, i, x) for g, n, i, x in got if n == f"{q:05d}"] == [("a", f"{i:05d}", pytest.approx(x)) for x, i in want]
    none = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[1.0]]), pa.array([0], "int32")], names=["id", "vec", "kind"])
    assert not list(primitives.nearest_in_batches(iter([none, none.slice(0, 0)]), 2, []))


def test_knn_task_does_without_pandas():
    """pandas takes more of a task's process than the vectors of most tasks; ids that are not numbers come back all the same."""
    import subprocess
    import sys

    code = """
import sys
import numpy as np, pyarrow as pa, pyarrow.compute as pc
from wakelane.operators import primitives
held = lambda kind, values: pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(values)])
ids, kinds = held(pa.int64(), np.array([5, 6, 7, 8])), held(pa.int32(), np.array([0, 1, 1, 1], "int32"))
vec = pa.ListArray.from_arrays(held(pa.int32(), np.arange(0, 9, 2, dtype="int32")), held(pa.float64(), np.array([0.0, 0, 3, 4, 0, 1, 9, 9])))
rows = lambda i: pa.RecordBatch.from_arrays([i, vec, kinds], names=["id", "vec", "kind"])
out, = primitives.nearest_in_batches(iter([rows(ids)]), 2, [])
print("pandas" in sys.modules, out.to_pydict())
out, = primitives.nearest_in_batches(iter([rows(pc.cast(ids, pa.string()))]), 2, [])
print(out.schema.field("id").type, out.to_pydict())
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.splitlines()
    assert said == ["False {'query_id': [5, 5], 'id': [7, 6], 'dist': [1.0, 5.0]}", "string {'query_id': ['5', '5'], 'id': ['7', '6'], 'dist': [1.0, 5.0]}"]
