"""Many linear models of one table at once (2.I): shared passes for logistic regression, shared tasks for linear SVMs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Newton steps at most, and the largest step of a coefficient at which they stop.
STEPS, STILL = 25, 1e-9
#: Groups in which the tasks' sums are merged before they reach the driver.
MERGES = 32
#: Left-out models of one task.
LEFT_OUT_BLOCK = 64


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """fold, y, x of each batch."""
    for b in batches:
        if b.num_rows:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            yield b.column(0).to_numpy(), b.column(1).to_numpy().astype(float), x


def _summed(rows: DataFrame, per_task) -> np.ndarray:
    """Sum over tasks of an array per task: merged in MERGES groups by Spark, then on the driver."""

    def run(batches):
        total = None
        for part in _batches(batches):
            own = per_task(*part)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(abs(total).sum() * 997) % MERGES], pa.int32()), pa.array([total.tolist()])], names=["part", "s"])

    def join(pdf):
        return pd.DataFrame({"part": pdf["part"][:1], "s": [np.sum(np.stack(pdf["s"]), 0).tolist()]})

    schema = "part int, s array<double>"
    got = rows.mapInArrow(run, schema).groupBy("part").applyInPandas(join, schema).collect()
    return np.sum([r["s"] for r in sorted(got, key=lambda r: r["part"])], 0)


def fit_logistic(df: DataFrame, models: list[tuple[int, float]], positive_weight: float = 1.0) -> np.ndarray:
    """Coefficients and intercept of each model (fold, reg), one row each: fitted on all rows of other folds (id, fold, y, vec).

    Each Newton step of all models is one pass over the rows: a task adds up
    gradient and curvature of every model, so passes do not grow with models or
    folds. As Spark's own: weighted mean loss, and half the squared coefficients
    of standardised features times reg; the intercept is free.
    """
    rows = df.select("fold", "y", "vec")
    d = len(rows.select("vec").first()["vec"])
    folds = sorted({f for f, _ in models})

    def moments(fold, y, x):
        w = np.where(y == 1, positive_weight, 1.0)
        out = []
        for f in folds:
            v = w * (fold != f)
            out += [v.sum(), (v * v).sum(), *(v @ x), *(v @ (x * x))]
        return np.array(out)

    s = _summed(rows, moments).reshape(len(folds), 2 + 2 * d)
    weight, squares, first, second = s[:, 0], s[:, 1], s[:, 2 : 2 + d], s[:, 2 + d :]
    variance = (second - first**2 / weight[:, None]) / (weight - squares / weight)[:, None]
    at = np.array([folds.index(f) for f, _ in models])
    penalty = np.array([reg for _, reg in models])[:, None] * np.maximum(variance[at], 0)
    of = np.array([f for f, _ in models])
    beta = np.zeros((len(models), d + 1))

    def step(fold, y, x):
        z = np.c_[x, np.ones(len(x))]
        w = np.where(y == 1, positive_weight, 1.0)
        p = 1 / (1 + np.exp(-np.clip(z @ beta.T, -500, 500)))
        out = []
        for k, f in enumerate(of):
            v = w * (fold != f)
            out += [*(z.T @ (v * (p[:, k] - y))), *((z.T * (v * p[:, k] * (1 - p[:, k]))) @ z).ravel()]
        return np.array(out)

    for _ in range(STEPS):
        s = _summed(rows, step).reshape(len(models), -1)
        moved = 0.0
        for k in range(len(models)):
            g, h = s[k, : d + 1] / weight[at[k]], s[k, d + 1 :].reshape(d + 1, d + 1) / weight[at[k]]
            g[:d] += penalty[k] * beta[k, :d]
            h[np.arange(d), np.arange(d)] += penalty[k]
            change = np.linalg.solve(h + 1e-12 * np.eye(d + 1), g)
            change *= min(1.0, 10 / max(np.abs(change).max(), 1e-300))  # far from the end steps are held
            beta[k] = beta[k] - change
            moved = max(moved, float(np.abs(change).max()))
        if moved < STILL:
            break
    return beta


def score_logistic(df: DataFrame, models: list[tuple[int, float]], beta: np.ndarray) -> DataFrame:
    """model, id, fold, y, score of each row under the models that left its fold out."""
    of = np.array([f for f, _ in models])
    kind = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"]).astype(float)
                p = 1 / (1 + np.exp(-np.clip(x @ beta[:, :-1].T + beta[:, -1], -500, 500)))
                i, k = np.nonzero(pdf["fold"].to_numpy()[:, None] == of[None])
                yield pd.DataFrame({"model": k, "id": pdf["id"].to_numpy()[i], "fold": pdf["fold"].to_numpy()[i], "y": pdf["y"].to_numpy()[i], "score": p[i, k]})

    return df.select("id", "fold", "y", "vec").mapInPandas(run, f"model int, id {kind['id']}, fold int, y int, score double")


def svm(kernel: np.ndarray, y: np.ndarray, cost: float, rounds: int = 20_000, gap: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights (alpha * y) and intercept of a soft-margin SVM by pairs that violate most (SMO)."""
    n = len(y)
    alpha, f = np.zeros(n), -y.astype(float)  # f: decision without intercept, less y
    for _ in range(rounds):
        up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
        low = ((y < 0) & (alpha < cost)) | ((y > 0) & (alpha > 0))
        if not up.any() or not low.any():
            break
        i, j = np.where(up, f, np.inf).argmin(), np.where(low, f, -np.inf).argmax()
        if f[j] - f[i] < gap:
            break
        eta = max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        t = (f[j] - f[i]) / eta
        t = min(t, cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] += y[i] * t
        alpha[j] -= y[j] * t
        f += t * (kernel[i] - kernel[j])
    inside = (alpha > 1e-9 * cost) & (alpha < cost * (1 - 1e-9))
    bounds = [-f[up].min() if up.any() else 0.0, -f[low].max() if low.any() else 0.0]
    return alpha * y, float(-f[inside].mean() if inside.any() else np.mean(bounds))


def leave_one_out(rows: DataFrame, reg: float) -> DataFrame:
    """id, y, score: decision value of each row (id, y, vec) under a linear SVM of all others, features scaled by their deviation.

    Rows are few (one per session): each task gets them all once and fits
    LEFT_OUT_BLOCK models, so there is one shuffle whatever the number of
    sessions. Where the others are of one class the score is that class, -1 or 1.
    """
    blocks = max(1, -(-rows.count() // LEFT_OUT_BLOCK))
    dealt = rows.select("id", "y", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    kind = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        x, y, mine = np.stack(pdf["vec"]).astype(float), np.where(pdf["y"] == 1, 1, -1), np.flatnonzero(pdf["_own"] == pdf["_b"])
        scores = []
        for k in mine:
            rest = np.arange(len(y)) != k
            if len(set(y[rest].tolist())) < 2:
                scores.append(float(y[rest][0]) if rest.any() else 0.0)
                continue
            sd = x[rest].std(0, ddof=1)
            z = np.where(sd > 0, x / np.where(sd > 0, sd, 1), 0)
            a, b = svm(z[rest] @ z[rest].T, y[rest], 1 / (reg * rest.sum()))
            scores.append(float(a @ (z[rest] @ z[k])) + b)
        return pd.DataFrame({"id": pdf["id"][mine], "y": pdf["y"][mine], "score": scores})

    return dealt.groupBy("_b").applyInPandas(run, f"id {kind['id']}, y int, score double")
