"""Classifiers, calibration and tuning (2.I, 2.H) on Spark ML over (id, y, vec)."""

from __future__ import annotations

import math
import random

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakelane.functions.columns import hash_uniform
from wakelane.functions.storage import written
from wakelane.functions.tails import t_p
from wakelane.operators.clean import filter_by_mode
from wakelane.operators.manymodels import fit_logistic, leave_one_out, score_logistic
from wakelane.operators.metrics import best_threshold_pr, classification_metrics, roc_auc
from wakelane.operators.primitives import knn_join
from wakelane.operators.resample import augment_minority, random_undersample, with_smote
from wakelane.operators.select import class_stats, feature_indices
from wakelane.operators.split import stratified_kfold, subject_time_split

#: Boosting stands for the boosted-tree libraries, none of which is at hand.
TRAINERS = {
    "random_forest": lambda seed, **p: RandomForestClassifier(seed=seed, weightCol="w", numTrees=p.get("trees", 20), maxDepth=p.get("depth", 5)),
    "decision_tree": lambda seed, **p: DecisionTreeClassifier(seed=seed, weightCol="w", maxDepth=p.get("depth", 5)),
    "boosted_trees": lambda seed, **p: GBTClassifier(seed=seed, weightCol="w", maxIter=p.get("rounds", 10), maxDepth=p.get("depth", 3)),
    "logistic": lambda seed, **p: LogisticRegression(weightCol="w", regParam=p.get("reg", 0.01), maxIter=50),
    "linear_svm": lambda seed, **p: LinearSVC(weightCol="w", regParam=p.get("reg", 0.01), maxIter=50),
    "mlp": lambda seed, **p: MultilayerPerceptronClassifier(seed=seed, layers=[p["width"], *p.get("hidden", [6]), 2], maxIter=p.get("rounds", 30)),
}


def prepared(df: DataFrame, positive_weight: float = 1.0) -> DataFrame:
    return df.select("id", F.col("y").cast("double").alias("label"), array_to_vector("vec").alias("features"), F.when(F.col("y") == 1, positive_weight).otherwise(1.0).alias("w"))


def fit_score(train: DataFrame, test: DataFrame, kind: str, seed: int = 1, positive_weight: float = 3.0, **params) -> DataFrame:
    """Id, y, score of test rows; decision values of the linear SVM are scaled to 0-1 by their extremes."""
    if kind == "mlp":  # the first layer has the vectors' length
        params = {"width": len(train.select("vec").first()["vec"])} | params
    model = TRAINERS[kind](seed, **params).fit(prepared(train, positive_weight))
    out = model.transform(prepared(test))
    if kind == "linear_svm":
        raw = out.select("id", F.col("label").cast("int").alias("y"), vector_to_array("rawPrediction")[1].alias("s"))
        ends = F.broadcast(raw.agg(F.min("s").alias("_a"), F.max("s").alias("_b")))
        return raw.join(ends).select("id", "y", F.coalesce((F.col("s") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)), F.lit(0.5)).alias("score"))
    return out.select("id", F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))


def balanced_bag(train: DataFrame, test: DataFrame, bags: int = 5, kind: str = "decision_tree", seed: int = 1) -> DataFrame:
    """Mean score of learners on balanced undersamples (trees: balanced forest; boosted trees: easy ensemble)."""
    out = None
    for b in range(bags):
        one = fit_score(random_undersample(train, "y", "id", 1.0, seed + b), test, kind, seed + b, 1.0)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id", "y").agg(F.avg("score").alias("score"))


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """I4: share of positives among the k nearest training rows, plain or by inverse distance."""
    near = knn_join(test, train, k).join(train.select("id", F.col("y").alias("_y")), "id")
    w = F.lit(1.0) if weights == "uniform" else 1 / (F.col("dist") + 1e-10)
    return near.groupBy(F.col("query_id").alias("id")).agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("score"))


def adaboost(train: DataFrame, test: DataFrame, rounds: int = 5, seed: int = 1) -> DataFrame:
    """I4: SAMME over weighted trees of depth 2; weights are columns of a written table."""
    rows = written(prepared(train).withColumn("w", F.lit(1.0)), "weights")
    scores = prepared(test).withColumn("s", F.lit(0.0))
    total = 0.0
    for k in range(rounds):
        model = DecisionTreeClassifier(seed=seed + k, weightCol="w", maxDepth=2).fit(rows)
        seen = model.transform(rows)
        error = seen.agg((F.sum(F.when(F.col("prediction") != F.col("label"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("e")).first()["e"]
        alpha = math.log((1 - error + 1e-10) / (error + 1e-10))
        if alpha <= 0:
            break
        total += alpha
        rows = seen.select("id", "label", "features", (F.col("w") * F.when(F.col("prediction") != F.col("label"), math.exp(min(alpha, 20))).otherwise(1.0)).alias("w"))
        rows = written(rows, "weights")
        scores = model.transform(scores).select("id", "label", "features", "w", (F.col("s") + alpha * F.col("prediction")).alias("s"))
        if error == 0:
            break
    return scores.select("id", F.col("label").cast("int").alias("y"), (F.col("s") / (total or 1.0)).alias("score"))


def platt_calibrate(train: DataFrame, test: DataFrame, kind: str = "random_forest", folds: int = 5, seed: int = 1) -> DataFrame:
    """A sigmoid fitted on out-of-fold scores is put over the scores of the model fitted on all training rows."""
    parts = stratified_kfold(train, "y", "id", folds, seed)
    held = None
    for f in range(folds):
        one = fit_score(parts.where(F.col("fold") != f), parts.where(F.col("fold") == f), kind, seed)
        held = one if held is None else held.unionByName(one)
    vector = lambda d: d.select("id", "y", F.col("y").cast("double").alias("label"), array_to_vector(F.array("score")).alias("features"))
    sigmoid = LogisticRegression(maxIter=50).fit(vector(held))
    return sigmoid.transform(vector(fit_score(train, test, kind, seed))).select("id", "y", vector_to_array("probability")[1].alias("score"))


def _cv_logistic(df: DataFrame, regs: list[float], folds: int, seed: int, positive_weight: float = 3.0) -> DataFrame:
    """model (place in regs), f2, folds: all folds of all regs in shared passes."""
    parts = written(stratified_kfold(df.select("id", "y", "vec"), "y", "id", folds, seed), "folds")
    models = [(f, reg) for reg in regs for f in range(folds)]
    scores = score_logistic(parts, models, fit_logistic(parts, models, positive_weight))
    scores = scores.withColumn("model", F.floor(F.col("model") / folds).cast("int"))
    return best_threshold_pr(scores, ["model", "fold"], "y", "score", 2.0).groupBy("model").agg(F.avg("fbeta").alias("f2"), F.count("*").alias("folds"))


def cv_score(df: DataFrame, kind: str, folds: int = 3, seed: int = 1, **params) -> DataFrame:
    """Best F2 of each fold, and its mean, as one row.

    Logistic regressions of all folds are fitted together; other kinds are one
    Spark ML fit a fold.
    """
    if kind == "logistic":
        return _cv_logistic(df, [params.get("reg", 0.01)], folds, seed).select("f2", "folds")
    parts = stratified_kfold(df, "y", "id", folds, seed)
    out = None
    for f in range(folds):
        one = fit_score(parts.where(F.col("fold") != f), parts.where(F.col("fold") == f), kind, seed, **params).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return best_threshold_pr(out, ["fold"], "y", "score", 2.0).agg(F.avg("fbeta").alias("f2"), F.count("*").alias("folds"))


def random_search(df: DataFrame, kind: str, space: dict[str, list], trials: int = 3, seed: int = 1, folds: int = 3) -> DataFrame:
    """Seeded draws of parameters with their cross-validated F2; all trials of logistic regressions share their passes."""
    rng = random.Random(seed)
    drawn = [{k: rng.choice(v) for k, v in sorted(space.items())} for _ in range(trials)]
    if kind == "logistic":
        found = _cv_logistic(df, [p.get("reg", 0.01) for p in drawn], folds, seed)
        names = df.sparkSession.createDataFrame([(t, str(p)) for t, p in enumerate(drawn)], "trial int, params string")
        return names.join(found, names.trial == found.model).select("trial", "params", "f2")
    out = None
    for t, params in enumerate(drawn):
        one = cv_score(df, kind, folds, seed, **params).select(F.lit(t).alias("trial"), F.lit(str(params)).alias("params"), "f2")
        out = one if out is None else out.unionByName(one)
    return out


def rf_importance(df: DataFrame, k: int = 10, trees: int = 50, seed: int = 1) -> DataFrame:
    """H7: the k features with the highest impurity importance of a balanced forest."""
    n = df.groupBy("y").agg(F.count("*").alias("n"))
    weighted = df.join(F.broadcast(n), "y").select("id", F.col("y").cast("double").alias("label"), array_to_vector("vec").alias("features"), (1 / F.col("n")).alias("w"))
    imp = RandomForestClassifier(seed=seed, weightCol="w", numTrees=trees).fit(weighted).featureImportances.toArray()
    rows = sorted(((int(i), float(x)) for i, x in enumerate(imp)), key=lambda r: (-r[1], r[0]))[:k]
    return df.sparkSession.createDataFrame(rows, "f int, importance double")


def welch_select(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """H8: features with Welch p under alpha; those with fewer than two rows in a class stay."""
    s = class_stats(long)
    a, b = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    df = F.pow(a + b, 2) / F.nullif(a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1), F.lit(0.0))
    s = s.withColumn("t", F.abs(F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(a + b), F.lit(0.0))).withColumn("df", df)
    s = s.withColumn("p", t_p("t", "df"))
    return s.where((F.col("n1") < 2) | (F.col("n0") < 2) | (F.col("p") < alpha)).select("f", "p")


def session_loo(df: DataFrame, session: str) -> DataFrame:
    """Each session's mean vector, labelled by a positive rate above the median, scored by a linear SVM of the others."""
    long = df.select(session, "y", F.posexplode("vec").alias("f", "v"))
    means = long.groupBy(session, "f").agg(F.avg("v").alias("m")).groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "m"))), lambda x: x.m).alias("vec"))
    rate = df.groupBy(session).agg(F.avg("y").alias("rate"))
    med = F.broadcast(rate.agg(F.median("rate").alias("_m")))
    rows = means.join(rate.join(med), session).select(F.col(session).alias("id"), (F.col("rate") > F.col("_m")).cast("int").alias("y"), "vec")
    return leave_one_out(written(rows, "sessions"), 0.1)


def training_run(df: DataFrame, targets: DataFrame, mode: str, key: str, order: list[str], kind: str = "logistic", method: str = "smote", ratio: float = 0.5, top: int = 16, seed: int = 1, beta: float = 2.0) -> DataFrame:
    """One whole run over (id, y, vec, key, order): mode filter (B14), split in time (F3), rebalancing of the training rows
    (G1, G2, G10, or none), top features by Fisher index (H1), fit (I1), threshold by F-beta on the validation rows (I12),
    and the test rows' metrics at it (I14).

    One row: n_train (rebalanced), n_val, n_test, thr, tn, fp, fn, tp, precision, recall, fbeta, auc.
    """
    rows = subject_time_split(filter_by_mode(df, targets, mode, key), [key], order).select("id", "y", "vec", "split")
    part = {s: rows.where(F.col("split") == s).select("id", "y", "vec") for s in ("train", "val", "test")}
    train = part["train"]
    if method == "smote":
        train = with_smote(train, "y", ratio, seed)
    elif method == "undersample":
        train = random_undersample(train, "y", "id", ratio, seed)
    elif method in ("jitter", "scale", "jitter_scale"):
        new = augment_minority(train, "y", ratio, seed, 0.05, method)
        train = train.unionByName(new.select((-F.col("n")).alias("id"), F.lit(1).alias("y"), "vec"))
    elif method != "none":
        raise ValueError(f"unknown method {method}")
    train = written(train, "training")
    score = feature_indices(train.select("id", "y", F.posexplode("vec").alias("f", "v")))
    # At most `top` numbers.
    chosen = sorted(r["f"] for r in score.orderBy(F.desc_nulls_last("fisher"), "f").limit(top).collect())
    cut = lambda d: d.withColumn("vec", F.array(*(F.get("vec", F.lit(k)) for k in chosen)))
    scored = written(fit_score(cut(train), cut(part["val"].unionByName(part["test"])), kind, seed).join(rows.select("id", "split"), "id"), "scores")
    val, test = (scored.where(F.col("split") == s).withColumn("g", F.lit(1)) for s in ("val", "test"))
    thr = best_threshold_pr(val, ["g"], "y", "score", beta).select("g", "thr")
    hit = F.col("score") >= F.col("thr")
    cells = classification_metrics(test.join(F.broadcast(thr), "g"), ["g", "thr"], "y", hit)
    p, r, b2 = F.col("precision"), F.col("recall"), beta * beta
    fb = F.coalesce((1 + b2) * p * r / F.nullif(b2 * p + r, F.lit(0.0)), F.lit(0.0))
    counts = scored.agg(F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "test").alias("n_test")).join(F.broadcast(train.agg(F.count("*").alias("n_train"))))
    auc = roc_auc(test, ["g"], "y", "score").select("g", "auc")
    return cells.join(auc, "g").join(F.broadcast(counts)).select("n_train", "n_val", "n_test", "thr", "tn", "fp", "fn", "tp", "precision", "recall", fb.alias("fbeta"), "auc")


def split_rows(df: DataFrame, seed: int = 1, test: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Seeded train and test rows."""
    u = hash_uniform(seed, "id")
    return df.where(u >= test), df.where(u < test)


