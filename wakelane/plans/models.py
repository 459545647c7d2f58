"""Queries that train models (2.H, 2.I), write and read files (2.A) and check schemas (2.B); their rows are not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakelane.functions.storage import fresh_path
from wakelane.operators import clean, metrics, models, split
from wakelane.plans.base import MATRIX, features, fill, matrix, r, read, signals
from wakelane.sources import files


def _rows(spark, d):
    return matrix(spark, d).select("id", "y", "label", "vec")


def _auc(scores):
    return fill(metrics.roc_auc(scores.withColumn("g", F.lit(1)), ["g"], "y", "score").select("auc"))


def _trainer(kind, **params):
    return lambda spark, d: _auc(models.fit_score(*models.split_rows(_rows(spark, d)), kind, **params))


def i3_balanced_forest(spark, d):
    return _auc(models.balanced_bag(*models.split_rows(_rows(spark, d)), bags=3))


def i3_easy_ensemble(spark, d):
    return _auc(models.balanced_bag(*models.split_rows(_rows(spark, d)), bags=2, kind="boosted_trees"))


def i4_knn_classify(spark, d):
    train, test = models.split_rows(_rows(spark, d))
    return fill(models.knn_classify(train, test, 5, "distance"))


def i4_adaboost(spark, d):
    return _auc(models.adaboost(*models.split_rows(_rows(spark, d)), rounds=3))


def i5_platt_calibrate(spark, d):
    return fill(models.platt_calibrate(*models.split_rows(_rows(spark, d)), kind="logistic", folds=3).select("id", "score"))


def i14_training_run(spark, d):
    """A run from rows to test metrics: components of the vectors as features, their index as time, eight subjects, three of them targets."""
    rows = _rows(spark, d).withColumn("subject_id", F.col("id") % 8)
    targets = spark.range(3).select(F.col("id").alias("subject_id"))
    return fill(models.training_run(rows, targets, "source_only", "subject_id", ["id"]))


def i18_cv_score(spark, d):
    return fill(models.cv_score(_rows(spark, d), "logistic"))


def i18_random_search(spark, d):
    return fill(models.random_search(_rows(spark, d), "logistic", {"reg": [0.001, 0.01, 0.1]}, 2))


def i24_session_loo_auc(spark, d):
    rows = _rows(spark, d).withColumn("session", F.col("id") % 6)
    return _auc(models.session_loo(rows, "session"))


def h7_rf_importance(spark, d):
    return models.rf_importance(_rows(spark, d), 5, 10).select("f")


def h8_welch_select(spark, d):
    return fill(models.welch_select(features(matrix(spark, d), 64)))


def a4_write_features(spark, d):
    path = fresh_path(spark, "features")
    files.write_features(signals(spark, d).select("user_id", "t", "x", F.lit("raw").alias("stage"), F.col("event_type").alias("pipeline")), path)
    return spark.read.parquet(path).groupBy("pipeline").agg(F.count("*").alias("n"))


def a7_write_results(spark, d):
    from wakelane.plans.tables import _eval_lines

    path = fresh_path(spark, "results")
    files.write_results(_eval_lines(spark, d).select(F.from_json("value", files.EVAL_SCHEMA).alias("r")).select("r.*"), path)
    return files.read_eval_results(spark, f"{path}/json").groupBy("model").agg(F.count("*").alias("n"))


def b1_normalize_columns(spark, d):
    return clean.normalize_columns(read(spark, d, "nation").toDF("n nationkey", "n_name ", "n (region key)", *read(spark, d, "nation").columns[3:]))


def b5_common_columns(spark, d):
    n = read(spark, d, "nation")
    return clean.common_columns(n, n.select("n_name", "n_nationkey"))[0]


def f8_split_fallback(spark, d):
    m = _rows(spark, d)
    timed = split.subject_time_split(m.withColumn("g", F.lit(1)), ["label"], ["id"])
    return (split.stratified_split(m, "y", "id", 3) if split.lacks_class(timed, "y") else timed).groupBy("split", "y").agg(F.count("*").alias("n"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "abfhi" and k[1:2].isdigit() and callable(f)}
QUERIES |= {f"i1_{k}": _trainer(k) for k in ("random_forest", "decision_tree", "logistic", "linear_svm")}
QUERIES |= {"i1_mlp": _trainer("mlp"), "i2_boosted_trees": _trainer("boosted_trees", rounds=3)}
ORACLES = {
    "a4_write_features": "SELECT event_type AS pipeline, count(*) AS n FROM events GROUP BY 1",
    "i4_knn_classify": f"WITH {MATRIX}, t AS (SELECT *, CAST(('0x' || substr(md5('1:' || id), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM m), nr AS (SELECT id, y, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM (SELECT a.id, b.id AS other, b.y, sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a.vec[i] - b.vec[i]) ** 2))) AS dist FROM t a JOIN t b ON a.u < 0.3 AND b.u >= 0.3)) SELECT id, {r('sum(y / (dist + 1e-10)) / sum(1 / (dist + 1e-10))')} AS score FROM nr WHERE k <= 5 GROUP BY 1",
    "a7_write_results": "SELECT o_orderpriority AS model, count(*) AS n FROM orders GROUP BY 1",
    "b5_common_columns": "SELECT n_nationkey, n_name FROM nation",
}
