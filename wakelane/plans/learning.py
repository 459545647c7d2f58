"""Queries over rebalancing, feature selection and metrics (2.G, 2.H, 2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakelane.operators import metrics, resample, select
from wakelane.plans.base import MATRIX, SCORED, features, fill, long_matrix, matrix, r, read, scored

#: Components of the given vectors; all of them are features.
N = 64


def _long(spark, d):
    return features(matrix(spark, d), N)


def _narrow(spark, d):
    return matrix(spark, d).select("id", "y", "label", "vec")


def _first(df):
    return df.select(*[c for c in df.columns if c != "vec"], F.col("vec")[0].alias("v1"), F.col("vec")[7].alias("v8"))


def g1_random_undersample(spark, d):
    return resample.random_undersample(matrix(spark, d), "y", "id", 0.5, 9).select("id", "y")


def g2_smote(spark, d):
    return fill(_first(resample.smote(_narrow(spark, d), "y", 0.5, 21)))


def g3_adasyn(spark, d):
    return fill(resample.adasyn_counts(_narrow(spark, d), "y", 1.0))


def g3_adasyn_rows(spark, d):
    return fill(_first(resample.adasyn(_narrow(spark, d), "y", 1.0, 31)))


def g4_borderline_smote(spark, d):
    return fill(_first(resample.borderline_smote(_narrow(spark, d), "y", 0.5, 21)))


def g5_tomek_links(spark, d):
    return resample.tomek_links(_narrow(spark, d), "y").select("id")


def g6_enn(spark, d):
    return resample.enn(_narrow(spark, d), "y").select("id")


def g7_smote_tomek(spark, d):
    m = _narrow(spark, d)
    return resample.with_smote(m, "y", 0.5, 21, after=lambda x: resample.tomek_links(x, "y")).select("id", "y")


def g7_smote_enn(spark, d):
    return resample.with_smote(_narrow(spark, d), "y", 0.5, 21, after=lambda x: resample.enn(x, "y")).select("id", "y")


def g8_smote_rus(spark, d):
    return resample.with_smote(_narrow(spark, d), "y", 0.5, 21, after=lambda x: resample.random_undersample(x, "y", "id", 0.8, 9)).select("id", "y")


def g9_subjectwise_rus(spark, d):
    return resample.random_undersample(scored(spark, d), "y", "row_id", 0.8, 9, ["l_suppkey"]).select("row_id")


def g9_subjectwise_smote(spark, d):
    m = _narrow(spark, d).withColumn("subject", F.col("id") % 3).withColumn("y", (F.col("label") < 3).cast("int"))
    return fill(_first(resample.smote(m, "y", 0.8, 5, keys=["subject"])))


def _augment(method):
    return lambda spark, d: fill(_first(resample.augment_minority(_narrow(spark, d), "y", 0.4, 3, 0.05, method)))


def g12_adaptive_sigma(spark, d):
    return fill(resample.adaptive_sigma(_long(spark, d)))


def g12_sigma_modes(spark, d):
    return fill(resample.sigma_modes(_long(spark, d)))


def g13_augmentation_overlap(spark, d):
    t = _long(spark, d)
    return fill(resample.augmentation_overlap(t, t.where("y = 1").withColumn("v", F.col("v") * 1.1 + 0.05)))


def g13_augmentation_quality(spark, d):
    t = _long(spark, d)
    return fill(resample.augmentation_quality(t.where("y = 0"), t.where("y = 1")))


def g14_domain_mixup(spark, d):
    return fill(_first(resample.domain_mixup(_narrow(spark, d), "label", "y", 4, 200)))


def g15_coral_align(spark, d):
    m = _narrow(spark, d)
    return fill(_first(resample.coral_align(m.where("label < 5"), m.where("label >= 5")).select("id", "vec")), 4)


def g16_class_weights(spark, d):
    return fill(resample.class_weights(scored(spark, d), "y"))


def g17_expected_class_counts(spark, d):
    m = F.element_at(F.array(*map(F.lit, ["rus", "smote", "baseline"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = read(spark, d, "orders").select("o_orderkey", m.alias("method"), F.lit(0.5).alias("ratio"), (F.col("o_custkey") + 100).alias("neg"), (F.col("o_custkey") % 50 + 1).alias("pos"))
    return resample.expected_class_counts(o).drop("ratio")


def h1_fisher_index(spark, d):
    t = _long(spark, d)
    return fill(select.feature_indices(t).select("f", "fisher").join(select.feature_indices(t, "index").select("f", F.col("fisher").alias("fisher2")), "f"))


def h2_label_correlation(spark, d):
    t = _long(spark, d)
    return fill(select.feature_indices(t).select("f", "correlation").join(select.feature_indices(t, "index").select("f", F.col("correlation").alias("correlation2")), "f"))


def h3_welch_t(spark, d):
    t = _long(spark, d)
    return fill(select.feature_indices(t).select("f", "t").join(select.feature_indices(t, "index").select("f", F.col("t").alias("t2")), "f"))


def h4_mutual_information(spark, d):
    t = _long(spark, d).withColumn("v", F.round("v", 1))
    return fill(select.mutual_information(t))


def h5_feature_index_table(spark, d):
    return fill(select.feature_index_table(_long(spark, d)))


def h6_anova_f(spark, d):
    return fill(select.anova_f(_long(spark, d).withColumn("y", F.col("label")), 5))


def h9_fuzzy_importance(spark, d):
    return fill(select.fuzzy_importance(select.feature_index_table(_long(spark, d))))


def h10_univariate_auc(spark, d):
    return fill(select.univariate_auc(_long(spark, d)))


def i6_roc_curve(spark, d):
    return fill(metrics.roc_curve(scored(spark, d), ["grp"], "y", "score"))


def i6_roc_auc(spark, d):
    return fill(metrics.roc_auc(scored(spark, d), ["l_suppkey"], "y", "score", flip=True))


def i7_pr_curve(spark, d):
    return fill(metrics.pr_curve(scored(spark, d), ["grp"], "y", "score"))


def i7_average_precision(spark, d):
    return fill(metrics.average_precision(scored(spark, d), ["l_suppkey"], "y", "score"))


def i8_classification_metrics(spark, d):
    return fill(metrics.classification_metrics(scored(spark, d), ["grp"], "y", F.col("score") >= 0.3))


def i9_class_report(spark, d):
    return fill(metrics.class_report(scored(spark, d).withColumn("p", (F.col("score") >= 0.3).cast("int")), "y", "p"))


def i10_fbeta(spark, d):
    return fill(metrics.classification_metrics(scored(spark, d), ["l_suppkey"], "y", F.col("score") >= 0.3).select("l_suppkey", "f2"))


def i11_precision_at_min_recall(spark, d):
    return fill(metrics.precision_at_min_recall(scored(spark, d), ["l_suppkey"], "y", "score", 0.7))


def i12_best_threshold_pr(spark, d):
    return fill(metrics.best_threshold_pr(scored(spark, d), ["grp"], "y", "score", 2.0))


def i13_best_threshold_grid(spark, d):
    return fill(metrics.best_threshold_grid(scored(spark, d), ["grp"], "y", "score", 101))


def i14_apply_threshold(spark, d):
    return scored(spark, d).select("row_id", (F.col("score") >= 0.25).cast("int").alias("pred"))


def i15_score_spread(spark, d):
    return fill(metrics.score_spread(scored(spark, d), ["grp"], "score"))


def i16_subject_metrics(spark, d):
    return fill(metrics.subject_metrics(scored(spark, d), "l_suppkey", "y", F.col("score") >= 0.3))


def i17_ensemble(spark, d):
    s = scored(spark, d)
    long = s.select("row_id", "score", F.lit(1.0).alias("w")).unionByName(s.select("row_id", (1 - F.col("score")).alias("score"), F.lit(2.0).alias("w"))).unionByName(s.select("row_id", (F.col("score") / 2).alias("score"), F.lit(3.0).alias("w")))
    return fill(metrics.ensemble(long, "row_id", "score", "w"))


def i19_trial_convergence(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    return fill(metrics.trial_convergence(e, ["user_id"], "event_id", "value"))


def i20_mean_roc(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"), F.col("l_linestatus").alias("grp"), F.col("l_linenumber").alias("seed"))
    c = metrics.roc_curve(li, ["grp", "seed"], "y", "score").where("fpr IS NOT NULL AND tpr IS NOT NULL")
    return fill(metrics.mean_roc(c, ["grp"], "seed", 501))


def i21_auc_trapezoid(spark, d):
    return fill(metrics.auc_trapezoid(metrics.roc_curve(scored(spark, d), ["l_suppkey"], "y", "score"), ["l_suppkey"]))


def i22_threshold_compare(spark, d):
    return fill(metrics.threshold_compare(scored(spark, d), ["grp"], "y", "score"))


def i23_confusion_summary(spark, d):
    c = metrics.counts(scored(spark, d), ["l_suppkey", "grp"], "y", F.col("score") >= 0.3)
    return fill(metrics.confusion_summary(c, ["grp"]))


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "ghi" and k[1:2].isdigit() and callable(f)}
QUERIES |= {"g10_jitter_scale": _augment("jitter_scale"), "g11_augment_minority": _augment("jitter")}

_UQ = lambda seed, key: f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0)"
_M8 = MATRIX + ", m8 AS (SELECT id, y, label, vec FROM m)"
_DIST = "sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a.vec[i] - b.vec[i]) ** 2)))"
_CM = "count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn, count(*) FILTER (y = 1 AND p) AS tp"
_RATES = f"""{r('(tn + tp) / (tn + fp + fn + tp)')} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {r('coalesce(tn / nullif(tn + fp, 0), 0)')} AS specificity,
 {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, CASE WHEN tp > 0 THEN {r('5 * tp / (5 * tp + 4 * fn + fp)')} END AS f2, {r('(fp + fn) / (tn + fp + fn + tp)')} AS mse"""
_CURVE = lambda keys: f"c0 AS (SELECT {keys}, score, count(*) AS n, sum(y) AS pos FROM s GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS np, sum(n - pos) OVER (PARTITION BY {keys}) AS nn FROM c0 WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))"
_CS = "cs AS (SELECT f, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1, var_pop(v) FILTER (y = 0) AS p0, var_pop(v) FILTER (y = 1) AS p1, var_samp(v) FILTER (y = 0) AS s0, var_samp(v) FILTER (y = 1) AS s1, corr(v, y) AS co, covar_samp(v, y) AS cv, stddev_pop(v) AS sv, stddev_pop(y) AS sy FROM lm GROUP BY 1)"
_MI = lambda src: f"jt AS (SELECT f, v, y, count(*) AS c FROM {src} GROUP BY ALL), mi AS (SELECT f, greatest(0, sum(c / n * ln(c * n / (a * b)))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY f, v) AS a, sum(c) OVER (PARTITION BY f, y) AS b, sum(c) OVER (PARTITION BY f) AS n FROM jt) GROUP BY 1)"
_IDX = f"{_CS}, qq AS (SELECT f, quantile_cont(v, [{', '.join(str(k / 8) for k in range(1, 8))}]) AS q FROM lm GROUP BY 1), lb AS (SELECT f, y, len(list_filter(q, lambda z: z <= v)) AS v FROM lm JOIN qq USING (f)), {_MI('lb')}, ix AS (SELECT f, (m1 - m0) ** 2 / (p0 + p1 + 1e-10) AS fisher, abs(co) AS correlation, abs((m1 - m0) / sqrt(s1 / n1 + s0 / n0)) AS t, mi FROM cs JOIN mi USING (f)), sx AS (SELECT f, " + ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in ("fisher", "correlation", "t", "mi")) + " FROM ix)"
_AUC = "sum(pos * rank) AS r, sum(pos) AS p, sum(n - pos) AS q"
_RK = lambda keys, src, v: f"c0 AS (SELECT {keys}, {v} AS score, count(*) AS n, sum(y) AS pos FROM {src} GROUP BY ALL), rk AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY score) - n + (n + 1) / 2 AS rank FROM c0), au AS (SELECT {keys}, (r - p * (p + 1) / 2) / nullif(p * q, 0) AS auc FROM (SELECT {keys}, {_AUC} FROM rk GROUP BY 1))"
_LO, _HI = "(SELECT count(*) FROM m8 WHERE y = 1)", "(SELECT count(*) FROM m8 WHERE y = 0)"
_SMOTE = f"{_M8}, nr AS (SELECT a.id AS parent, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM m8 a JOIN m8 b ON a.id <> b.id WHERE a.y = 1 AND b.y = 1), nl AS (SELECT parent, list(id ORDER BY k) AS near FROM nr WHERE k <= 5 GROUP BY 1), pl AS (SELECT id AS parent, vec AS va, row_number() OVER (ORDER BY md5('21:' || id), id) AS place FROM m8 WHERE y = 1), nw AS (SELECT unnest(generate_series(1, CAST(floor({_HI} * 0.5) AS BIGINT) - {_LO})) AS n), pk AS (SELECT n, pl.parent, va, near[CAST(floor({_UQ(22, 'n')} * len(near)) AS INTEGER) + 1] AS neighbour, {_UQ(23, 'n')} AS u FROM nw JOIN pl ON place = (n - 1) % {_LO} + 1 JOIN nl ON nl.parent = pl.parent)"
_SMOTED = _SMOTE + ", al AS (SELECT id, y, vec FROM m8 UNION ALL SELECT -n, 1, list_transform(generate_series(1, 64), lambda i: va[i] + u * (b.vec[i] - va[i])) FROM pk JOIN m8 b ON b.id = neighbour)"
ORACLES = {
    "g1_random_undersample": f"WITH {MATRIX} SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('9:' || id), id) AS k FROM m) WHERE y = 1 OR k <= floor((SELECT count(*) FROM m WHERE y = 1) / 0.5)",
    "g2_smote": f"WITH {_SMOTE} SELECT n, parent, neighbour, {r('va[1] + u * (b.vec[1] - va[1])')} AS v1, {r('va[8] + u * (b.vec[8] - va[8])')} AS v8 FROM pk JOIN m8 b ON b.id = neighbour",
    "g7_smote_tomek": f"WITH {_SMOTED}, n2 AS (SELECT a.id AS a, b.id AS b, a.y AS ya, b.y AS yb, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM al a JOIN al b ON a.id <> b.id), n1 AS (SELECT * FROM n2 WHERE k = 1) SELECT id, y FROM al WHERE id NOT IN (SELECT x.a FROM n1 x JOIN n1 z ON x.a = z.b AND x.b = z.a WHERE x.ya = 0 AND x.yb = 1)",
    "g7_smote_enn": f"WITH {_SMOTED}, n2 AS (SELECT a.id AS a, b.y AS yb, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM al a JOIN al b ON a.id <> b.id WHERE a.y = 0) SELECT id, y FROM al WHERE id NOT IN (SELECT a FROM n2 WHERE k <= 3 AND yb = 1)",
    "g8_smote_rus": f"WITH {_SMOTED} SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('9:' || id), id) AS k FROM al) WHERE y = 1 OR k <= floor((SELECT count(*) FROM al WHERE y = 1) / 0.8)",
    "g3_adasyn": f"WITH {_M8}, nr AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM m8 a JOIN m8 b ON a.id <> b.id WHERE a.y = 1), sh AS (SELECT id, avg(1 - y) AS share FROM nr WHERE k <= 5 GROUP BY 1) SELECT id, {r('share')} AS share, CAST(round(share / (SELECT sum(share) FROM sh) * ({_HI} - {_LO})) AS BIGINT) AS new_rows FROM sh",
    "g3_adasyn_rows": f"WITH {_M8}, nr AS (SELECT a.id, b.id AS other, b.y, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k, row_number() OVER (PARTITION BY a.id, b.y ORDER BY {_DIST}, b.id) AS ky FROM m8 a JOIN m8 b ON a.id <> b.id WHERE a.y = 1), sh AS (SELECT id, avg(1 - y) AS share FROM nr WHERE k <= 5 GROUP BY 1), nw AS (SELECT id AS parent, unnest(generate_series(1, CAST(round(share / (SELECT sum(share) FROM sh) * ({_HI} - {_LO})) AS BIGINT))) AS i FROM sh), nl AS (SELECT id AS parent, list(other ORDER BY ky) AS near FROM nr WHERE y = 1 AND ky <= 5 GROUP BY 1), pk AS (SELECT parent, i, near[CAST(floor({_UQ(32, 'parent || $$:$$ || i')} * len(near)) AS INTEGER) + 1] AS neighbour, {_UQ(33, 'parent || $$:$$ || i')} AS u FROM nw JOIN nl USING (parent)) SELECT parent, i, neighbour, {r('a.vec[1] + u * (b.vec[1] - a.vec[1])')} AS v1, {r('a.vec[8] + u * (b.vec[8] - a.vec[8])')} AS v8 FROM pk JOIN m8 a ON a.id = parent JOIN m8 b ON b.id = neighbour",
    "g12_sigma_modes": f"WITH {long_matrix(N)}, p AS (SELECT f, abs(avg(v)) / stddev_pop(v) AS snr, stddev_pop(v) / abs(avg(v)) AS cv, (avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) ** 2 AS gap, stddev_pop(v) FILTER (y = 1) AS s1, stddev_pop(v) FILTER (y = 1) / (abs(avg(v) FILTER (y = 1)) + 1e-10) AS cv1 FROM lm GROUP BY 1), s AS (SELECT median(snr) AS snr, median(cv) AS cv, sqrt(sum(gap)) AS gap, avg(s1) AS s1, median(cv1) AS cv1 FROM p), w AS (SELECT 'snr' AS method, greatest(0.005, least(0.1, 0.1 / (1 + snr))) AS j, greatest(0.02, least(0.2, cv * 0.5)) AS c FROM s UNION ALL SELECT 'cv', greatest(0.01, least(0.1, cv * 0.1)), greatest(0.05, least(0.2, cv * 0.3)) FROM s UNION ALL SELECT 'interclass', greatest(0.005, least(0.1, s1 / gap * 0.5)), greatest(0.02, least(0.15, cv1 * 0.3)) FROM s UNION ALL SELECT 'conservative', 0.01, 0.05) SELECT method, {r('j')} AS jitter_sigma, {r('c')} AS scale_sigma FROM w",
    "g13_augmentation_overlap": f"WITH {long_matrix(N)}, c AS (SELECT f, avg(v) FILTER (y = 1) AS m1, avg(v) FILTER (y = 0) AS m0, stddev_pop(v) FILTER (y = 1) AS s1 FROM lm GROUP BY 1), nw AS (SELECT id, f, v * 1.1 + 0.05 AS v FROM lm WHERE y = 1), a AS (SELECT sqrt(sum((m - m1) ** 2)) / (sqrt(sum(m1 ** 2)) + 1e-10) AS shift, (avg(s) - avg(s1)) / (avg(s1) + 1e-10) AS change FROM (SELECT f, avg(v) AS m, stddev_pop(v) AS s FROM nw GROUP BY 1) JOIN c USING (f)), o AS (SELECT avg(d1) / (avg(d0) + 1e-10) AS score FROM (SELECT id, sqrt(sum((v - m1) ** 2)) AS d1, sqrt(sum((v - m0) ** 2)) AS d0 FROM nw JOIN c USING (f) GROUP BY 1)) SELECT {r('shift')} AS mean_shift, {r('change')} AS std_change, {r('score')} AS overlap_score FROM a, o",
    "g9_subjectwise_smote": f"WITH {MATRIX}, m8 AS (SELECT id, id % 3 AS subject, CAST(label < 3 AS INTEGER) AS y, vec FROM m), nr AS (SELECT a.id AS parent, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM m8 a JOIN m8 b ON a.subject = b.subject AND a.id <> b.id WHERE a.y = 1 AND b.y = 1), nl AS (SELECT parent, list(id ORDER BY k) AS near FROM nr WHERE k <= 5 GROUP BY 1), pl AS (SELECT subject, id AS parent, vec AS va, row_number() OVER (PARTITION BY subject ORDER BY md5('5:' || id), id) AS place FROM m8 WHERE y = 1), sz AS (SELECT subject, sum(y) AS lo, sum(1 - y) AS hi FROM m8 GROUP BY 1), nw AS (SELECT subject, lo, unnest(generate_series(1, CAST(floor(hi * 0.8) AS BIGINT) - CAST(lo AS BIGINT))) AS n FROM sz WHERE lo >= 2), pk AS (SELECT nw.subject, n, pl.parent, va, near[CAST(floor({_UQ(6, 'nw.subject || $$:$$ || n')} * len(near)) AS INTEGER) + 1] AS neighbour, {_UQ(7, 'nw.subject || $$:$$ || n')} AS u FROM nw JOIN pl ON pl.subject = nw.subject AND place = (n - 1) % lo + 1 JOIN nl ON nl.parent = pl.parent) SELECT pk.subject, n, parent, neighbour, {r('va[1] + u * (b.vec[1] - va[1])')} AS v1, {r('va[8] + u * (b.vec[8] - va[8])')} AS v8 FROM pk JOIN m8 b ON b.id = neighbour",
    "g5_tomek_links": f"WITH {_M8}, nr AS (SELECT a.id AS a, b.id AS b, a.y AS ya, b.y AS yb, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM m8 a JOIN m8 b ON a.id <> b.id), n1 AS (SELECT * FROM nr WHERE k = 1) SELECT id FROM m8 WHERE id NOT IN (SELECT x.a FROM n1 x JOIN n1 z ON x.a = z.b AND x.b = z.a WHERE x.ya = 0 AND x.yb = 1)",
    "g6_enn": f"WITH {_M8}, nr AS (SELECT a.id AS a, b.y AS yb, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM m8 a JOIN m8 b ON a.id <> b.id WHERE a.y = 0) SELECT id FROM m8 WHERE id NOT IN (SELECT a FROM nr WHERE k <= 3 AND yb = 1)",
    "g9_subjectwise_rus": f"WITH {SCORED} SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, y ORDER BY md5('9:' || row_id), row_id) AS k, sum(y) OVER (PARTITION BY l_suppkey) AS lo FROM s) WHERE y = 1 OR lo = 0 OR k <= floor(lo / 0.8)",
    "g12_adaptive_sigma": f"WITH {long_matrix(N)}, p AS (SELECT f, abs(avg(v)) / stddev_pop(v) AS snr, stddev_pop(v) / abs(avg(v)) AS cv, abs(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / stddev_pop(v) AS d FROM lm GROUP BY 1) SELECT {r('median(snr)')} AS snr, {r('median(cv)')} AS cv, {r('median(d)')} AS interclass FROM p",
    "g13_augmentation_quality": f"WITH {long_matrix(N)} SELECT f, {r('avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)')} AS shift, {r('stddev_pop(v) FILTER (y = 1) / stddev_pop(v) FILTER (y = 0) - 1')} AS sigma_change FROM lm GROUP BY 1",
    "g16_class_weights": f"WITH {SCORED} SELECT y, {r('sum(count(*)) OVER () / (2 * count(*))')} AS weight FROM s GROUP BY 1",
    "g17_expected_class_counts": "WITH o AS (SELECT o_orderkey, list_extract(['rus', 'smote', 'baseline'], CAST(o_orderkey % 3 + 1 AS INTEGER)) AS method, o_custkey + 100 AS neg, o_custkey % 50 + 1 AS pos FROM orders) SELECT *, CASE WHEN method = 'rus' THEN least(neg, CAST(floor(pos / 0.5) AS BIGINT)) ELSE neg END AS expected_neg, CASE WHEN method = 'smote' THEN greatest(pos, CAST(floor(neg * 0.5) AS BIGINT)) ELSE pos END AS expected_pos FROM o",
    "h1_fisher_index": f"WITH {long_matrix(N)}, {_CS} SELECT f, {r('(m1 - m0) ** 2 / (p0 + p1 + 1e-10)')} AS fisher, {r('abs(m1 - m0) / (s1 + s0 + 1e-6)')} AS fisher2 FROM cs",
    "h2_label_correlation": f"WITH {long_matrix(N)}, {_CS} SELECT f, {r('abs(co)')} AS correlation, {r('cv / (sv * sy + 1e-12)')} AS correlation2 FROM cs",
    "h3_welch_t": f"WITH {long_matrix(N)}, {_CS} SELECT f, {r('abs((m1 - m0) / sqrt(s1 / n1 + s0 / n0))')} AS t, {r('abs(m1 - m0) / sqrt(s1 / n1 + s0 / n0 + 1e-6)')} AS t2 FROM cs",
    "h4_mutual_information": f"WITH {long_matrix(N)}, lr AS (SELECT f, y, round(v, 1) AS v FROM lm), {_MI('lr')} SELECT f, {r('mi')} AS mi FROM mi",
    "h5_feature_index_table": f"WITH {long_matrix(N)}, {_IDX} SELECT f, {r('fisher')} AS fisher, {r('correlation')} AS correlation, {r('t')} AS t, {r('mi')} AS mi FROM sx",
    "h6_anova_f": f"WITH {long_matrix(N)}, g AS (SELECT f, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM lm GROUP BY 1, 2), t AS (SELECT f, sum(n) AS nn, count(*) AS c, sum(n * m) / sum(n) AS gm, sum(n * m * m) AS q, sum(n * s) AS w FROM g GROUP BY 1), z AS (SELECT f, (q - nn * gm * gm) / (c - 1) / (w / (nn - c)) AS f_stat FROM t) SELECT f, {r('f_stat')} AS f_stat, CAST(row_number() OVER (ORDER BY z.f_stat DESC, f) AS INTEGER) AS rank FROM z QUALIFY rank <= 5",
    "h9_fuzzy_importance": f"WITH {long_matrix(N)}, {_IDX}, lv AS (SELECT unnest(range(3)) AS k), ru AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, CASE WHEN a.k + b.k + c.k + d.k >= 6 THEN 1.0 WHEN a.k + b.k + c.k + d.k >= 3 THEN 0.5 ELSE 0 END AS w FROM lv a, lv b, lv c, lv d), fi AS (SELECT f, w, exp(-0.5 * ((fisher - a / 2) / (0.2 + 1e-10)) ** 2) * exp(-0.5 * ((correlation - b / 2) / (0.2 + 1e-10)) ** 2) * exp(-0.5 * ((t - c / 2) / (0.2 + 1e-10)) ** 2) * exp(-0.5 * ((mi - d / 2) / (0.2 + 1e-10)) ** 2) AS x FROM sx, ru), im AS (SELECT f, sum(w * x) / (sum(x) + 1e-10) AS v FROM fi GROUP BY 1) SELECT f, {r('v')} AS importance, v > 0.5 OR max(v) OVER () <= 0.5 AS selected FROM im",
    "h10_univariate_auc": f"WITH {long_matrix(N)}, {_RK('f', 'lm', 'v')} SELECT f, {r('greatest(auc, 1 - auc)')} AS auc FROM au",
    "i6_roc_curve": f"WITH {SCORED}, {_CURVE('grp')} SELECT grp, {r('score')} AS thr, {r('fp / nn')} AS fpr, {r('tp / np')} AS tpr FROM c",
    "i6_roc_auc": f"WITH {SCORED}, {_RK('l_suppkey', 's', 'score')} SELECT l_suppkey, {r('CASE WHEN auc < 0.5 THEN 1 - auc ELSE auc END')} AS auc, auc < 0.5 AS inverted FROM au",
    "i7_pr_curve": f"WITH {SCORED}, {_CURVE('grp')} SELECT grp, {r('score')} AS thr, {r('tp / (tp + fp)')} AS precision, {r('tp / np')} AS recall FROM c",
    "i7_average_precision": f"WITH {SCORED}, {_CURVE('l_suppkey')} SELECT l_suppkey, {r('sum(pos / nullif(np, 0) * tp / (tp + fp))')} AS auc_pr FROM c GROUP BY 1",
    "i8_classification_metrics": f"WITH {SCORED}, k AS (SELECT grp, {_CM} FROM (SELECT *, score >= 0.3 AS p FROM s) GROUP BY 1) SELECT *, {_RATES} FROM k",
    "i9_class_report": f"WITH {SCORED}, q AS (SELECT y, CAST(score >= 0.3 AS INTEGER) AS p FROM s), k AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS g, count(*) FILTER (y = c AND p = c) AS h FROM q, (SELECT unnest([0, 1]) AS c) GROUP BY 1) SELECT c AS class, {r('coalesce(h / nullif(g, 0), 0)')} AS precision, {r('coalesce(h / nullif(support, 0), 0)')} AS recall, {r('coalesce(2 * h / nullif(g + support, 0), 0)')} AS f1, support FROM k",
    "i10_fbeta": f"WITH {SCORED}, k AS (SELECT l_suppkey, {_CM} FROM (SELECT *, score >= 0.3 AS p FROM s) GROUP BY 1) SELECT l_suppkey, CASE WHEN tp > 0 THEN {r('5 * tp / (5 * tp + 4 * fn + fp)')} END AS f2 FROM k",
    "i11_precision_at_min_recall": f"WITH {SCORED}, {_CURVE('l_suppkey')} SELECT l_suppkey, {r('coalesce(max(tp / (tp + fp)) FILTER (coalesce(tp / nullif(np, 0), 0) >= 0.7), 0)')} AS precision FROM c GROUP BY 1",
    "i12_best_threshold_pr": f"WITH {SCORED}, {_CURVE('grp')}, q AS (SELECT grp, score, round(5 * (tp / (tp + fp)) * (tp / np) / (4 * tp / (tp + fp) + tp / np + 1e-8), 12) AS f FROM c) SELECT grp, {r('score')} AS thr, {r('f')} AS fbeta FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f DESC, score) AS k FROM q) WHERE k = 1",
    "i13_best_threshold_grid": f"WITH {SCORED}, g AS (SELECT unnest(range(101)) AS k), q AS (SELECT grp, k, count(*) FILTER (floor(score / 0.01 + 1e-9) >= k) AS a, sum(y) FILTER (floor(score / 0.01 + 1e-9) >= k) AS tp, sum(y) AS np FROM s, g GROUP BY 1, 2), f AS (SELECT grp, k, round(coalesce(2 * tp / nullif(np + a, 0), 0), 12) AS f FROM q) SELECT grp, {r('k * 0.01')} AS thr, {r('f')} AS fbeta FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f DESC, k) AS n FROM f) WHERE n = 1",
    "i14_apply_threshold": f"WITH {SCORED} SELECT row_id, CAST(score >= 0.25 AS INTEGER) AS pred FROM s",
    "i15_score_spread": f"WITH {SCORED} SELECT grp, {r('stddev_pop(score)')} AS sigma, {r('avg(CAST(score >= 0.5 AS INTEGER))')} AS positive_rate FROM s GROUP BY 1",
    "i16_subject_metrics": f"WITH {SCORED}, k AS (SELECT l_suppkey, {_CM} FROM (SELECT *, score >= 0.3 AS p FROM s) GROUP BY 1) SELECT *, {_RATES} FROM k WHERE tp + fn > 0",
    "i17_ensemble": f"WITH {SCORED}, l AS (SELECT row_id, score AS v, 1 AS w FROM s UNION ALL SELECT row_id, 1 - score, 2 FROM s UNION ALL SELECT row_id, score / 2, 3 FROM s) SELECT row_id, count(*) FILTER (v >= 0.5) > count(*) / 2 AS majority, max(v) >= 0.5 AS any_positive, {r('avg(v)')} AS mean, {r('sum(v * w) / sum(w)')} AS weighted FROM l GROUP BY 1",
    "i19_trial_convergence": f"WITH b AS (SELECT user_id, event_id, value, max(value) OVER w AS best, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, {r('value')} AS value, {r('best')} AS best, {r('best - lag(best, 10) OVER (PARTITION BY user_id ORDER BY event_id)')} AS gain, {r('rolling')} AS rolling FROM b",
    "i20_mean_roc": f"WITH {SCORED}, s2 AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 5 + l_tax AS score, l_linestatus AS grp, l_linenumber AS l_suppkey FROM lineitem), {_CURVE('grp, l_suppkey').replace('FROM s ', 'FROM s2 ')}, pt0 AS (SELECT grp, l_suppkey, fp / nn AS fpr, tp / np AS tpr FROM c WHERE nn > 0 AND np > 0), pt AS (SELECT grp, l_suppkey, fpr, max(tpr) AS tpr FROM (SELECT * FROM pt0 UNION ALL SELECT DISTINCT grp, l_suppkey, 0, 0 FROM pt0 UNION ALL SELECT DISTINCT grp, l_suppkey, 1, 1 FROM pt0) GROUP BY 1, 2, 3), sg AS (SELECT *, lead(fpr) OVER w AS x1, lead(tpr) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY grp, l_suppkey ORDER BY fpr)), gr AS (SELECT grp, k, CASE WHEN x1 IS NULL THEN tpr ELSE tpr + (y1 - tpr) * (k / 500 - fpr) / (x1 - fpr) END AS y FROM sg JOIN (SELECT unnest(range(501)) AS k) ON k >= ceil(fpr * 500 - 1e-9) AND k <= coalesce(ceil(x1 * 500 - 1e-9) - 1, 500)) SELECT grp, CAST(k AS INTEGER) AS k, {r('avg(y)')} AS mean, {r('stddev_pop(y)')} AS sigma FROM gr GROUP BY 1, 2",
    "i21_auc_trapezoid": f"WITH {SCORED}, {_CURVE('l_suppkey')}, z AS (SELECT l_suppkey, fp / nullif(nn, 0) AS x, tp / nullif(np, 0) AS y, coalesce(lag(fp / nullif(nn, 0)) OVER w, 0) AS x0, coalesce(lag(tp / nullif(np, 0)) OVER w, 0) AS y0 FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY score DESC)) SELECT l_suppkey, {r('sum((x - x0) * (y + y0) / 2)')} AS auc FROM z GROUP BY 1",
    "i22_threshold_compare": f"WITH {SCORED}, g AS (SELECT unnest(range(1001)) AS k), q AS (SELECT grp, k, count(*) FILTER (floor(score / 0.001 + 1e-9) >= k) AS a, sum(y) FILTER (floor(score / 0.001 + 1e-9) >= k) AS tp, sum(y) AS np FROM s, g GROUP BY 1, 2), f AS (SELECT grp, k, round(coalesce(2 * tp / nullif(np + a, 0), 0), 12) AS f FROM q), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f DESC, k) AS n FROM f), x AS (SELECT grp, 2 * count(*) FILTER (y = 1 AND score >= 0.5) / nullif(sum(y) + count(*) FILTER (score >= 0.5), 0) AS f1 FROM s GROUP BY 1) SELECT grp, {r('k * 0.001')} AS thr, {r('f')} AS f1_best, {r('coalesce(f1, 0)')} AS f1_fixed FROM b JOIN x USING (grp) WHERE n = 1",
    "i23_confusion_summary": f"WITH {SCORED}, k AS (SELECT grp, {_CM} FROM (SELECT *, score >= 0.3 AS p FROM s) GROUP BY 1) SELECT *, {r('coalesce(fp / nullif(fp + tn, 0), 0)')} AS fpr, {r('coalesce(fn / nullif(fn + tp, 0), 0)')} AS fnr FROM k",
}
