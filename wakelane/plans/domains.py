"""Queries over distances and groups (2.K), and over collected tables (2.L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakelane.operators import domain, tables
from wakelane.plans.base import GRID, MATRIX, features, fill, grid, long_matrix, matrix, r, read
from wakelane.sources.files import latest_per_key

#: Components of the given vectors; all of them are features.
N = 64


def _long(spark, d):
    return features(matrix(spark, d), N).select(F.col("label").alias("s"), "f", "v", "id")


def _means(spark, d):
    return _long(spark, d).groupBy("s", "f").agg(F.avg("v").alias("m"))


def _subjects(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s")).agg((F.avg("c_acctbal") / 1000).alias("x"))


def _d(spark, d):
    """Distances between nations by their customers' mean balance: all rows, and as many subjects as there are nations."""
    s = _subjects(spark, d)
    return domain.pair_rows(s, ["x"]).select("a", "b", F.abs(F.col("x_a") - F.col("x_b")).alias("d"))


def _groups(spark, d):
    return _subjects(spark, d).select("s", (F.col("s") % 3).alias("g"))


def _scores(spark, d):
    return domain.rank_scores(_d(spark, d)).select(F.col("a").alias("s"), F.round("knn", 9).alias("score"))


def k1_mmd(spark, d):
    return fill(domain.mmd(matrix(spark, d).select("id", F.col("label").alias("s"), "vec")))


def k2_wasserstein(spark, d):
    li = read(spark, d, "lineitem")
    rows = li.select(F.col("l_linenumber").alias("s"), F.explode(F.array(F.struct(F.lit("q").alias("f"), F.col("l_quantity").alias("v")), F.struct(F.lit("x").alias("f"), (F.col("l_discount") * 100).alias("v")))).alias("r"))
    return fill(domain.wasserstein(rows.select("s", "r.f", "r.v")))


def k3_dtw(spark, d):
    # A subject is an event type; its series are the means of the days.
    days = read(spark, d, "events").groupBy(F.col("event_type").alias("s"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return fill(domain.dtw(days.groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "v"))), lambda x: x.v).alias("x"))), 4)


def k4_vector_distance(spark, d):
    m = _means(spark, d)
    rows = domain.vector_distance(m).withColumnRenamed("d", "euclidean")
    return fill(rows.join(domain.vector_distance(m, "cityblock").withColumnRenamed("d", "cityblock"), ["a", "b"]).join(domain.vector_distance(m, "cosine").withColumnRenamed("d", "cosine"), ["a", "b"]))


def k5_pairwise_distance(spark, d):
    return fill(domain.both_ways(domain.vector_distance(_means(spark, d))))


def k6_distance_stats(spark, d):
    return fill(domain.distance_stats(_d(spark, d)))


def k6_overall_stats(spark, d):
    return fill(domain.overall_stats(_d(spark, d)))


def k7_group_distance(spark, d):
    return fill(domain.group_distance(_d(spark, d), _groups(spark, d)))


def k8_intra_inter_nn(spark, d):
    return fill(domain.intra_inter_nn(_d(spark, d), _groups(spark, d), 0, 1))


def k9_rank_scores(spark, d):
    return fill(domain.rank_scores(_d(spark, d)))


def k10_medoid_rank(spark, d):
    return fill(domain.medoid_rank(_d(spark, d)))


def k11_centroid_rank(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return fill(domain.centroid_rank(s))


def k12_lof_rank(spark, d):
    return fill(domain.lof_rank(matrix(spark, d).select("id", "vec"), 5))


def k13_isolation_forest(spark, d):
    return fill(domain.isolation_forest_rank(matrix(spark, d).select("id", "vec"), 100, 256))


def k14_assign_levels(spark, d):
    return domain.assign_levels(_scores(spark, d), 3).select("s", "level")


def k15_split2_groups(spark, d):
    return domain.split2_groups(_scores(spark, d), 4)


def k16_rank_export(spark, d):
    return domain.rank_export(_scores(spark, d), 2)


def k17_group_overlap(spark, d):
    mean = domain.rank_scores(_d(spark, d)).select(F.col("a").alias("s"), F.round("mean", 9).alias("score"))
    return fill(domain.group_overlap(domain.assign_levels(_scores(spark, d), 3), domain.assign_levels(mean, 3)))


def k18_icc_ratio(spark, d):
    return fill(domain.icc_ratio(_long(spark, d)))


def k19_correlation_structure(spark, d):
    return fill(domain.correlation_structure(matrix(spark, d).select(*(F.col("vec")[i].alias(f"c{i}") for i in range(N))), [f"c{i}" for i in range(N)]))


def k19_pca_components(spark, d):
    return domain.pca_components(matrix(spark, d).select("vec"))


def k20_signal_contribution(spark, d):
    return fill(domain.signal_contribution(_long(spark, d).withColumn("family", F.col("f") % 2), "family"))


def k21_project2d(spark, d):
    p = domain.project2d(matrix(spark, d).select("id", "vec"))
    return fill(p.select("id", F.abs("x").alias("x"), F.abs("y").alias("y")), 4)


def k22_kmeans(spark, d):
    return domain.kmeans(matrix(spark, d).select("id", "vec"), 3).groupBy("cluster").agg(F.count("*").alias("n"))


def k22_dbscan(spark, d):
    return domain.dbscan(_d(spark, d))


def k22_dbscan_points(spark, d):
    """Customers by nation and balance; a cluster is a run of balances close together in a nation."""
    points = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_nationkey") * 10).cast("double"), F.col("c_acctbal") / 100).alias("vec"))
    return domain.dbscan_points(points, 0.5, 3)


def k22_spectral(spark, d):
    return domain.spectral(_d(spark, d), 2)


def k23_cluster_centroids(spark, d):
    return fill(domain.cluster_centroids(matrix(spark, d).select("id", F.col("label").alias("g"), "vec")))


def k24_distance_vs_delta(spark, d):
    deltas = _groups(spark, d).groupBy("g").agg(F.sum("s").cast("double").alias("delta"))
    return fill(domain.distance_vs_delta(_d(spark, d), _groups(spark, d), deltas))


def l1_latest_per_key(spark, d):
    return latest_per_key(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


def l2_load_grid(spark, d):
    g = grid(spark, d)
    named = g.where(F.col("seed") != 2).withColumn("ratio", F.when(F.col("level") == "O", 0.1).otherwise(0.5))
    return tables.load_grid(named, g.where("condition = '1-URGENT' AND seed = 2").drop("auc"), ratio="ratio", where={"seed": [1, 2, 3, 5, 7]})


def l3_summary_table(spark, d):
    return fill(tables.summary_table(grid(spark, d), "condition", "mode", ["A", "N", "R"], "f2"))


def l4_comparison_table(spark, d):
    return fill(tables.comparison_table(grid(spark, d), ["condition", "distance"], "mode", "A", "R", "f2"))


def l5_improvement_summary(spark, d):
    return fill(tables.improvement_summary(l4_comparison_table(spark, d), ["distance"]))


def l6_read_test_row(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("split"))
    return tables.read_test_row(li, ["l_orderkey"], "split", "l_linenumber", "R")


def l7_source_target_pivot(spark, d):
    return fill(tables.source_target_pivot(grid(spark, d), "condition", "mode", "A", "N", ["f2", "recall"]))


def l8_pooled_tables(spark, d):
    return fill(tables.pooled_table(grid(spark, d), "condition", "f2", "level", ["F", "O"]))


def l8_ranking_table(spark, d):
    return fill(tables.ranking_table(grid(spark, d), "condition", ["mode", "distance"], "f2", 3))


def l9_top_k(spark, d):
    return fill(read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m")).orderBy(F.desc(F.round("m", 9)), "l_suppkey").limit(10))


def l10_set_operations(spark, d):
    o, c = read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    common, rest = o.intersect(c), c.exceptAll(o.distinct())
    return common.select("k", F.lit("both").alias("side")).unionByName(rest.select("k", F.lit("rest").alias("side"))).dropDuplicates()


def l11_ordered_sort(spark, d):
    rows = grid(spark, d).groupBy("condition", "level").agg(F.count("*").alias("n"))
    return tables.ordered_sort(rows, "level", ["F", "O"], ["condition"]).select("place", "condition", "n")


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "kl" and k[1:2].isdigit() and callable(f)}

_D = "su AS (SELECT c_nationkey AS s, avg(c_acctbal) / 1000 AS x FROM customer GROUP BY 1), d AS (SELECT p.s AS a, q.s AS b, abs(p.x - q.x) AS d FROM su p JOIN su q ON p.s < q.s), f AS (SELECT * FROM d UNION ALL SELECT b, a, d FROM d)"
_KNN = "kn AS (SELECT a AS s, avg(d) AS mean, median(d) AS median, avg(d) FILTER (k <= 5) AS knn FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM f) GROUP BY 1)"
_LEVEL = lambda c, name: f"{name} AS (SELECT s, CASE WHEN i >= n - 3 THEN 'in_domain' WHEN i >= n // 2 - 1 AND i < n // 2 + 2 THEN 'mid_domain' WHEN i < 3 THEN 'out_domain' END AS level FROM (SELECT s, row_number() OVER (ORDER BY round({c}, 9) DESC, s) - 1 AS i, count(*) OVER () AS n FROM kn))"
_LM = long_matrix(N) + ", mn AS (SELECT label AS s, f, avg(v) AS m FROM lm GROUP BY 1, 2)"
_G = lambda body, more="": f"WITH {GRID}{', ' + more if more else ''} {body}"
_PIV = "pv AS (SELECT condition, distance, avg(f2) FILTER (mode = 'A') AS \"A\", avg(f2) FILTER (mode = 'R') AS \"R\" FROM g GROUP BY 1, 2)"
#: Clusters by their definition: links of near points, cores, all that cores reach through cores, borders.
_CLUSTERS = "deg AS (SELECT a FROM lk GROUP BY a HAVING count(*) >= 2), cl AS (SELECT a, b FROM lk WHERE a IN (SELECT a FROM deg) AND b IN (SELECT a FROM deg)), rc(a, l) AS (SELECT a, a FROM deg UNION SELECT cl.b, rc.l FROM rc JOIN cl ON cl.a = rc.a WHERE rc.l < cl.b), lb AS (SELECT a, min(l) AS l FROM rc GROUP BY 1), bo AS (SELECT lk.a, min(l) AS m FROM lk JOIN lb ON lb.a = lk.b GROUP BY 1) SELECT ids.s, coalesce(l, m) AS cluster FROM ids LEFT JOIN lb ON lb.a = ids.s LEFT JOIN bo ON bo.a = ids.s"
ORACLES = {
    "k22_dbscan": f"WITH RECURSIVE {_D}, {_KNN}, ids AS (SELECT s FROM su), lk AS (SELECT a, b FROM f WHERE d <= (SELECT 1.5 * avg(knn) FROM kn)), {_CLUSTERS}",
    "k22_dbscan_points": f"WITH RECURSIVE ids AS (SELECT c_custkey AS s FROM customer), lk AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_custkey <> y.c_custkey AND x.c_nationkey = y.c_nationkey AND abs(x.c_acctbal / 100 - y.c_acctbal / 100) <= 0.5), {_CLUSTERS}",
    "k1_mmd": f"WITH {MATRIX}, q AS (SELECT x.label AS la, y.label AS lb, x.id AS i, y.id AS j, list_sum(list_transform(generate_series(1, 64), lambda t: (x.vec[t] - y.vec[t]) ** 2)) AS q FROM m x, m y), pr AS (SELECT x.label AS a, y.label AS b FROM (SELECT DISTINCT label FROM m) x JOIN (SELECT DISTINCT label FROM m) y ON x.label < y.label), md AS (SELECT a, b, median(q) AS md FROM pr JOIN q ON la IN (a, b) AND lb IN (a, b) AND i < j GROUP BY 1, 2) SELECT a, b, {r('avg(exp(-q / (2 * md))) FILTER (la = a AND lb = a) + avg(exp(-q / (2 * md))) FILTER (la = b AND lb = b) - 2 * avg(exp(-q / (2 * md))) FILTER (la = a AND lb = b)')} AS d FROM md JOIN q ON la IN (a, b) AND lb IN (a, b) GROUP BY 1, 2",
    "k2_wasserstein": f"WITH v AS (SELECT l_linenumber AS s, 'q' AS f, l_quantity AS v FROM lineitem UNION ALL SELECT l_linenumber, 'x', l_discount * 100 FROM lineitem), p AS (SELECT s, f, v, count(*) / sum(count(*)) OVER (PARTITION BY s, f) AS p FROM v GROUP BY 1, 2, 3), st AS (SELECT x.s AS a, y.s AS b, p.f, p.v, sum(CASE WHEN p.s = x.s THEN p.p ELSE -p.p END) AS p FROM (SELECT DISTINCT s FROM v) x JOIN (SELECT DISTINCT s FROM v) y ON x.s < y.s JOIN p ON p.s IN (x.s, y.s) GROUP BY ALL), ar AS (SELECT a, b, f, abs(sum(p) OVER w) * (lead(v) OVER w - v) AS z FROM st WINDOW w AS (PARTITION BY a, b, f ORDER BY v)) SELECT a, b, {r('avg(w)')} AS d FROM (SELECT a, b, f, least(coalesce(sum(z), 0), 1e6) AS w FROM ar GROUP BY ALL) GROUP BY 1, 2",
    "k4_vector_distance": f"WITH {_LM} SELECT x.s AS a, y.s AS b, {r('sqrt(sum((x.m - y.m) ** 2))')} AS euclidean, {r('sum(abs(x.m - y.m))')} AS cityblock, {r('1 - sum(x.m * y.m) / sqrt(sum(x.m * x.m) * sum(y.m * y.m))')} AS cosine FROM mn x JOIN mn y ON x.f = y.f AND x.s < y.s GROUP BY 1, 2",
    "k5_pairwise_distance": f"WITH {_LM} SELECT x.s AS a, y.s AS b, {r('sqrt(sum((x.m - y.m) ** 2))')} AS d FROM mn x JOIN mn y ON x.f = y.f AND x.s <> y.s GROUP BY 1, 2",
    "k6_distance_stats": f"WITH {_D} SELECT a, {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS std FROM f GROUP BY 1",
    "k6_overall_stats": f"WITH {_D} SELECT {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS std, {r('min(d)')} AS min, {r('max(d)')} AS max FROM d",
    "k7_group_distance": f"WITH {_D} SELECT a % 3 AS ga, b % 3 AS gb, {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS std, {r('min(d)')} AS min, {r('max(d)')} AS max, {r('median(d)')} AS median FROM f WHERE a % 3 < b % 3 OR (a % 3 = b % 3 AND a < b) GROUP BY 1, 2",
    "k8_intra_inter_nn": f"WITH {_D} SELECT {r('avg(d) FILTER (b % 3 = 0)')} AS intra, {r('avg(d) FILTER (b % 3 = 1)')} AS inter, {r('(SELECT avg(m) FROM (SELECT min(d) AS m FROM f WHERE a % 3 = 0 AND b % 3 = 1 GROUP BY a))')} AS nearest, {r('avg(d) FILTER (b % 3 = 0) / avg(d) FILTER (b % 3 = 1)')} AS ratio FROM f WHERE a % 3 = 0",
    "k9_rank_scores": f"WITH {_D}, {_KNN} SELECT s AS a, {r('mean')} AS mean, {r('median')} AS median, {r('knn')} AS knn FROM kn",
    "k10_medoid_rank": f"WITH {_D}, md AS (SELECT a AS m FROM f GROUP BY 1 ORDER BY round(sum(d), 9), a LIMIT 1) SELECT a, {r('d')} AS score FROM f WHERE b = (SELECT m FROM md) UNION ALL SELECT m, {r('0.0')} FROM md",
    "k11_centroid_rank": f"SELECT s_suppkey AS s, {r('sqrt((s_acctbal / 1000 - (SELECT avg(s_acctbal / 1000) FROM supplier)) ** 2 + (s_nationkey - (SELECT avg(s_nationkey) FROM supplier)) ** 2)')} AS score FROM supplier",
    "k12_lof_rank": f"WITH {MATRIX}, nr AS (SELECT q, id, dist, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS k FROM (SELECT a.id AS q, b.id, sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a.vec[i] - b.vec[i]) ** 2))) AS dist FROM m a JOIN m b ON a.id <> b.id)), n5 AS (SELECT * FROM nr WHERE k <= 5), kd AS (SELECT q AS id, max(dist) AS kd FROM n5 GROUP BY 1), lr AS (SELECT q, 1 / (avg(greatest(dist, kd)) + 1e-10) AS l FROM n5 JOIN kd USING (id) GROUP BY 1) SELECT n5.q AS id, {r('avg(o.l) / max(lr.l)')} AS lof FROM n5 JOIN lr o ON o.q = n5.id JOIN lr ON lr.q = n5.q GROUP BY 1",
    "k14_assign_levels": f"WITH {_D}, {_KNN}, {_LEVEL('knn', 'lv')} SELECT s, level FROM lv WHERE level IS NOT NULL",
    "k15_split2_groups": f"WITH {_D}, {_KNN} SELECT s, CASE WHEN row_number() OVER (ORDER BY round(knn, 9) DESC, s) <= 4 THEN 'out_domain' ELSE 'in_domain' END AS level FROM kn",
    "k16_rank_export": f"WITH {_D}, {_KNN}, sc AS (SELECT s, round(knn, 9) AS v FROM kn) SELECT s, 'in' AS level FROM (SELECT s FROM sc ORDER BY v, s LIMIT 2) UNION ALL SELECT s, 'out' FROM (SELECT s FROM sc ORDER BY v DESC, s LIMIT 2) UNION ALL SELECT s, 'mid' FROM (SELECT s FROM sc ORDER BY abs(v - (SELECT median(v) FROM sc)), s LIMIT 2)",
    "k17_group_overlap": f"WITH {_D}, {_KNN}, {_LEVEL('knn', 'l1')}, {_LEVEL('mean', 'l2')}, j AS (SELECT coalesce(x.level, y.level) AS level, x.s IS NOT NULL AND y.s IS NOT NULL AS c FROM (SELECT * FROM l1 WHERE level IS NOT NULL) x FULL JOIN (SELECT * FROM l2 WHERE level IS NOT NULL) y ON x.s = y.s AND x.level = y.level) SELECT level, count(*) FILTER (c) AS common, {r('count(*) FILTER (c) / count(*)')} AS jaccard, count(*) FILTER (NOT c) AS switched FROM j GROUP BY 1",
    "k18_icc_ratio": f"WITH {_LM} SELECT f, {r('var_samp(m) / (var_samp(m) + avg(w))')} AS icc FROM (SELECT f, label, avg(v) AS m, var_samp(v) AS w FROM lm GROUP BY 1, 2) GROUP BY 1",
    "k19_correlation_structure": f"WITH {_LM}, c AS (SELECT abs(corr(x.v, y.v)) AS r FROM lm x JOIN lm y ON x.id = y.id AND x.f < y.f GROUP BY x.f, y.f) SELECT {r('avg(r)')} AS mean, {r('median(r)')} AS median, count(*) FILTER (r > 0.8) AS above_08, count(*) FILTER (r > 0.9) AS above_09 FROM c",
    "k20_signal_contribution": f"WITH {_LM} SELECT f % 2 AS family, {r('sum(x) / sum(sum(x)) OVER ()')} AS share FROM (SELECT f, var_samp(m) AS x FROM mn GROUP BY 1) GROUP BY 1",
    "k23_cluster_centroids": f"WITH {_LM}, e AS (SELECT f, avg(v) AS e FROM lm GROUP BY 1) SELECT g, n, {r('spread')} AS spread, {r('tg')} AS to_global FROM (SELECT label AS g, count(*) AS n, avg(q) AS spread FROM (SELECT lm.label, id, sqrt(sum((v - m) ** 2)) AS q FROM lm JOIN mn ON mn.s = lm.label AND mn.f = lm.f GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT s AS g, sqrt(sum((m - e) ** 2)) AS tg FROM mn JOIN e USING (f) GROUP BY 1) USING (g)",
    "k24_distance_vs_delta": f"WITH {_D}, gg AS (SELECT a % 3 AS g, avg(d) FILTER (a % 3 <> b % 3) AS far, avg(d) FILTER (a % 3 = b % 3) AS within FROM f GROUP BY 1), de AS (SELECT s % 3 AS g, sum(s) AS delta FROM su GROUP BY 1) SELECT {r('corr(far, delta)')} AS r_far, {r('corr(within, delta)')} AS r_within, count(*) AS n FROM gg JOIN de USING (g)",
    "l1_latest_per_key": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "l2_load_grid": _G("SELECT condition || '_r' || CASE WHEN level = 'O' THEN '01' ELSE '05' END AS condition, mode, distance, level, seed, f2, auc, recall FROM g WHERE seed IN (1, 3, 5, 7) UNION ALL SELECT condition, mode, distance, level, seed, f2, NULL, recall FROM g WHERE seed = 2 AND condition = '1-URGENT'"),
    "l3_summary_table": _G("SELECT condition, " + ", ".join(f"{r(f'avg(f2) FILTER (mode = $${m}$$)')} AS \"{m}_mean\", {r(f'stddev_samp(f2) FILTER (mode = $${m}$$)')} AS \"{m}_std\", nullif(count(*) FILTER (mode = $${m}$$), 0) AS \"{m}_n\"" for m in "ANR") + " FROM g GROUP BY 1"),
    "l4_comparison_table": _G(f"SELECT condition, distance, {r(chr(34) + 'A' + chr(34))} AS \"A\", {r(chr(34) + 'R' + chr(34))} AS \"R\", {r(chr(34) + 'R' + chr(34) + ' - ' + chr(34) + 'A' + chr(34))} AS delta FROM pv", _PIV),
    "l5_improvement_summary": _G(f"SELECT distance, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta = 0) AS tied, count(*) FILTER (delta < 0) AS worse, {r('avg(delta)')} AS mean, {r('median(delta)')} AS median FROM (SELECT distance, {r(chr(34) + 'R' + chr(34) + ' - ' + chr(34) + 'A' + chr(34))} AS delta FROM pv) WHERE delta IS NOT NULL GROUP BY 1", _PIV),
    "l6_read_test_row": "WITH li AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS split FROM lineitem GROUP BY 1, 2) SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY split = 'R' DESC, l_linenumber DESC) = 1",
    "l7_source_target_pivot": _G("SELECT condition, " + ", ".join(f"{r(f'avg({c}) FILTER (mode = $${m}$$)')} AS \"{m}_{c}\"" for m in "AN" for c in ("f2", "recall")) + " FROM g GROUP BY 1"),
    "l8_pooled_tables": _G(f"SELECT condition, {r('avg(f2)')} AS mean, {r('stddev_samp(f2)')} AS std, count(f2) AS n, {r('avg(f2) FILTER (level = $$F$$)')} AS \"F\", {r('avg(f2) FILTER (level = $$O$$)')} AS \"O\" FROM g GROUP BY 1"),
    "l8_ranking_table": _G(f"SELECT * REPLACE ({r('m')} AS m) FROM (SELECT mode, distance, condition, m, CAST(row_number() OVER (PARTITION BY mode, distance ORDER BY m DESC, condition) AS INTEGER) AS place FROM (SELECT mode, distance, condition, round(avg(f2), 9) AS m FROM g GROUP BY ALL)) WHERE place <= 3"),
    "l9_top_k": f"SELECT l_suppkey, {r('m')} AS m FROM (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1 ORDER BY round(avg(l_quantity), 9) DESC, l_suppkey LIMIT 10)",
    "l10_set_operations": "SELECT k, 'both' AS side FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION SELECT c_custkey, 'rest' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "l11_ordered_sort": _G("SELECT CAST(level = 'O' AS INTEGER) AS place, condition, count(*) AS n FROM g GROUP BY 1, 2"),
}
