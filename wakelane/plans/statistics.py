"""Queries over the result grid (2.J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakelane.functions.tails import t_quantile
from wakelane.operators import metrics, stats
from wakelane.operators.joins import paired
from wakelane.plans.base import GRID, SCORED, fill, grid, r, read, scored

#: Resamples of the bootstrap and permutation queries.
REPLICATES = 2000
CELL, A, B, FACTORS = ["mode", "distance", "level"], "1-URGENT", "2-HIGH", ["condition", "mode", "distance", "level"]


def _items(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_quantity", "l_discount", "l_tax", F.month("l_shipdate").alias("seed"))


def _pairs(spark, d):
    return paired(grid(spark, d), CELL, "seed", "condition", A, "f2").where(F.col("condition") == B)


def d6_paired(spark, d):
    return paired(grid(spark, d), CELL, "seed", "condition", A, "f2")


def j1_describe_cells(spark, d):
    return fill(stats.describe_cells(grid(spark, d), ["condition", "mode"], "f2"))


def j2_kruskal_wallis(spark, d):
    return fill(stats.kruskal_wallis(_items(spark, d), ["l_returnflag"], "l_linestatus", "l_quantity").select("l_returnflag", "N", "k", "H", "eta2"), 5)


def j3_mann_whitney(spark, d):
    return fill(stats.mann_whitney(_items(spark, d), ["l_returnflag"], "l_linestatus", "O", "F", "l_quantity").select("l_returnflag", "n", "m", "U"))


def j4_cliffs_delta(spark, d):
    return fill(stats.mann_whitney(grid(spark, d), CELL, "condition", A, B, "f2").select(*CELL, "delta", "size"))


def j5_wilcoxon(spark, d):
    return fill(stats.wilcoxon(_pairs(spark, d), CELL, "value", "base_value").select(*CELL, "n", "W"))


def j6_paired_t(spark, d):
    return fill(stats.paired_t(_pairs(spark, d), CELL, "value", "base_value").select(*CELL, "n", "t", "d", "size"))


def j7_friedman(spark, d):
    return fill(stats.friedman(grid(spark, d), ["mode"], "seed", "condition", "f2").select("mode", "n", "k", "chi2", "w"))


def j8_nemenyi(spark, d):
    return fill(stats.nemenyi(grid(spark, d), ["mode"], "seed", "condition", "f2").select("mode", "condition", "mean_rank"))


def j9_dunn(spark, d):
    return fill(stats.dunn(grid(spark, d), ["mode"], "condition", "f2").select("mode", "a", "b", "z"))


def j10_scheirer_ray_hare(spark, d):
    return fill(stats.scheirer_ray_hare(_items(spark, d), "l_returnflag", "l_linestatus", "l_quantity").select("effect", "H", "df"), 4)


def j11_brown_forsythe(spark, d):
    return fill(stats.brown_forsythe(grid(spark, d), ["mode"], "condition", "f2"))


def j12_hodges_lehmann(spark, d):
    return fill(stats.hodges_lehmann(grid(spark, d), CELL, "condition", A, B, "f2"))


def j13_shapiro_wilk(spark, d):
    return fill(stats.shapiro(grid(spark, d), ["condition", "mode"], "f2"))


def j14_adjust_p(spark, d):
    p = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.pmod(F.col("s_suppkey") * 7919, F.lit(1009)) / 10090).alias("p"))
    return fill(stats.adjust_p(p, ["s_nationkey"], "p"))


def j15_bootstrap_ci(spark, d):
    return fill(stats.bootstrap_ci(grid(spark, d), ["condition", "mode"], ["distance", "level", "seed"], "f2", REPLICATES, 3))


def j16_bootstrap_bca(spark, d):
    return fill(stats.bootstrap_bca(grid(spark, d), ["condition"], ["mode", "distance", "level", "seed"], "f2", REPLICATES, 3))


def j17_cliff_delta_ci(spark, d):
    return fill(stats.cliff_delta_ci(grid(spark, d), ["mode"], "condition", A, B, "f2", REPLICATES, 3))


def j18_permutation_test(spark, d):
    return fill(stats.permutation_test(grid(spark, d), ["mode", "level"], "condition", ["distance", "seed"], "f2", REPLICATES, 3))


def j19_t_ci(spark, d):
    return fill(stats.t_ci(grid(spark, d), ["condition", "mode"], "f2").select("condition", "mode", "half"))


def j19_required_n(spark, d):
    return stats.required_n(grid(spark, d), ["condition", "mode"], "f2", 0.005)


def j20_sigma_rank(spark, d):
    return fill(stats.sigma_rank(grid(spark, d), ["mode"], "condition", "seed", "f2", stats.subsets(spark, range(1, 13), 2)))


def j21_ci_width_by_k(spark, d):
    return fill(stats.ci_width_by_k(grid(spark, d), ["condition"], ["mode", "distance", "level", "seed"], "f2", 10, REPLICATES, 3))


def j3_p_values(spark, d):
    return fill(stats.mann_whitney(grid(spark, d), CELL, "condition", A, B, "f2").select(*CELL, "n", "m", "U", "p"))


def j22_adequacy(spark, d):
    means = grid(spark, d).groupBy("condition", "seed").agg(F.avg("f2").alias("f2"))
    return fill(stats.adequacy(means, ["condition"], "seed", "f2", chance=0.05, chance_upper=0.06, replicates=REPLICATES))


def j32_intervals(spark, d):
    return fill(stats.compare_intervals(grid(spark, d), ["mode", "distance"], "seed", "condition", A, "f2", REPLICATES))


def j22_running_adequacy(spark, d):
    return fill(stats.running_adequacy(grid(spark, d).groupBy("condition", "seed").agg(F.avg("f2").alias("f2")), ["condition"], "seed", "f2"))


def j23_domain_gap(spark, d):
    return fill(stats.domain_gap(grid(spark, d), ["condition", "mode"], "level", "F", "O", "seed", "f2"))


def j24_best_condition(spark, d):
    return stats.best_condition(grid(spark, d), ["mode", "distance"], "condition", "f2").select("mode", "distance", "best")


def j25_mean_rank(spark, d):
    return fill(stats.mean_rank(grid(spark, d), CELL, "condition", "f2"))


def j26_kendall_w(spark, d):
    return fill(stats.kendall_w(grid(spark, d), "seed", "condition", "f2"))


def j26_spearman(spark, d):
    return fill(stats.spearman(_items(spark, d), ["l_returnflag"], "l_quantity", "l_discount"))


def j26_kendall_tau(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.pmod("s_nationkey", F.lit(5)).alias("g"), F.round("s_acctbal", -2).alias("a"), F.pmod("s_suppkey", F.lit(7)).alias("b"))
    return fill(stats.kendall_tau(s, ["g"], "a", "b"))


def j26_pearson(spark, d):
    return fill(_items(spark, d).groupBy("l_suppkey").agg(F.corr("l_quantity", "l_tax").alias("r")))


def j27_linear_fit(spark, d):
    return fill(stats.linear_fit(_items(spark, d), ["l_returnflag"], "l_discount", "l_quantity"))


def j28_anova_sobol(spark, d):
    return fill(stats.sobol(grid(spark, d), FACTORS, "f2"))


def j28_sobol_total(spark, d):
    return fill(stats.sobol_total(stats.sobol(grid(spark, d), FACTORS, "f2"), FACTORS))


def j29_bootstrap_sobol(spark, d):
    return fill(stats.bootstrap_sobol(grid(spark, d), ["condition", "mode"], "f2", "seed", REPLICATES, 3))


def j30_coverage(spark, d):
    return stats.coverage(grid(spark, d), ["condition", "mode"], ["distance", "level"], "seed")


def j30_largest_rectangle(spark, d):
    c = stats.coverage(grid(spark, d).where("distance <> 'P'"), ["condition", "mode"], ["level"], "seed")
    return stats.largest_rectangle(c, "condition", "mode", 1)


def j31_min_detectable(spark, d):
    return fill(stats.min_detectable(grid(spark, d), ["condition"], "f2"))


def j32_compare_to_baseline(spark, d):
    return fill(stats.compare_to_baseline(grid(spark, d), ["mode", "distance"], "seed", "condition", A, "f2").drop("p_t", "p_w", "size").select("mode", "distance", "condition", "t", "d", "mean", "base_mean", "n"))


def j33_ci_overlap(spark, d):
    return fill(stats.ci_overlap(grid(spark, d), "condition", A, "f2"))


def j34_multiseed_confusion(spark, d):
    c = metrics.counts(scored(spark, d), ["l_suppkey", "grp"], "y", F.col("score") >= 0.3)
    return fill(stats.multiseed_confusion(c, ["grp"]))


def j35_ratio_sensitivity(spark, d):
    g = grid(spark, d)
    return fill(stats.ratio_sensitivity(g.where("seed <= 6"), g.where("seed > 6"), ["mode", "distance"], "condition", A, "f2"))


def j36_tradeoff_pattern(spark, d):
    return fill(stats.tradeoff(grid(spark, d), ["mode", "level"], "condition", A, "recall", "f2"))


def j37_rank_reversal(spark, d):
    return fill(stats.rank_reversal(grid(spark, d), "mode", ["seed", "distance", "level"], "condition", "f2"))


def j38_sobol_pairwise(spark, d):
    return fill(stats.sobol_pairwise(grid(spark, d), ["condition", "mode", "level"], "f2"))


def j39_ofat_lines(spark, d):
    return fill(stats.ofat_lines(grid(spark, d), "condition", CELL, "f2"))


def j40_block_means(spark, d):
    return fill(stats.block_means(_items(spark, d), ["l_returnflag", "l_linestatus", "seed"], "l_discount"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "jd" and k[1:2].isdigit() and callable(f)}

W = lambda body, more="": f"WITH {GRID}{', ' + more if more else ''} {body}"
_IT = "it AS (SELECT l_returnflag, l_linestatus, l_suppkey, l_quantity, l_discount, l_tax, month(l_shipdate) AS seed FROM lineitem)"
_RANK = lambda src, keys, v: f"(SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2 AS rank, count(*) OVER (PARTITION BY {keys}) AS nn FROM {src})"
_TIES = lambda src, keys, v: f"(SELECT {keys}, sum(t * t * t - t) AS ties FROM (SELECT {keys}, {v}, count(*)::DOUBLE AS t FROM {src} GROUP BY ALL) GROUP BY ALL)"
_K = "mode, distance, level"
_PR = f"pr AS (SELECT {_K}, seed, x.condition, x.f2 AS value, z.f2 AS base_value FROM g x JOIN g z USING ({_K}, seed) WHERE z.condition = '1-URGENT' AND x.condition <> '1-URGENT'), p2 AS (SELECT * FROM pr WHERE condition = '2-HIGH')"
_BL = "kk AS (SELECT mode, count(DISTINCT condition) AS k FROM g GROUP BY 1), mm AS (SELECT mode, seed, condition, avg(f2) AS f2 FROM g GROUP BY ALL), fb AS (SELECT mm.*, k FROM mm JOIN kk USING (mode) QUALIFY count(*) OVER (PARTITION BY mode, seed) = k)"
_MW = lambda v, a, b, keys: f"SELECT {keys}, sum(rank) FILTER (condition = {a}) AS ra, count(*) FILTER (condition = {a}) AS n, count(*) FILTER (condition = {b}) AS m FROM {_RANK(f'(SELECT * FROM g WHERE condition IN ({a}, {b}))', keys, v)} GROUP BY ALL HAVING n > 0 AND m > 0"
_DELTA = "(2 * (ra - n * (n + 1) / 2) / (n * m) - 1)"
_BEST = lambda where: f"(SELECT mode, distance, condition AS best, m FROM (SELECT mode, distance, condition, round(avg(f2), 9) AS m FROM g WHERE {where} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY mode, distance ORDER BY m DESC, condition) = 1)"


def _BASE(seed, *keys):
    """Where a cell's draws begin: 32 bits of md5."""
    joined = " || ':' || ".join([f"'{seed}'", *keys])
    return f"CAST(CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT) AS UBIGINT)"


def _MIX(x):
    """The 32-bit finaliser of draws."""
    m = "4294967295::UBIGINT"
    a = f"(({x})::UBIGINT & {m})"
    b = f"((xor({a}, {a} >> 16) * 2146121005::UBIGINT) & {m})"
    c = f"((xor({b}, {b} >> 15) * 2221713035::UBIGINT) & {m})"
    return f"xor({c}, {c} >> 16)"


def _BOOT(table, keys, order, v, seed, draws="n", name="b", base=lambda x: x):
    """CTEs: <name>d (keys, b, j, v: draws with replacement) and <name>m (keys, b, m: their means)."""
    k = ", ".join(keys)
    same = " AND ".join(f"s.{c} = i.{c}" for c in keys)
    return (
        f"{name}i AS (SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {', '.join(order)}) - 1 AS i FROM {table}), "
        f"{name}s AS (SELECT *, {_MIX(base(_BASE(seed, *keys)) + ' + b')} AS x FROM (SELECT {k}, count(*) AS n FROM {table} GROUP BY ALL), (SELECT unnest(range({REPLICATES})) AS b)), "
        f"{name}d AS (SELECT {', '.join('s.' + c for c in keys)}, b, j, i.v FROM (SELECT *, CAST(({_MIX('x + j')} * n::UBIGINT) >> 32 AS BIGINT) AS p FROM (SELECT *, unnest(range({draws})) AS j FROM {name}s)) s JOIN {name}i i ON {same} AND i.i = s.p), "
        f"{name}m AS (SELECT {k}, b, avg(v) AS m FROM {name}d GROUP BY ALL)"
    )


#: 95 % quantiles of t; tests hold them against the published table.
_TQ = "tq AS (SELECT * FROM (VALUES " + ", ".join(f"({df}, {t_quantile(df)!r})" for df in range(1, 400)) + ") AS t(df, c))"


def _sobol_sql(factors, most):
    """Effects from the definition: marginal means of every subset, combined per subset in SQL text."""
    from itertools import combinations

    q = {(): "(SELECT count(*) * avg(f2) ** 2 FROM g)"}
    for n in range(1, len(factors) + 1):
        for c in combinations(factors, n):
            q[c] = f"(SELECT sum(n * m * m) FROM (SELECT count(*) AS n, avg(f2) AS m FROM g GROUP BY {', '.join(c)}))"
    rows = []
    for n in range(1, most + 1):
        for c in combinations(factors, n):
            ss = " + ".join(f"({(-1) ** (n - k)}) * {q[t]}" for k in range(n + 1) for t in combinations(c, k))
            rows.append(f"SELECT '{':'.join(c)}' AS effect, {n} AS \"order\", {ss} AS ss")
    return "ef AS (" + " UNION ALL ".join(rows) + "), st AS (SELECT count(*) * var_pop(f2) AS sst FROM g)"


ORACLES = {
    "d6_paired": W(f"SELECT {_K}, seed, condition, value, base_value FROM pr", _PR),
    "j1_describe_cells": W(f"SELECT condition, mode, {r('avg(f2)')} AS mean, {r('stddev_samp(f2)')} AS std, count(f2) AS n FROM g GROUP BY 1, 2"),
    "j2_kruskal_wallis": f"WITH {_IT}, rk AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(rank) AS rr, max(nn) AS nn FROM {_RANK('it', 'l_returnflag', 'l_quantity')} GROUP BY 1, 2), s AS (SELECT l_returnflag, count(*) AS k, min(n) AS least, sum(rr * rr / n) AS q, max(nn) AS N FROM rk GROUP BY 1), h AS (SELECT l_returnflag, N, k, (12 / (N * (N + 1)) * q - 3 * (N + 1)) / (1 - ties / (N ** 3 - N)) AS h FROM s JOIN {_TIES('it', 'l_returnflag', 'l_quantity')} USING (l_returnflag) WHERE least >= 2 AND k >= 2) SELECT l_returnflag, N AS \"N\", k, {r('h', 5)} AS \"H\", {r('greatest(0, (h - k + 1) / (N - k))', 5)} AS eta2 FROM h",
    "j3_mann_whitney": f"WITH {_IT}, x AS (SELECT l_returnflag, sum(rank) FILTER (l_linestatus = 'O') AS ra, count(*) FILTER (l_linestatus = 'O') AS n, count(*) FILTER (l_linestatus = 'F') AS m FROM {_RANK('it', 'l_returnflag', 'l_quantity')} GROUP BY 1) SELECT l_returnflag, n, m, {r('ra - n * (n + 1) / 2')} AS \"U\" FROM x WHERE n > 0 AND m > 0",
    "j4_cliffs_delta": W(f"SELECT {_K}, {r(_DELTA)} AS delta, CASE WHEN abs({_DELTA}) < 0.147 THEN 'negligible' WHEN abs({_DELTA}) < 0.33 THEN 'small' WHEN abs({_DELTA}) < 0.474 THEN 'medium' ELSE 'large' END AS size FROM ({_MW('f2', chr(39) + '1-URGENT' + chr(39), chr(39) + '2-HIGH' + chr(39), _K)})"),
    "j5_wilcoxon": W(f"SELECT {_K}, n, {r('coalesce(least(wp, wm), 0)')} AS \"W\" FROM (SELECT {_K}, count(*) AS n FROM p2 GROUP BY ALL HAVING n >= 6) LEFT JOIN (SELECT {_K}, coalesce(sum(rank) FILTER (dd > 0), 0) AS wp, coalesce(sum(rank) FILTER (dd < 0), 0) AS wm FROM {_RANK('(SELECT *, round(value - base_value, 12) AS dd, abs(round(value - base_value, 12)) AS ad FROM p2 WHERE round(value - base_value, 12) <> 0)', _K, 'ad')} GROUP BY ALL) USING ({_K})", _PR),
    "j6_paired_t": W(f"SELECT {_K}, n, {r('t')} AS t, {r('d')} AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' WHEN abs(d) < 1.0 THEN 'large' ELSE 'very large' END AS size FROM (SELECT {_K}, count(*) AS n, avg(value - base_value) / nullif(stddev_samp(value - base_value) / sqrt(count(*)), 0) AS t, (avg(value) - avg(base_value)) / nullif(sqrt((var_samp(value) + var_samp(base_value)) / 2), 0) AS d FROM p2 GROUP BY ALL HAVING count(*) >= 2)", _PR),
    "j7_friedman": W(f"SELECT mode, n, k, {r('chi2')} AS chi2, {r('chi2 / (n * (k - 1))')} AS w FROM (SELECT mode, n, k, (12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi2 FROM (SELECT mode, sum(rr * rr) AS q, max(n) AS n, max(k) AS k FROM (SELECT mode, condition, sum(rank) AS rr, count(*) AS n, max(k) AS k FROM {_RANK('fb', 'mode, seed', 'f2')} GROUP BY ALL) GROUP BY 1) JOIN (SELECT mode, sum(ties) AS ties FROM {_TIES('fb', 'mode, seed', 'f2')} GROUP BY 1) USING (mode) WHERE n >= 3 AND k >= 2)", _BL),
    "j8_nemenyi": W(f"SELECT mode, condition, {r('avg(rank)')} AS mean_rank FROM {_RANK('(SELECT *, -f2 AS nf FROM fb)', 'mode, seed', 'nf')} GROUP BY ALL", _BL),
    "j9_dunn": W(f"SELECT mode, a, b, {r('z')} AS z FROM (SELECT x.mode, x.condition AS a, y.condition AS b, (x.m - y.m) / sqrt((x.N * (x.N + 1) / 12 - ties / (12 * (x.N - 1))) * (1 / x.n + 1 / y.n)) AS z FROM rg x JOIN rg y ON x.mode = y.mode AND x.condition < y.condition JOIN {_TIES('g', 'mode', 'f2')} t ON t.mode = x.mode)".replace("x.N", "x.nall"), f"rg AS (SELECT mode, condition, avg(rank) AS m, count(*) AS n, max(nn) AS nall FROM {_RANK('g', 'mode', 'f2')} GROUP BY 1, 2)"),
    "j10_scheirer_ray_hare": f"WITH {_IT}, rk AS (SELECT l_returnflag AS a, l_linestatus AS b, rank FROM {_RANK('it', '1', 'l_quantity')}), t AS (SELECT avg(rank) AS gm, var_samp(rank) AS ms FROM rk), " + ", ".join(f"{n} AS (SELECT sum(n * (m - gm) ** 2) AS ss, count(*) AS c FROM (SELECT count(*) AS n, avg(rank) AS m FROM rk GROUP BY {k}), t)" for n, k in (("sa", "a"), ("sb", "b"), ("sx", "a, b"))) + f" SELECT 'l_returnflag' AS effect, {r('sa.ss / ms', 4)} AS \"H\", sa.c - 1 AS df FROM sa, t UNION ALL SELECT 'l_linestatus', {r('sb.ss / ms', 4)}, sb.c - 1 FROM sb, t UNION ALL SELECT 'l_returnflag:l_linestatus', {r('(sx.ss - sa.ss - sb.ss) / ms', 4)}, (sa.c - 1) * (sb.c - 1) FROM sa, sb, sx, t",
    "j18_permutation_test": W(f"SELECT a.mode, a.level, {r('a.t')} AS \"T\", {r(f'(1 + count(*) FILTER (c.t >= a.t)) / {REPLICATES + 1}')} AS p FROM tt a JOIN tt c ON c.mode = a.mode AND c.level = a.level AND c.b > 0 WHERE a.b = 0 GROUP BY a.mode, a.level, a.t", f"rw AS (SELECT mode, level, condition, f2, row_number() OVER (PARTITION BY mode, level ORDER BY condition, distance, seed) - 1 AS i FROM g), st AS (SELECT mode, level, b, {_MIX(_BASE(3, 'mode', 'level') + ' + b')} AS x FROM (SELECT DISTINCT mode, level FROM g), (SELECT unnest(range({REPLICATES})) AS b)), sh AS (SELECT mode, level, condition, 0 AS b, f2 FROM rw UNION ALL SELECT o.mode, o.level, k.condition, o.b + 1, o.f2 FROM (SELECT mode, level, b, f2, row_number() OVER (PARTITION BY mode, level, b ORDER BY {_MIX('x + i')}, i) - 1 AS q FROM rw JOIN st USING (mode, level)) o JOIN rw k ON k.mode = o.mode AND k.level = o.level AND k.i = o.q), mn AS (SELECT mode, level, b, condition, avg(f2) AS m, count(*) AS n FROM sh GROUP BY ALL), tt AS (SELECT mode, level, b, round(sum(abs(m - gr)), 12) AS t FROM (SELECT *, sum(m * n) OVER w / sum(n) OVER w AS gr FROM mn WINDOW w AS (PARTITION BY mode, level, b)) GROUP BY ALL)"),
    "j21_ci_width_by_k": W(f"SELECT condition, j + 1 AS k, {r('quantile_cont(m, 0.975) - quantile_cont(m, 0.025)')} AS width FROM (SELECT condition, b, j, avg(v) OVER (PARTITION BY condition, b ORDER BY j) AS m FROM bd) GROUP BY 1, 2", _BOOT("g", ["condition"], ["mode", "distance", "level", "seed"], "f2", 3, "10")),
    "j36_tradeoff_pattern": W(f"SELECT mode, level, condition, {r('dr')} AS d_recall, {r('dp')} AS d_precision, dr > 0.147 AND dp < -0.147 AS tradeoff FROM (SELECT mode, level, x.condition, avg(sign(x.recall - z.recall)) AS dr, avg(sign(x.f2 - z.f2)) AS dp FROM g x JOIN g z USING (mode, level) WHERE z.condition = '1-URGENT' AND x.condition <> '1-URGENT' GROUP BY ALL)"),
    "j37_rank_reversal": W(f"SELECT a, b, {r('corr(ka, kb)')} AS rho, count(*) AS n FROM (SELECT a, b, rank() OVER wa + (count(*) OVER (PARTITION BY a, b, ra) - 1) / 2 AS ka, rank() OVER wb + (count(*) OVER (PARTITION BY a, b, rb) - 1) / 2 AS kb FROM pp WINDOW wa AS (PARTITION BY a, b ORDER BY ra), wb AS (PARTITION BY a, b ORDER BY rb)) GROUP BY 1, 2", f"mr AS (SELECT mode, condition, round(avg(rank), 9) AS k FROM {_RANK('g', 'mode, seed, distance, level', 'f2')} GROUP BY 1, 2), pp AS (SELECT x.mode AS a, y.mode AS b, x.k AS ra, y.k AS rb FROM mr x JOIN mr y ON x.condition = y.condition AND x.mode < y.mode)"),
    "j11_brown_forsythe": W(f"SELECT mode, {r('((q - n * gm * gm) / (k - 1)) / (w / (n - k))')} AS \"F_stat\" FROM (SELECT mode, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * m * m) AS q, sum(n * s) AS w FROM (SELECT mode, condition, count(*) AS n, avg(z) AS m, var_pop(z) AS s FROM (SELECT mode, condition, abs(f2 - median(f2) OVER (PARTITION BY mode, condition)) AS z FROM g) GROUP BY 1, 2) GROUP BY 1 HAVING k >= 2 AND sum(n) > k)"),
    "j12_hodges_lehmann": W(f"SELECT {_K}, {r('median(x.f2 - y.f2)')} AS shift FROM g x JOIN g y USING ({_K}) WHERE x.condition = '1-URGENT' AND y.condition = '2-HIGH' GROUP BY ALL"),
    "j14_adjust_p": f"WITH p AS (SELECT s_suppkey, s_nationkey, (s_suppkey * 7919 % 1009) / 10090 AS p FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p) AS k, count(*) OVER (PARTITION BY s_nationkey) AS m FROM p) SELECT s_suppkey, s_nationkey, {r('p')} AS p, {r('least(1, p * m)')} AS bonferroni, {r('least(1, min(p * m / k) OVER (PARTITION BY s_nationkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS bh, {r('least(1, max(p * (m - k + 1)) OVER (PARTITION BY s_nationkey ORDER BY k))')} AS holm FROM k",
    "j17_cliff_delta_ci": W(f"SELECT mode, {r('quantile_cont(delta, 0.025)')} AS lo, {r('quantile_cont(delta, 0.975)')} AS hi FROM (SELECT mode, b, {_DELTA} AS delta FROM (SELECT mode, b, sum(rank) FILTER (g = 1) AS ra, count(*) FILTER (g = 1) AS n, count(*) FILTER (g = 2) AS m FROM {_RANK('dr', 'mode, b', 'v')} GROUP BY ALL)) GROUP BY 1", _BOOT("(SELECT * FROM g WHERE condition = '1-URGENT')", ["mode"], ["f2"], "f2", 3, name="xa") + ", " + _BOOT("(SELECT * FROM g WHERE condition = '2-HIGH')", ["mode"], ["f2"], "f2", 3, name="xb", base=lambda x: _MIX(x + " + 1")) + ", dr AS (SELECT mode, b, v, 1 AS g FROM xad UNION ALL SELECT mode, b, v, 2 FROM xbd)"),
    "j32_intervals": W("SELECT mode, distance, condition, " + ", ".join(f"{r(f'quantile_cont({c}.m, {q})')} AS {n}" for c, q, n in (("xam", 0.025, "lo"), ("xam", 0.975, "hi"), ("xbm", 0.025, "base_lo"), ("xbm", 0.975, "base_hi"))) + " FROM xam JOIN xbm USING (mode, distance, condition, b) GROUP BY ALL", "pz AS (SELECT x.mode, x.distance, x.seed, x.condition, x.f2 AS value, z.f2 AS base_value FROM g x JOIN g z ON x.mode = z.mode AND x.distance = z.distance AND x.seed = z.seed WHERE z.condition = '1-URGENT' AND x.condition <> '1-URGENT'), " + _BOOT("pz", ["mode", "distance", "condition"], ["seed", "value", "base_value"], "value", 1, name="xa") + ", " + _BOOT("pz", ["mode", "distance", "condition"], ["seed", "value", "base_value"], "base_value", 1, name="xb")),
    "j15_bootstrap_ci": W(f"SELECT condition, mode, {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi FROM bm GROUP BY 1, 2", _BOOT("g", ["condition", "mode"], ["distance", "level", "seed"], "f2", 3)),
    "j20_sigma_rank": W(f"SELECT mode, {r('avg(s)')} AS mean_sigma, {r('max(s)')} AS max_sigma FROM (SELECT mode, condition, stddev_pop(k) AS s FROM (SELECT mode, a, b, condition, row_number() OVER (PARTITION BY mode, a, b ORDER BY m DESC, condition) AS k FROM (SELECT mode, a, b, condition, avg(f2) AS m FROM g JOIN (SELECT x AS a, y AS b FROM (SELECT unnest(range(1, 13)) AS x), (SELECT unnest(range(1, 13)) AS y) WHERE x < y) ON seed IN (a, b) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2) GROUP BY 1"),
    "j23_domain_gap": W(f"SELECT condition, mode, {r('avg(gap)')} AS gap, {r('stddev_samp(gap)')} AS std, count(*) AS n FROM (SELECT condition, mode, seed, avg(f2) FILTER (level = 'O') - avg(f2) FILTER (level = 'F') AS gap FROM g GROUP BY ALL) WHERE gap IS NOT NULL GROUP BY 1, 2"),
    "j22_running_adequacy": W(f"SELECT condition, seed, n, {r('mean')} AS mean, {r('std')} AS std, n >= 3 AND round(max(mean) OVER w - min(mean) OVER w, 9) <= 0.01 AS flat FROM (SELECT condition, seed, row_number() OVER v AS n, avg(f2) OVER v AS mean, stddev_samp(f2) OVER v AS std FROM (SELECT condition, seed, avg(f2) AS f2 FROM g GROUP BY ALL) WINDOW v AS (PARTITION BY condition ORDER BY seed)) WINDOW w AS (PARTITION BY condition ORDER BY seed ROWS 2 PRECEDING)"),
    "j24_best_condition": W(f"SELECT mode, distance, best FROM {_BEST('true')}"),
    "j25_mean_rank": W(f"SELECT condition, {r('avg(rank)')} AS mean_rank, count(*) AS cells FROM {_RANK(f'(SELECT {_K}, condition, -round(avg(f2), 9) AS nm FROM g GROUP BY ALL)', _K, 'nm')} GROUP BY 1"),
    "j26_spearman": f"WITH {_IT}, a AS (SELECT l_returnflag, rank AS ra, l_discount FROM {_RANK('it', 'l_returnflag', 'l_quantity')}), b AS (SELECT l_returnflag, ra, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS rb FROM a) SELECT l_returnflag, {r('corr(ra, rb)')} AS rho, count(*) AS n FROM b GROUP BY 1",
    "j26_kendall_tau": f"WITH s AS (SELECT s_suppkey, s_nationkey % 5 AS g, round(s_acctbal, -2) AS a, s_suppkey % 7 AS b FROM supplier) SELECT x.g, {r('sum(sign(x.a - y.a) * sign(x.b - y.b)) / nullif(sqrt(sum(sign(x.a - y.a) ** 2) * sum(sign(x.b - y.b) ** 2)), 0)')} AS tau FROM s x JOIN s y ON x.g = y.g AND x.s_suppkey < y.s_suppkey GROUP BY 1",
    "j26_kendall_w": W(f"SELECT {r('12 * var_pop(rr) * count(*) / (max(m) ** 2 * (count(*) ** 3 - count(*)))')} AS w, max(m) AS m, count(*) AS n FROM (SELECT condition, sum(rank) AS rr, count(*) AS m FROM {_RANK('(SELECT * FROM (SELECT seed, condition, avg(f2) AS f2 FROM g GROUP BY 1, 2) QUALIFY count(*) OVER (PARTITION BY seed) = (SELECT count(DISTINCT condition) FROM g))', 'seed', 'f2')} GROUP BY 1)"),
    "j26_pearson": f"SELECT l_suppkey, {r('corr(l_quantity, l_tax)')} AS r FROM lineitem GROUP BY 1",
    "j27_linear_fit": f"SELECT l_returnflag, {r('regr_slope(l_quantity, l_discount)')} AS slope, {r('regr_intercept(l_quantity, l_discount)')} AS intercept, {r('corr(l_quantity, l_discount)')} AS r FROM lineitem GROUP BY 1",
    "j28_anova_sobol": W(f"SELECT effect, \"order\", {r('ss')} AS ss, {r('ss / sst')} AS s FROM ef, st", _sobol_sql(FACTORS, 4)),
    "j28_sobol_total": W(f"SELECT factor, {r('max(ss / sst) FILTER (' + chr(34) + 'order' + chr(34) + ' = 1)')} AS s1, {r('sum(ss / sst)')} AS st FROM ef, st, (SELECT unnest(['condition', 'mode', 'distance', 'level']) AS factor) WHERE list_contains(string_split(effect, ':'), factor) GROUP BY 1", _sobol_sql(FACTORS, 4)),
    "j29_bootstrap_sobol": W(f"SELECT effect, {r('quantile_cont(s, 0.025)')} AS lo, {r('quantile_cont(s, 0.975)')} AS hi FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS effect, t.b, (q.q - t.q0) / nullif(t.sst, 0) AS s FROM tot t JOIN (SELECT b, sum(a * a / w) AS q FROM (SELECT b, {f}, sum(k * m) AS a, sum(k) AS w FROM rw GROUP BY ALL) GROUP BY 1) q USING (b)" for f in ("condition", "mode")) + ") GROUP BY 1", f"bk AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT seed FROM g)), wt AS (SELECT b, p, count(*) AS k FROM (SELECT b, CAST(floor(CAST(('0x' || substr(md5('3:' || b || ':' || i), 1, 8)) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS p FROM bk, (SELECT unnest(range({REPLICATES})) AS b)) GROUP BY ALL), rw AS (SELECT wt.b, c.condition, c.mode, wt.k, c.m FROM wt JOIN bk ON bk.i = wt.p JOIN (SELECT condition, mode, seed, avg(f2) AS m FROM g GROUP BY ALL) c ON c.seed = bk.seed), tot AS (SELECT b, sum(k * m) ** 2 / sum(k) AS q0, sum(k * m * m) - sum(k * m) ** 2 / sum(k) AS sst FROM rw GROUP BY 1)"),
    "j30_largest_rectangle": W("SELECT array_to_string(cs, ',') AS columns, rows, rows * len(cs) AS area FROM (SELECT cs, count(*) AS rows FROM sets JOIN ok ON list_has_all(ok.has, cs) GROUP BY cs) ORDER BY area DESC, columns LIMIT 1", "cv AS (SELECT condition, mode, min(coalesce(b, 0)) AS least FROM (SELECT * FROM (SELECT DISTINCT condition, mode FROM g WHERE distance <> 'P'), (SELECT DISTINCT level FROM g WHERE distance <> 'P')) LEFT JOIN (SELECT condition, mode, level, count(DISTINCT seed) AS b FROM g WHERE distance <> 'P' GROUP BY ALL) USING (condition, mode, level) GROUP BY 1, 2), nm AS (SELECT list(DISTINCT mode ORDER BY mode) AS ns FROM cv), ok AS (SELECT condition, list(mode) AS has FROM cv WHERE least >= 1 GROUP BY 1), sets AS (SELECT list_filter(ns, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS cs FROM (SELECT ns, unnest(range(1, 1 << len(ns))) AS mask FROM nm))"),
    "j19_t_ci": W(f"SELECT condition, mode, {r('c * s / sqrt(n)')} AS half FROM (SELECT condition, mode, stddev_samp(f2) AS s, count(f2) AS n FROM g GROUP BY ALL HAVING count(f2) >= 2) JOIN tq ON n - 1 = df", _TQ),
    "j19_required_n": W("SELECT condition, mode, min(df + 1) AS required_n FROM (SELECT condition, mode, stddev_samp(f2) AS s FROM g GROUP BY ALL) JOIN tq ON c * s / sqrt(df + 1) <= 0.005 AND df < 300 WHERE s IS NOT NULL GROUP BY 1, 2", _TQ),
    "j22_adequacy": W(f"SELECT condition, n, {r('mean')} AS mean, {r('half')} AS half, flat, {r('upper')} AS upper, CASE WHEN n > 1 THEN CASE WHEN mean > 0.05 THEN half <= 0.05 AND flat ELSE upper < 0.06 END END AS adequate FROM (SELECT condition, n, mean, c * std / sqrt(n) AS half, flat FROM (SELECT *, n >= 3 AND round(max(mean) OVER w - min(mean) OVER w, 9) <= 0.01 AS flat FROM (SELECT condition, seed, row_number() OVER v AS n, avg(f2) OVER v AS mean, stddev_samp(f2) OVER v AS std FROM sm WINDOW v AS (PARTITION BY condition ORDER BY seed)) WINDOW w AS (PARTITION BY condition ORDER BY seed ROWS 2 PRECEDING)) x LEFT JOIN tq ON tq.df = n - 1 QUALIFY row_number() OVER (PARTITION BY condition ORDER BY n DESC) = 1) JOIN (SELECT condition, quantile_cont(m, 0.975) AS upper FROM xam GROUP BY 1) USING (condition)", "sm AS (SELECT condition, seed, avg(f2) AS f2 FROM g GROUP BY ALL), " + _TQ + ", " + _BOOT("sm", ["condition"], ["seed"], "f2", 1, name="xa")),
    "j30_coverage": W("SELECT condition, mode, min(coalesce(b, 0)) AS least, max(coalesce(b, 0)) AS most FROM (SELECT * FROM (SELECT DISTINCT condition, mode FROM g), (SELECT DISTINCT distance, level FROM g)) LEFT JOIN (SELECT condition, mode, distance, level, count(DISTINCT seed) AS b FROM g GROUP BY ALL) USING (condition, mode, distance, level) GROUP BY 1, 2"),
    "j31_min_detectable": W(f"SELECT condition, {r('1.959964 / sqrt(count(f2))')} AS mdd FROM g GROUP BY 1"),
    "j32_compare_to_baseline": W(f"SELECT mode, distance, condition, {r('avg(value - base_value) / nullif(stddev_samp(value - base_value) / sqrt(count(*)), 0)')} AS t, {r('(avg(value) - avg(base_value)) / nullif(sqrt((var_samp(value) + var_samp(base_value)) / 2), 0)')} AS d, {r('avg(value)')} AS mean, {r('avg(base_value)')} AS base_mean, count(*) AS n FROM (SELECT x.mode, x.distance, x.seed, x.condition, x.f2 AS value, z.f2 AS base_value FROM g x JOIN g z ON x.mode = z.mode AND x.distance = z.distance AND x.seed = z.seed WHERE z.condition = '1-URGENT' AND x.condition <> '1-URGENT') GROUP BY ALL HAVING count(*) >= 6"),
    "j33_ci_overlap": W(f"SELECT condition, {r('lo')} AS lo, {r('hi')} AS hi, lo > (SELECT hi FROM q WHERE condition = '1-URGENT') OR hi < (SELECT lo FROM q WHERE condition = '1-URGENT') AS separable FROM q", "q AS (SELECT condition, avg(f2) - 1.959964 * stddev_samp(f2) / sqrt(count(*)) AS lo, avg(f2) + 1.959964 * stddev_samp(f2) / sqrt(count(*)) AS hi FROM g GROUP BY 1)"),
    "j34_multiseed_confusion": f"WITH {SCORED}, c AS (SELECT l_suppkey, grp, count(*) FILTER (y = 0 AND score < 0.3) AS tn, count(*) FILTER (y = 0 AND score >= 0.3) AS fp, count(*) FILTER (y = 1 AND score < 0.3) AS fn, count(*) FILTER (y = 1 AND score >= 0.3) AS tp FROM s GROUP BY 1, 2) SELECT grp, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}, {r(f'avg({c})')} AS mean_{c}, {r(f'stddev_samp({c})')} AS std_{c}" for c in ("tn", "fp", "fn", "tp")) + " FROM c GROUP BY 1",
    "j35_ratio_sensitivity": W(f"SELECT mode, distance, a.best = b.best AS same, {r('b.m - a.m')} AS change FROM {_BEST('seed <= 6')} a JOIN {_BEST('seed > 6')} b USING (mode, distance)"),
    "j39_ofat_lines": W(f"SELECT condition, {r('avg(m)')} AS mean, {r('stddev_samp(m)')} AS std, count(*) AS lines FROM (SELECT {_K}, condition, avg(f2) AS m FROM g GROUP BY ALL) GROUP BY 1"),
    "j40_block_means": f"SELECT l_returnflag, l_linestatus, CAST(month(l_shipdate) AS INTEGER) AS seed, {r('avg(l_discount)')} AS l_discount FROM lineitem GROUP BY 1, 2, 3",
    "j38_sobol_pairwise": W(f"SELECT effect, \"order\", {r('s')} AS s FROM cl UNION ALL SELECT 'residual', 0, {r('greatest(0, 1 - (SELECT sum(s) FROM cl))')}", _sobol_sql(["condition", "mode", "level"], 2) + ", cl AS (SELECT effect, \"order\", CASE WHEN \"order\" = 2 THEN greatest(0, ss / sst) ELSE ss / sst END AS s FROM ef, st)"),
}
