"""Queries over recordings: primitives, windows, joins and labels (2.0, 2.C, 2.D, 2.E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakelane.functions.columns import hash_order, hash_uniform, shown
from wakelane.operators import joins, labels, primitives, windows
from wakelane.plans.base import BY, FRAMES, KEYS, MATRIX, RATE, SIG, SIZE, STEP, fill, frames, matrix, r, read, signals

W = lambda body, with_=FRAMES: f"WITH {with_} {body}"


def p1_tie_rank(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return primitives.tie_rank(li, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "rank")


def p2_hash_uniform(spark, d):
    return read(spark, d, "orders").select("o_orderkey", hash_uniform(7, "o_orderkey").alias("u"), hash_order(7, "o_orderkey").alias("h"))


def p3_sliding_frames(spark, d):
    return frames(spark, d).select("user_id", "win", "idx", "event_id")


def p4_knn_join(spark, d):
    m = matrix(spark, d)
    return fill(primitives.knn_join(m, m, 3, vec_col="vec", keys=["label"]).select("label", "query_id", "id", "rank", "dist"), 4)


def p5_pair_table(spark, d):
    return primitives.pair_table(read(spark, d, "nation"), "n_nationkey")


def p6_prefix_sum(spark, d):
    by_score = read(spark, d, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return primitives.prefix_sum(by_score, ["l_quantity"], ["n"]).select("l_quantity", "n", "cum_n")


def c1_gradient(spark, d):
    return windows.gradient(signals(spark, d), KEYS, "x", RATE).select("user_id", "idx", shown("gradient").alias("gradient"))


def c2_nan_to_zero(spark, d):
    s = signals(spark, d).select("user_id", "idx", F.when(F.col("idx") % 5 == 0, None).when(F.col("idx") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"))
    return windows.nan_to_zero(s, ["x"])


def c3_gaussian_smooth(spark, d):
    return windows.gaussian_smooth(signals(spark, d), KEYS, "x", 2.0).select("user_id", "idx", shown("smooth").alias("smooth"))


def c4_moments(spark, d):
    return fill(frames(spark, d).groupBy(*BY).agg(*windows.moments("x")), 4)


def _feature(*names):
    def run(spark, d):
        return fill(windows.window_features(frames(spark, d), BY).select(*BY, *names))

    return run


def c9_shannon_entropy(spark, d):
    return fill(windows.shannon_entropy(frames(spark, d), BY))


def c10_sample_entropy(spark, d):
    return fill(windows.sample_entropy(frames(spark, d), BY))


def c11_spectral(spark, d):
    return fill(windows.spectral(frames(spark, d), BY, RATE), 3)


def c12_time_freq_features(spark, d):
    return fill(windows.time_freq_features(signals(spark, d), KEYS, 16, 8, RATE), 3)


def c13_smooth_std_pe(spark, d):
    return fill(windows.smooth_std_pe(frames(spark, d), BY))


def c14_multiwavelet_energy(spark, d):
    return fill(windows.multiwavelet_energy(frames(spark, d), BY))


def c15_wavelet_features(spark, d):
    s = windows.gradient(signals(spark, d), KEYS, "x", RATE)
    both = s.select("user_id", "idx", "x", F.lit("steering").alias("signal")).unionByName(s.select("user_id", "idx", F.col("gradient").alias("x"), F.lit("steering_speed").alias("signal")))
    return fill(windows.multiwavelet_energy(primitives.sliding_frames(both, ["user_id", "signal"], 16, 8), ["user_id", "signal", "win"]))


def c16_eeg_band_power(spark, d):
    bands = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 50)}
    return fill(windows.eeg_band_power(primitives.sliding_frames(signals(spark, d), KEYS, 40, 20), BY, 128.0, bands))


def c17_perclos(spark, d):
    return fill(windows.perclos(signals(spark, d).where("event_type = 'click'"), KEYS, "t", "x", 86400.0 * 3))


def c18_tumbling_mean(spark, d):
    return fill(windows.tumbling_mean(signals(spark, d), KEYS, "t", ["x"], 86400.0 * 3).drop("t"))


def c19_perclos_physio(spark, d):
    return c17_perclos(spark, d).join(c18_tumbling_mean(spark, d), ["user_id", "bucket"])


def c20_pupil_average(spark, d):
    return fill(windows.block_average(signals(spark, d), KEYS, "t", ["x"], 86400.0 * 2).drop("t"))


def c21_segment(spark, d):
    return windows.segment(signals(spark, d), KEYS, 20, "event_type")


def _timeline(k):
    return lambda spark, d: fill(windows.session_timeline(signals(spark, d), KEYS, "t", F.col("event_type") == "error")[k], 4)


def d1_asof_nearest(spark, d):
    s = signals(spark, d)
    a, b = s.where("event_type = 'purchase'").select("user_id", "t", "event_id"), s.where("event_type = 'click'").select("user_id", "t", "x", F.col("event_id").alias("other"))
    return joins.asof_nearest(a, b, "t", KEYS, ["x", "other"]).select("event_id", "user_id", "x", "other")


def d2_interval_join(spark, d):
    s = signals(spark, d)
    ranges = s.where("event_type = 'error'").select("user_id", F.col("t").alias("start"), (F.col("t") + 86400).alias("end"), (F.col("event_id") % 2).alias("label"), F.col("event_id").alias("no"))
    return joins.interval_join(s.select("user_id", "event_id", "t"), ranges, "t", KEYS, "start", "end", "label", "no").select("user_id", "event_id", "label")


def d3_inner(spark, d):
    return c19_perclos_physio(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))


def d4_left_normalised(spark, d):
    n, c = read(spark, d, "nation"), read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    c = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit(" "), F.upper("n_name")).alias("name"), "n").where("n > 2")
    return n.join(c, F.lower(F.trim("n_name")) == F.lower(F.trim("name")), "left").select("n_name", "n")


def d5_semi_anti(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").where("o_totalprice > 300000")
    inside = c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", F.lit("in").alias("side"))
    return inside.unionByName(c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", F.lit("out").alias("side")))


def d7_pairs(spark, d):
    # Subjects are nations: every supplier counts, and pairs stay few.
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"))
    p = primitives.pair_table(s, "s_nationkey")
    a, b = s.select(F.col("s_nationkey").alias("a"), F.col("m").alias("x")), s.select(F.col("s_nationkey").alias("b"), F.col("m").alias("y"))
    return p.join(a, "a").join(b, "b").select("a", "b", shown(F.abs(F.col("x") - F.col("y"))).alias("d"))


def d8_knn_join(spark, d):
    m = matrix(spark, d)
    return primitives.knn_join(m.where("y = 1"), m, 5).select("query_id", "id", "rank")


def d9_missing_cells(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    return joins.missing_cells(o, ["o_orderstatus", "o_orderpriority", "day"])


def e1_band_ratio(spark, d):
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", shown(labels.band_ratio(["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"], ["l_tax", "l_quantity"]), 4).alias("ratio"))


def e2_bin_linear(spark, d):
    return labels.bin_linear(signals(spark, d), KEYS, "x").select("event_id", "label")


def e3_bin_percentile(spark, d):
    return labels.bin_percentile(signals(spark, d), KEYS, "x").select("event_id", "label")


def _task_events(spark, d):
    s = signals(spark, d).where("event_type = 'error'")
    return s.select("user_id", F.col("t").alias("t_start"), (F.col("t") + 20000).alias("t_end"))


def e4_event_ranges(spark, d):
    s = signals(spark, d)
    span = s.groupBy("user_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    return fill(labels.event_ranges(_task_events(spark, d), KEYS, span, 40000.0, 20000.0), 3)


def e5_label_by_events(spark, d):
    s = signals(spark, d).select("user_id", "event_id", "t")
    span = s.groupBy("user_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    ranges = labels.event_ranges(_task_events(spark, d), KEYS, span, 40000.0, 20000.0)
    return joins.interval_join(s, ranges, "t", KEYS, "start", "end", "label", "range_no").select("event_id", "label")


def e6_pad_or_truncate(spark, d):
    s = signals(spark, d)
    return labels.pad_or_truncate(s.select("user_id", "idx", "event_id"), s.where("idx < 30").select("user_id", (F.col("idx") + 1).alias("idx"), F.col("event_type").alias("label")), KEYS, "idx", "label")


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "pcde" and k[1:2].isdigit() and callable(f)}
QUERIES |= {
    "c5_zero_crossing": _feature("zero_crossing_rate"),
    "c6_quartiles": _feature("quartile25", "median", "quartile75"),
    "c7_skew_kurt": _feature("skewness", "kurtosis"),
    "c8_katz": _feature("katz_fd"),
    "c22_session_summary": _timeline(0),
    "c22_session_bins": _timeline(1),
}

_LABELLED = """sp AS (SELECT user_id, min(t) AS t_min, max(t) AS t_max FROM sig GROUP BY 1),
ev AS (SELECT user_id, t AS s, t + 20000 AS e, row_number() OVER w AS no, lag(t + 20000) OVER w AS p, lead(t) OVER w AS n FROM sig WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY t, t + 20000)),
e2 AS (SELECT user_id, no, s, e,
  CASE WHEN p IS NULL THEN greatest(s - 40000, t_min) ELSE greatest(greatest(s - 40000, t_min), least(p + 20000, (p + 20000 + s - 40000) / 2)) END AS pre,
  CASE WHEN n IS NULL THEN least(e + 20000, t_max) ELSE least(least(e + 20000, t_max), greatest(n - 40000, (least(e + 20000, t_max) + n - 40000) / 2)) END AS post
  FROM ev JOIN sp USING (user_id)),
rg AS (SELECT user_id, no * 3 AS range_no, pre AS start, s AS "end", 0 AS label FROM e2 WHERE pre < s
  UNION ALL SELECT user_id, no * 3 + 1, s, e, 1 FROM e2 UNION ALL SELECT user_id, no * 3 + 2, e, post, 0 FROM e2 WHERE e < post)"""
_MOM = "avg(x) AS mean, var_pop(x) AS variance, stddev_pop(x) AS std_dev, max(x) AS max, min(x) AS min, max(x) - min(x) AS range, sum(x * x) AS energy"
_TRIM = "st AS (SELECT user_id, avg(x) AS m, stddev_pop(x) AS s FROM sig GROUP BY 1), tr AS (SELECT sig.* FROM sig JOIN st USING (user_id) WHERE abs(x - m) <= 3 * s)"
_STEPS = "z AS (SELECT *, lag(x) OVER w AS prev, first_value(x) OVER w AS x0, first_value(idx) OVER w AS i0 FROM fr WINDOW w AS (PARTITION BY user_id, win ORDER BY idx))"
_PER = "pc AS (WITH c AS (SELECT * FROM sig WHERE event_type = 'click'), s AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM c GROUP BY 1), gr AS (SELECT user_id, unnest(range(CAST(floor((t1 - t0) / 259200.0) AS BIGINT))) AS bucket FROM s), cl AS (SELECT user_id, CAST(floor((t - t0) / 259200.0) AS BIGINT) AS bucket, sum(x) AS dd FROM c JOIN s USING (user_id) GROUP BY ALL) SELECT user_id, bucket, coalesce(dd, 0) / 259200.0 AS perclos FROM gr LEFT JOIN cl USING (user_id, bucket))"
_TUM = "tm AS (WITH s AS (SELECT user_id, min(t) AS t0 FROM sig GROUP BY 1) SELECT user_id, CAST(floor((t - t0) / 259200.0) AS BIGINT) AS bucket, avg(x) AS x FROM sig JOIN s USING (user_id) GROUP BY ALL)"

ORACLES = {
    "p1_tie_rank": "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rank FROM lineitem",
    "p2_hash_uniform": "SELECT o_orderkey, CAST(('0x' || substr(md5('7:' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0 AS u, md5('7:' || o_orderkey) AS h FROM orders",
    "p3_sliding_frames": W("SELECT user_id, win, idx, event_id FROM fr"),
    "p4_knn_join": f"WITH {MATRIX}, q AS (SELECT a.label, a.id AS query_id, b.id, sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a.vec[i] - b.vec[i]) ** 2))) AS dist FROM m a JOIN m b ON a.label = b.label AND a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY dist, id) AS rank FROM q) SELECT label, query_id, id, CAST(rank AS INTEGER) AS rank, {r('dist', 4)} AS dist FROM k WHERE rank <= 3",
    "p5_pair_table": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "p6_prefix_sum": "SELECT l_quantity, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY l_quantity) AS BIGINT) AS cum_n FROM lineitem GROUP BY l_quantity",
    "c1_gradient": f"WITH {SIG}, z AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY idx)) SELECT user_id, idx, {r('60.0 * CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END')} AS gradient FROM z",
    "c2_nan_to_zero": f"WITH {SIG} SELECT user_id, idx, CASE WHEN idx % 5 = 0 OR idx % 7 = 0 THEN 0.0 ELSE x END AS x FROM sig",
    "c3_gaussian_smooth": f"WITH {SIG}, n AS (SELECT user_id, count(*) AS n FROM sig GROUP BY 1), k AS (SELECT k, exp(-0.5 * (k / 2.0) ** 2) AS w FROM (SELECT unnest(generate_series(-8, 8)) AS k)), kw AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k), pl AS (SELECT user_id, idx, w, n, ((idx + k) % (2 * n) + 2 * n) % (2 * n) AS p FROM sig JOIN n USING (user_id), kw), q AS (SELECT user_id, idx, w, CASE WHEN p < n THEN p ELSE 2 * n - 1 - p END AS i FROM pl) SELECT q.user_id, q.idx, {r('sum(w * sig.x)')} AS smooth FROM q JOIN sig ON sig.user_id = q.user_id AND sig.idx = q.i GROUP BY ALL",
    "c4_moments": W(f"SELECT user_id, win, {', '.join(f'{r(x.split(chr(32) + chr(65) + chr(83) + chr(32))[0], 4)} AS {x.split(chr(32) + chr(65) + chr(83) + chr(32))[1]}' for x in _MOM.split(', '))} FROM fr GROUP BY 1, 2"),
    "c5_zero_crossing": W(f"SELECT user_id, win, {r('avg(CASE WHEN prev IS NOT NULL THEN CAST(sign(x) <> sign(prev) AS INTEGER) END)')} AS zero_crossing_rate FROM z GROUP BY 1, 2", FRAMES + ", " + _STEPS),
    "c6_quartiles": W(f"SELECT user_id, win, {r('quantile_cont(x, 0.25)')} AS quartile25, {r('quantile_cont(x, 0.5)')} AS median, {r('quantile_cont(x, 0.75)')} AS quartile75 FROM fr GROUP BY 1, 2"),
    "c7_skew_kurt": W(f"SELECT user_id, win, {r('CASE WHEN max(x) = min(x) THEN 0 ELSE avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 END')} AS skewness, {r('CASE WHEN max(x) = min(x) THEN 0 ELSE avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3 END')} AS kurtosis FROM q GROUP BY 1, 2", FRAMES + ", q AS (SELECT *, avg(x) OVER (PARTITION BY user_id, win) AS m FROM fr)"),
    "c8_katz": W(f"SELECT user_id, win, {r('CASE WHEN count(*) < 2 OR sum(abs(x - prev)) = 0 OR max(sqrt((idx - i0) ** 2 + (x - x0) ** 2)) IN (0, 1) THEN 0 ELSE log10(sum(abs(x - prev))) / log10(max(sqrt((idx - i0) ** 2 + (x - x0) ** 2))) END')} AS katz_fd FROM z GROUP BY 1, 2", FRAMES + ", " + _STEPS),
    "c9_shannon_entropy": W(f"SELECT user_id, win, {r('greatest(0, -sum(c / n * log2(c / n)))')} AS shannon_entropy FROM c GROUP BY 1, 2", FRAMES + ", e AS (SELECT user_id, win, min(x) AS lo, max(x) AS hi, count(*) AS n FROM fr GROUP BY 1, 2), c AS (SELECT user_id, win, n, CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS b, count(*) AS c FROM fr JOIN e USING (user_id, win) GROUP BY ALL)"),
    "c10_sample_entropy": W(
        f"SELECT user_id, win, {r('CASE WHEN r = 0 OR n <= 3 THEN 0.0 WHEN coalesce(a, 0) = 0 OR coalesce(b, 0) = 0 THEN 10.0 ELSE -ln(a / b) END')} AS sample_entropy FROM s LEFT JOIN k USING (user_id, win)",
        FRAMES + ", s AS (SELECT user_id, win, 0.2 * stddev_pop(x) AS r, count(*) AS n FROM fr GROUP BY 1, 2), o AS (SELECT user_id, win, idx - win * 8 AS i, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM fr WINDOW w AS (PARTITION BY user_id, win ORDER BY idx)), k AS (SELECT p.user_id, p.win, count(*) FILTER (abs(p.x - q.x) <= r AND abs(p.x1 - q.x1) <= r) AS b, count(*) FILTER (abs(p.x - q.x) <= r AND abs(p.x1 - q.x1) <= r AND abs(p.x2 - q.x2) <= r) AS a FROM o p JOIN o q ON p.user_id = q.user_id AND p.win = q.win AND p.i < q.i JOIN s ON s.user_id = p.user_id AND s.win = p.win GROUP BY 1, 2)",
    ),
    "c11_spectral": f"""WITH {FRAMES},
pk AS (SELECT user_id, win, k, sum(x * cos(2 * pi() * k * (idx - win * {STEP}) / {SIZE})) ** 2 + sum(x * sin(2 * pi() * k * (idx - win * {STEP}) / {SIZE})) ** 2 AS p FROM fr, (SELECT unnest(range({SIZE})) AS k) GROUP BY ALL),
fk AS (SELECT *, (CASE WHEN 2 * k < {SIZE} THEN k ELSE k - {SIZE} END) * {RATE} / {SIZE} AS f, lead(p) OVER (PARTITION BY user_id, win ORDER BY k) - p AS step FROM pk),
tk AS (SELECT *, f >= 0.5 AND f <= 30 AS b, sum(p) FILTER (f >= 0.5 AND f <= 30) OVER (PARTITION BY user_id, win) + 2.220446049250313e-16 AS t FROM fk)
SELECT user_id, win, {r('var_pop(f) FILTER (b)', 3)} AS freq_var, {r('-sum(p / t * log2(p / t + 2.220446049250313e-16)) FILTER (b)', 3)} AS spectral_entropy, {r('sqrt(sum(step ** 2))', 3)} AS spectral_flux,
  {r('sum(f * p) FILTER (b) / max(t)', 3)} AS freq_cog, {r('max_by(f, p)', 3)} AS dominant_freq, {r('avg(p) FILTER (b)', 3)} AS avg_psd FROM tk GROUP BY 1, 2""",
    "c13_smooth_std_pe": W(f"SELECT user_id, win, {r('stddev_pop(x)')} AS std_dev, {r('avg(x)')} AS mean, {r('abs(2.5 * max(x) FILTER (idx = win * 8 + 14) - 2 * max(x) FILTER (idx = win * 8 + 13) + 0.5 * max(x) FILTER (idx = win * 8 + 12) - max(x) FILTER (idx = win * 8 + 15))')} AS pred_error FROM fr GROUP BY 1, 2"),
    "c17_perclos": f"WITH {SIG}, {_PER} SELECT user_id, bucket, {r('perclos')} AS perclos FROM pc",
    "c18_tumbling_mean": f"WITH {SIG}, {_TUM} SELECT user_id, bucket, {r('x')} AS x FROM tm",
    "c19_perclos_physio": f"WITH {SIG}, {_PER}, {_TUM} SELECT user_id, bucket, {r('perclos')} AS perclos, {r('x')} AS x FROM pc JOIN tm USING (user_id, bucket)",
    "c20_pupil_average": f"WITH {SIG}, n AS (SELECT user_id, count(*) AS n, greatest(1, CAST(floor(172800.0 * count(*) / (max(t) - min(t))) AS BIGINT)) AS s FROM sig GROUP BY 1 HAVING max(t) > min(t)) SELECT user_id, idx // s AS block, {r('avg(x)')} AS x FROM sig JOIN n USING (user_id) WHERE (idx // s + 1) * s <= n GROUP BY 1, 2",
    "c21_segment": f"WITH {SIG}, n AS (SELECT user_id, count(*) AS n FROM sig GROUP BY 1) SELECT user_id, idx // 20 AS segment, list_concat(list_transform(range(greatest(0, 20 - count(*))), lambda i: 0.0::DOUBLE), list(x ORDER BY idx)) AS values, max_by(event_type, idx) AS label FROM sig JOIN n USING (user_id) WHERE (idx // 20 + 1) * 20 <= n OR n < 20 GROUP BY 1, 2",
    "c22_session_summary": f"WITH {SIG} SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives, {r('count(*) FILTER (event_type = $$error$$) / count(*)', 4)} AS ratio, {r('max(t) - min(t)', 4)} AS duration, {r('100 * (min(t) FILTER (event_type = $$error$$) - min(t)) / nullif(max(t) - min(t), 0)', 4)} AS first_pct, {r('100 * (max(t) FILTER (event_type = $$error$$) - min(t)) / nullif(max(t) - min(t), 0)', 4)} AS last_pct FROM sig GROUP BY 1",
    "c22_session_bins": f"WITH {SIG}, s AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM sig GROUP BY 1) SELECT user_id, CAST(least(floor((t - t0) / nullif(t1 - t0, 0) * 20), 19) AS BIGINT) AS bin, count(*) AS n, {r('avg(CAST(event_type = $$error$$ AS INTEGER))', 4)} AS rate FROM sig JOIN s USING (user_id) GROUP BY 1, 2",
    "d1_asof_nearest": f"WITH {SIG}, j AS (SELECT a.event_id, a.user_id, b.x, b.event_id AS other, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) AS k FROM sig a LEFT JOIN sig b ON a.user_id = b.user_id AND b.event_type = 'click' WHERE a.event_type = 'purchase') SELECT event_id, user_id, x, other FROM j WHERE k = 1",
    "d2_interval_join": f"WITH {SIG} SELECT a.user_id, a.event_id, max_by(b.event_id % 2, b.event_id) AS label FROM sig a JOIN sig b ON a.user_id = b.user_id AND b.event_type = 'error' AND a.t >= b.t AND a.t < b.t + 86400 GROUP BY 1, 2",
    "d3_inner": f"WITH {SIG}, {_PER}, {_TUM} SELECT user_id, count(*) AS n FROM pc JOIN tm USING (user_id, bucket) GROUP BY 1",
    "d4_left_normalised": "SELECT n_name, n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 2) ON c_nationkey = n_nationkey",
    "d5_semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'in' ELSE 'out' END AS side FROM customer",
    "d7_pairs": f"WITH s AS (SELECT s_nationkey AS k, avg(s_acctbal) AS m FROM supplier GROUP BY 1) SELECT a.k AS a, b.k AS b, {r('abs(a.m - b.m)')} AS d FROM s a JOIN s b ON a.k < b.k",
    "d8_knn_join": f"WITH {MATRIX}, q AS (SELECT a.id AS query_id, b.id, sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a.vec[i] - b.vec[i]) ** 2))) AS dist FROM m a JOIN m b ON a.id <> b.id WHERE a.y = 1), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM q) SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5",
    "d9_missing_cells": "WITH o AS (SELECT DISTINCT o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT * FROM (SELECT DISTINCT o_orderstatus FROM o), (SELECT DISTINCT o_orderpriority FROM o), (SELECT DISTINCT day FROM o) EXCEPT SELECT * FROM o",
    "e1_band_ratio": f"SELECT l_orderkey, l_linenumber, {r('((l_quantity + l_extendedprice) / 2 + CASE WHEN (l_discount + l_tax) / 2 = 0 THEN 1e-10 ELSE (l_discount + l_tax) / 2 END) / CASE WHEN (l_tax + l_quantity) / 2 = 0 THEN 1e-10 ELSE (l_tax + l_quantity) / 2 END', 4)} AS ratio FROM lineitem",
    "e2_bin_linear": f"WITH {SIG}, {_TRIM}, f AS (SELECT user_id, min(x) AS lo, max(x) AS hi FROM tr GROUP BY 1) SELECT event_id, CAST(CASE WHEN lo IS NULL OR hi <= lo THEN 1 ELSE 1 + list_sum(list_transform(generate_series(1, 8), lambda k: CAST(x >= lo + (hi - lo) / 9 * k AS INTEGER))) END AS INTEGER) AS label FROM sig LEFT JOIN f USING (user_id)",
    "e3_bin_percentile": f"WITH {SIG}, {_TRIM}, f AS (SELECT user_id, quantile_cont(x, [{', '.join(repr(100.0 / 9 * k / 100) for k in range(1, 8))}]) AS q FROM tr GROUP BY 1) SELECT event_id, CAST(1 + coalesce(list_sum(list_transform(q, lambda v: CAST(x >= v AS INTEGER))), 0) AS INTEGER) AS label FROM sig LEFT JOIN f USING (user_id)",
    "e4_event_ranges": f"WITH {SIG}, {_LABELLED} SELECT user_id, range_no, {r('start', 3)} AS start, {r(chr(34) + 'end' + chr(34), 3)} AS \"end\", label FROM rg",
    "e5_label_by_events": f"WITH {SIG}, {_LABELLED} SELECT event_id, max_by(label, range_no) AS label FROM sig JOIN rg ON sig.user_id = rg.user_id AND t >= start AND t < \"end\" GROUP BY 1",
    "e6_pad_or_truncate": f"WITH {SIG} SELECT a.user_id, a.idx, a.event_id, b.event_type AS label FROM sig a LEFT JOIN sig b ON a.user_id = b.user_id AND a.idx = b.idx + 1 AND b.idx < 30",
}
