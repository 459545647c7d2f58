"""Queries over sources, cleaning and splits (2.A, 2.B, 2.F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakelane.functions.columns import shown
from wakelane.functions.storage import fresh_path
from wakelane.operators import clean, split
from wakelane.plans.base import SIG, fill, r, read, signals
from wakelane.sources import files

SIGNAL_SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def a1_read_signals(spark, d):
    return files.read_signals(spark, f"{d}/events.parquet", SIGNAL_SCHEMA).groupBy("user_id").agg(F.count("*").alias("n"), shown(F.sum("value"), 3).alias("total"))


def a2_read_features(spark, d):
    a, b = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("w"))
    return a.unionByName(b, allowMissingColumns=True)


def a3_select_features(spark, d):
    return files.select_features(read(spark, d, "part"), ["p_"], []).select("p_partkey", "p_size")


def _eval_lines(spark, d):
    """Evaluation records as JSON text, made of orders."""
    o = read(spark, d, "orders")
    p, q = (F.col("o_orderkey") % 97) / 97, (F.col("o_orderkey") % 89) / 89
    rep = F.create_map(F.lit("1"), F.struct(p.alias("precision"), q.alias("recall"), ((p + q) / 2).alias("f1-score"), F.lit(5.0).alias("support")))
    old = F.col("o_orderkey") % 2 == 0
    row = F.struct(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").cast("string").alias("tag"), F.when(old, p).alias("precision"), F.when(old, q).alias("recall"), F.when(old, q).alias("auc"), F.when(~old, p).alias("roc_auc"), F.when(~old, rep).alias("classification_report"), F.array(F.array(F.col("o_custkey"), F.lit(1)), F.array(F.lit(2), F.col("o_orderkey"))).alias("confusion_matrix"))
    return o.select(F.to_json(row).alias("value"))


def a5_read_eval_results(spark, d):
    rows = _eval_lines(spark, d).select(F.from_json("value", files.EVAL_SCHEMA).alias("r")).select("r.*")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count("classification_report").alias("reports"))


def a6_flatten_eval(spark, d):
    rows = _eval_lines(spark, d).select(F.from_json("value", files.EVAL_SCHEMA).alias("r")).select("r.*")
    return fill(files.flatten_eval(rows).select("tag", "precision", "recall", "f1", "auc", "f2", "tn", "tp"))


def _tuning_lines(spark, d):
    """file (a user), line (event_id) and value: errors state tags and modes, other events are trials."""
    e = read(spark, d, "events")
    head = F.concat(F.lit("[Run] tag=t"), F.col("event_id"), F.lit(" mode=m"), F.col("event_id") % 30)
    line = F.when(F.col("event_type") == "error", head).otherwise(F.concat(F.lit("[Search] Trial "), F.col("event_id"), F.lit(": value="), F.format_string("%.2f", "value"), F.lit(", best=9.5")))
    return e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"), line.alias("value"))


def a8_read_tuning_logs(spark, d):
    return files.parse_tuning_logs(_tuning_lines(spark, d))


def _sampling_lines(spark, d):
    """Sampling logs of customers: each order states counts; the last order of a log counts."""
    parts = [F.concat(F.lit("method=smote ratio=0.5 seed="), F.col("o_custkey")), F.concat(F.lit("train n="), F.col("o_orderkey") + 10, F.lit(" pos="), F.col("o_custkey")), F.concat(F.lit("Class distribution after oversampling: ["), F.col("o_orderkey"), F.lit(" "), F.col("o_custkey"), F.lit("]"))]
    return read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file"), (F.col("o_orderkey") * 3).alias("line"), F.posexplode(F.array(*parts)).alias("k", "value")).withColumn("line", F.col("line") + F.col("k")).drop("k")


def a9_read_sampling_logs(spark, d):
    return fill(files.parse_sampling_logs(_sampling_lines(spark, d)))


def _as_files(spark, lines, name):
    """Writes lines as text files, one folder a log, in the order of the lines."""
    path = fresh_path(spark, name)
    lines.withColumnRenamed("file", "log").repartition("log").sortWithinPartitions("log", "line").select("log", "value").write.partitionBy("log").text(path)
    return path


def _log_name(df):
    return df.withColumn("file", F.regexp_extract("file", "log=([^/]+)", 1))


def a9_log_files(spark, d):
    """Sampling logs of customers with few, written as files and read back; one file a segment and nation."""
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), F.concat_ws("-", "c_nationkey", F.lower("c_mktsegment")).alias("log"))
    lines = _sampling_lines(spark, d).join(c, "file").select(F.col("log").alias("file"), "line", "value")
    return fill(_log_name(files.read_sampling_logs(spark, _as_files(spark, lines, "sampling"))))


def a11_log_files(spark, d):
    """Hyper-parameter logs, a file a part size, read back: the last statement of each counts."""
    path = _as_files(spark, _parameter_lines(spark, d), "parameters")
    return _log_name(files.read_hyperparameters(spark, path, ["depth", "kind", "boot", "w"]))


def a2_feature_files(spark, d):
    """Feature CSVs of two generations of columns, one folder per recording, written and read back."""
    named = lambda k, run: F.format_string(f"S%04d_{run}", F.col(k).cast("int"))
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), named("c_nationkey", 1).alias("recording"))
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("w"), named("s_nationkey", 2).alias("recording"))
    paths = [fresh_path(spark, "features") for _ in range(2)]
    for rows, path in zip((old, new), paths):
        rows.write.partitionBy("recording").option("header", "true").csv(path)
    return files.read_features(spark, paths, ["k long, v double", "k long, w int"]).select("subject_id", "k", "v", "w")


def a6_evaluation_files(spark, d):
    """Evaluation records written as JSON, a folder per model, read from all folders and made flat."""
    path = fresh_path(spark, "evaluation")
    model = F.get_json_object("value", "$.model")
    _eval_lines(spark, d).withColumn("folder", F.substring(model, 1, 1)).write.partitionBy("folder").text(path)
    return fill(files.flatten_eval(files.read_eval_results(spark, path)).select("model", "tag", "precision", "recall", "f1", "auc", "f2", "tn", "tp"))


def a7_result_files(spark, d):
    """The flat CSV beside the JSON of write_results, read back."""
    path = fresh_path(spark, "results")
    rows = _eval_lines(spark, d).select(F.from_json("value", files.EVAL_SCHEMA).alias("r")).select("r.*")
    files.write_results(rows, path)
    schema = files.flatten_eval(rows).schema
    back = spark.read.schema(schema).option("header", "true").csv(f"{path}/csv")
    return fill(back.select("model", "tag", "precision", "recall", "f1", "auc", "f2", "tn", "tp"))


def a8_log_files(spark, d):
    """Tuning logs of users, a file for each hundred of them, read line by line."""
    lines = _tuning_lines(spark, d).withColumn("file", (F.col("file").cast("long") % 100).cast("string"))
    return _log_name(files.read_tuning_logs(spark, _as_files(spark, lines, "logs")))


def a10_matrix_to_pairs(spark, d):
    n = read(spark, d, "nation")
    m = n.groupBy("n_regionkey").pivot("n_regionkey", [0, 1, 2, 3, 4]).agg(F.sum("n_nationkey").cast("double"))
    m = m.select(F.col("n_regionkey").cast("string").alias("r"), *(F.coalesce(F.col(str(k)), F.lit(0.0)).alias(str(k)) for k in range(5)))
    return files.matrix_to_pairs(m, "r", ["0", "1", "2", "3", "4"], "sum")


def _parameter_lines(spark, d):
    """file (a part size), line (the part) and value: best parameters in Python notation."""
    return read(spark, d, "part").select(F.col("p_size").cast("string").alias("file"), F.col("p_partkey").alias("line"), F.concat(F.lit("Best params: {'depth': "), F.col("p_partkey"), F.lit(", 'kind': '"), F.col("p_brand"), F.lit("', 'boot': True, 'w': None}")).alias("value"))


def a11_read_hyperparameters(spark, d):
    return files.parse_hyperparameters(_parameter_lines(spark, d), ["depth", "kind", "boot", "w"])


LI = ["l_quantity", "l_extendedprice", "l_discount"]


def _items(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LI)


def b2_drop_eeg_columns(spark, d):
    s = read(spark, d, "supplier").withColumnsRenamed({"s_acctbal": "Channel_1_Theta"})
    return clean.drop_eeg_columns(s)


def b3_clean_features(spark, d):
    return clean.clean_features(read(spark, d, "customer"), ["c_nationkey"])


def b4_align_columns(spark, d):
    return clean.align_columns(read(spark, d, "supplier"), ["s_acctbal", "missing", "s_suppkey"])


def b6_fix_nonfinite(spark, d):
    q = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return fill(clean.fix_nonfinite(_items(spark, d).withColumn("l_quantity", q), ["l_quantity"]))


def b7_prepare_eval_features(spark, d):
    i = _items(spark, d)
    return fill(clean.prepare_eval_features(i, LI, i.where("l_linenumber < 3")))


def b8_outlier_trim(spark, d):
    from wakelane.operators.labels import trimmed

    return trimmed(signals(spark, d), ["user_id"], "x", 1.5).select("event_id", "x")


def b9_outlier_interpolate(spark, d):
    return clean.outlier_interpolate(signals(spark, d), ["user_id"], "x", k=1.5).select("event_id", shown("x").alias("x"))


def b10_jitter(spark, d):
    return fill(clean.jitter(_items(spark, d).withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")), ["l_quantity"], 0.1, 3, "k").select("k", "l_quantity"))


def b11_standardize(spark, d):
    i = _items(spark, d)
    return fill(clean.standardize(i, LI, i.where("l_linenumber < 4")))


def b12_global_standardize(spark, d):
    i = _items(spark, d)
    return fill(clean.standardize(i, LI, i, 1e-12))


def b13_minmax_scale(spark, d):
    i = _items(spark, d)
    return fill(clean.minmax_scale(i, LI, i.where("l_linenumber < 4")))


def b14_filter_by_mode(spark, d):
    c, t = read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return clean.filter_by_mode(c, t, "source_only", "c_nationkey").select("c_custkey", F.lit("source").alias("m")).unionByName(clean.filter_by_mode(c, t, "target_only", "c_nationkey").select("c_custkey", F.lit("target").alias("m")))


def b15_parse_tag(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    o = read(spark, d, "orders").select("o_orderkey", F.concat_ws("_", F.lit("rank"), pick(["knn", "lof", "x"], "o_orderkey"), pick(["mmd", "dtw"], "o_custkey"), pick(["in_domain", "out_domain"], "o_orderkey"), pick(["smote", "sw_smote", "rus"], "o_custkey"), pick(["mixed", "source_only"], "o_custkey"), F.concat(F.lit("s"), F.col("o_custkey")), F.lit("ratio0_5")).alias("tag"))
    return o.select("o_orderkey", *clean.parse_tag("tag"))


def b16_binary_label(spark, d):
    p = read(spark, d, "part").withColumn("k", F.col("p_size") % 10)
    return p.select("p_partkey", clean.binary_label("k").alias("a"), clean.binary_label("k", keep_middle=True).alias("b"))


def f1_stratified_split(spark, d):
    return split.stratified_split(read(spark, d, "orders"), "o_orderstatus", "o_orderkey", 11).select("o_orderkey", "split")


def f2_subject_split(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") < 3, "train").when(F.col("n_regionkey") == 3, "val").alias("split")).where("split IS NOT NULL")
    return split.subject_split(read(spark, d, "customer"), n, "c_nationkey", ["c_acctbal"]).select("c_custkey", "split")


def f3_subject_time_split(spark, d):
    return split.subject_time_split(signals(spark, d), ["user_id"], ["idx"]).select("event_id", "split")


def f4_time_stratified_split(spark, d):
    days = read(spark, d, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("pos"))
    return split.time_cuts(days, ["h"])


def f5_group_shuffle_split(spark, d):
    return split.group_shuffle_split(read(spark, d, "customer"), "c_nationkey", 5).select("c_custkey", "split")


def f6_finetune_split(spark, d):
    t = read(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return split.finetune_split(read(spark, d, "customer"), t, "c_nationkey", "c_custkey", 5).select("c_custkey", "split")


def f7_mode_split(spark, d):
    s = signals(spark, d)
    t = s.where("user_id % 3 = 0").select("user_id").distinct()
    return split.mode_split(s, t, "user_id", ["idx"], "source_only").select("event_id", "split", F.lit("s").alias("m")).unionByName(split.mode_split(s, t, "user_id", ["idx"], "mixed").select("event_id", "split", F.lit("m").alias("m")))


def f9_split_summary(spark, d):
    s = split.subject_time_split(signals(spark, d), ["user_id"], ["idx"]).withColumn("y", (F.col("event_type") == "error").cast("int"))
    return fill(split.split_summary(s, "y"))


def f10_stratified_kfold(spark, d):
    return split.stratified_kfold(read(spark, d, "orders"), "o_orderstatus", "o_orderkey", 3, 11).select("o_orderkey", "fold")


def f11_stratified_subsample(spark, d):
    return split.stratified_subsample(read(spark, d, "orders"), "o_orderstatus", "o_orderkey", 200, 11).select("o_orderkey")


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "abf" and k[1:2].isdigit() and callable(f)}

_CUT = "CASE WHEN k < floor(n * 0.6 + 1e-9) THEN 'train' WHEN k < floor(n * 0.6 + 1e-9) + floor(n * 0.2 + 1e-9) THEN 'val' ELSE 'test' END"
_TIMED = f"ts AS (SELECT *, {_CUT} AS split FROM (SELECT user_id, event_id, event_type, idx AS k, count(*) OVER (PARTITION BY user_id) AS n FROM sig))"
_U = lambda seed, key: f"CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"
_Z = lambda c, where: f"({c} - (SELECT avg({c}) FROM lineitem{where})) / (SELECT stddev_pop({c}) FROM lineitem{where})"
_PICK = lambda xs, c: f"list_extract([{', '.join(repr(x) for x in xs)}], CAST({c} % {len(xs)} + 1 AS INTEGER))"
_FLAT = f"WITH o AS (SELECT o_orderpriority AS model, o_orderkey AS k, o_custkey AS c, (o_orderkey % 97) / 97 AS p, (o_orderkey % 89) / 89 AS q FROM orders) SELECT model, CAST(k AS VARCHAR) AS tag, {r('p')} AS precision, {r('q')} AS recall, {r('CASE WHEN k % 2 <> 0 THEN (p + q) / 2 END')} AS f1, {r('CASE WHEN k % 2 = 0 THEN q ELSE p END')} AS auc, {r('CASE WHEN 4 * p + q > 0 THEN 5 * p * q / (4 * p + q) END')} AS f2, c AS tn, k AS tp FROM o"
_TUNING = lambda key: f"WITH e AS (SELECT *, {key} AS file FROM events), h AS (SELECT file, arg_min('t' || event_id, event_id) AS tag, arg_min('m' || event_id % 30, event_id) AS mode FROM e WHERE event_type = 'error' GROUP BY 1) SELECT e.file, tag, mode, CAST(event_id AS INTEGER) AS trial, round(value, 2) AS value, 9.5::DOUBLE AS best FROM e LEFT JOIN h ON h.file = e.file WHERE event_type <> 'error'"
_SAMPLING = lambda key, rows: f"SELECT {key} AS file, 'smote' AS method, 0.5::DOUBLE AS ratio, CAST(arg_max(o_custkey, o_orderkey) AS INTEGER) AS seed, max(o_orderkey) + 10 AS n, arg_max(o_custkey, o_orderkey) AS pos, max(o_orderkey) AS after_neg, arg_max(o_custkey, o_orderkey) AS after_pos, {r('arg_max(o_custkey, o_orderkey) / nullif(max(o_orderkey), 0)')} AS after_ratio FROM {rows} GROUP BY 1"
_PARAMETERS = "SELECT CAST(p_size AS VARCHAR) AS file, CAST(max(p_partkey) AS VARCHAR) AS depth, arg_max(p_brand, p_partkey) AS kind, 'true' AS boot, NULL::VARCHAR AS w FROM part GROUP BY 1"
ORACLES = {
    "a1_read_signals": f"SELECT user_id, count(*) AS n, {r('sum(value)', 3)} AS total FROM events GROUP BY 1",
    "a2_feature_files": "SELECT printf('S%04d_1', c_nationkey) AS subject_id, c_custkey AS k, c_acctbal AS v, NULL::INTEGER AS w FROM customer UNION ALL SELECT printf('S%04d_2', s_nationkey), s_suppkey, NULL, s_nationkey FROM supplier",
    "a6_evaluation_files": _FLAT,
    "a7_result_files": _FLAT,
    "a8_log_files": _TUNING("CAST(user_id % 100 AS VARCHAR)"),
    "a2_read_features": "SELECT c_custkey AS k, c_acctbal AS v, NULL::BIGINT AS w FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier",
    "a3_select_features": "SELECT p_partkey, p_size FROM part",
    "a5_read_eval_results": "SELECT o_orderpriority AS model, count(*) AS n, count(*) FILTER (o_orderkey % 2 <> 0) AS reports FROM orders GROUP BY 1",
    "a6_flatten_eval": f"WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, (o_orderkey % 97) / 97 AS p, (o_orderkey % 89) / 89 AS q FROM orders) SELECT CAST(k AS VARCHAR) AS tag, {r('p')} AS precision, {r('q')} AS recall, {r('CASE WHEN k % 2 <> 0 THEN (p + q) / 2 END')} AS f1, {r('CASE WHEN k % 2 = 0 THEN q ELSE p END')} AS auc, {r('CASE WHEN 4 * p + q > 0 THEN 5 * p * q / (4 * p + q) END')} AS f2, c AS tn, k AS tp FROM o",
    "a8_read_tuning_logs": _TUNING("CAST(user_id AS VARCHAR)"),
    "a9_read_sampling_logs": _SAMPLING("CAST(o_custkey AS VARCHAR)", "orders"),
    "a9_log_files": _SAMPLING("c_nationkey || '-' || lower(c_mktsegment)", "orders JOIN customer ON o_custkey = c_custkey"),
    "a11_log_files": _PARAMETERS,
    "a10_matrix_to_pairs": "SELECT 'sum' AS metric, CAST(a.k AS VARCHAR) AS a, CAST(b.k AS VARCHAR) AS b, CASE WHEN a.k = b.k THEN (SELECT sum(n_nationkey) FROM nation WHERE n_regionkey = a.k) ELSE 0 END AS d FROM (SELECT unnest(range(5)) AS k) a, (SELECT unnest(range(5)) AS k) b",
    "a11_read_hyperparameters": _PARAMETERS,
    "b2_drop_eeg_columns": "SELECT * EXCLUDE (s_acctbal) FROM supplier",
    "b3_clean_features": "SELECT c_custkey, c_acctbal FROM customer",
    "b4_align_columns": "SELECT s_acctbal, 0.0::DOUBLE AS missing, s_suppkey FROM supplier",
    "b6_fix_nonfinite": f"SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_linenumber IN (1, 2) THEN (SELECT avg(l_quantity) FROM lineitem WHERE l_linenumber NOT IN (1, 2)) ELSE l_quantity END')} AS l_quantity, {r('l_extendedprice')} AS l_extendedprice, {r('l_discount')} AS l_discount FROM lineitem",
    "b7_prepare_eval_features": "SELECT " + ", ".join(f"{r(_Z(c, ' WHERE l_linenumber < 3'))} AS {c}" for c in LI) + " FROM lineitem",
    "b8_outlier_trim": f"WITH {SIG} SELECT event_id, x FROM (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM sig WINDOW w AS (PARTITION BY user_id)) WHERE abs(x - m) <= 1.5 * s",
    "b9_outlier_interpolate": f"WITH {SIG}, z AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM sig WINDOW w AS (PARTITION BY user_id)), v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM z WHERE abs(x - m) <= 1.5 * s), q AS (SELECT z.*, (SELECT max(k) FROM v WHERE v.user_id = z.user_id AND v.idx <= z.idx) AS kp, (SELECT max(c) FROM v WHERE v.user_id = z.user_id) AS c FROM z), w AS (SELECT q.*, greatest(1, least(coalesce(kp, 1), c - 1)) AS ka FROM q) SELECT w.event_id, {r('CASE WHEN abs(w.x - w.m) <= 1.5 * w.s THEN w.x ELSE a.x + (b.x - a.x) * (w.idx - a.idx) / (b.idx - a.idx) END')} AS x FROM w LEFT JOIN v a ON a.user_id = w.user_id AND a.k = ka LEFT JOIN v b ON b.user_id = w.user_id AND b.k = ka + 1",
    "b10_jitter": f"WITH i AS (SELECT l_orderkey || '-' || l_linenumber AS k, l_quantity FROM lineitem) SELECT k, {r('l_quantity + 0.1 * sqrt(-2 * ln(greatest(' + _U(3, chr(39) + 'l_quantity:' + chr(39) + ' || k') + ', 2.0 ** -33))) * cos(2 * pi() * ' + _U(4, chr(39) + 'l_quantity:' + chr(39) + ' || k') + ')')} AS l_quantity FROM i",
    "b11_standardize": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r(_Z(c, ' WHERE l_linenumber < 4'))} AS {c}" for c in LI) + " FROM lineitem",
    "b12_global_standardize": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r(_Z(c, ''))} AS {c}" for c in LI) + " FROM lineitem",
    "b13_minmax_scale": "SELECT l_orderkey, l_linenumber, " + ", ".join(r(f"({c} - (SELECT min({c}) FROM lineitem WHERE l_linenumber < 4)) / (SELECT max({c}) - min({c}) FROM lineitem WHERE l_linenumber < 4)") + f" AS {c}" for c in LI) + " FROM lineitem",
    "b14_filter_by_mode": "SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'target' ELSE 'source' END AS m FROM customer",
    "b15_parse_tag": f"SELECT o_orderkey, nullif({_PICK(['knn', 'lof', 'x'], 'o_orderkey')}, 'x') AS ranking, {_PICK(['mmd', 'dtw'], 'o_custkey')} AS distance, {_PICK(['in_domain', 'out_domain'], 'o_orderkey')} AS level, {_PICK(['smote', 'sw_smote', 'rus'], 'o_custkey')} AS imbalance, {_PICK(['mixed', 'source_only'], 'o_custkey')} AS mode, CAST(o_custkey AS INTEGER) AS seed, 0.5::DOUBLE AS ratio FROM orders",
    "b16_binary_label": "SELECT p_partkey, CASE WHEN p_size % 10 <= 5 THEN 0 WHEN p_size % 10 >= 8 THEN 1 END AS a, CASE WHEN p_size % 10 <= 6 THEN 0 WHEN p_size % 10 >= 8 THEN 1 END AS b FROM part",
    "f1_stratified_split": f"SELECT o_orderkey, {_CUT} AS split FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('11:' || o_orderkey), o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)",
    "f2_subject_split": "SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN 'train' ELSE 'val' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <= 3 AND c_acctbal IS NOT NULL",
    "f3_subject_time_split": f"WITH {SIG}, {_TIMED} SELECT event_id, split FROM ts",
    "f4_time_stratified_split": "WITH h AS (SELECT floor(epoch_us(ts) / 3600000000) AS h, count(*) AS n, count(*) FILTER (event_type = 'error') AS pos FROM events GROUP BY 1), c AS (SELECT sum(n) OVER (ORDER BY h) AS i, sum(pos) OVER (ORDER BY h) AS p, sum(n) OVER () AS N, sum(pos) OVER () AS T FROM h), q AS (SELECT a.i, b.i AS j, a.N, round(2 * (abs(a.p / a.i - a.T / a.N) + abs((b.p - a.p) / (b.i - a.i) - a.T / a.N) + abs((a.T - b.p) / (a.N - b.i) - a.T / a.N)) + abs(a.i / a.N - 0.6) + abs((b.i - a.i) / a.N - (1 - 0.6 - 0.2)) + abs((a.N - b.i) / a.N - 0.2), 9) AS loss FROM c a, c b WHERE a.i BETWEEN greatest(100, round(a.N * 0.6) - greatest(1, round(a.N * 0.1))) AND least(round(a.N * 0.6) + greatest(1, round(a.N * 0.1)), a.N - 200) AND b.i BETWEEN greatest(100, round(a.N * 0.8) - greatest(1, round(a.N * 0.1))) AND least(round(a.N * 0.8) + greatest(1, round(a.N * 0.1)), a.N - 100) AND b.i >= a.i + 100) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM q ORDER BY loss, i, j LIMIT 1",
    "f5_group_shuffle_split": "WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5('5:' || c_nationkey), c_nationkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, CASE WHEN k <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM customer JOIN g USING (c_nationkey)",
    "f6_finetune_split": "SELECT c_custkey, CASE WHEN n_regionkey <> 2 THEN 'train' WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('5:' || c_custkey), c_custkey) % 2 = 1 THEN 'val' ELSE 'test' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "f7_mode_split": f"WITH {SIG}, {_TIMED} SELECT event_id, split, 's' AS m FROM ts WHERE (user_id % 3 <> 0 AND split <> 'test') OR (user_id % 3 = 0 AND split = 'test') UNION ALL SELECT event_id, split, 'm' FROM ts WHERE split = 'train' OR user_id % 3 = 0",
    "f9_split_summary": f"WITH {SIG}, {_TIMED} SELECT coalesce(split, 'total') AS split, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives, {r('count(*) FILTER (event_type = $$error$$) / count(*)')} AS rate FROM ts GROUP BY ROLLUP (split)",
    "f10_stratified_kfold": "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('11:' || o_orderkey), o_orderkey) - 1) % 3 AS INTEGER) AS fold FROM orders",
    "f11_stratified_subsample": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('11:' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS c, count(*) OVER () AS n FROM orders) WHERE k <= greatest(1, floor(c * least(1.0, 200 / n)))",
}
