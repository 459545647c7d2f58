"""Sources and sinks (2.A): recordings, feature tables, evaluation JSON, logs, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = "map<string, struct<precision:double, recall:double, `f1-score`:double, support:double>>"
EVAL_SCHEMA = f"""model string, mode string, tag string, distance string, level string, accuracy double, precision double, recall double, f1 double, f1_pos double,
 roc_auc double, auc double, auc_pr double, thr double, confusion_matrix array<array<long>>, roc_curve struct<fpr: array<double>, tpr: array<double>, auc: double>,
 pr_curve struct<precision: array<double>, recall: array<double>>, classification_report {REPORT}"""


def read_signals(spark: SparkSession, path: str | Sequence[str], schema: str, fmt: str = "parquet") -> DataFrame:
    """A1: recordings with a stated schema; files that went missing are skipped."""
    return spark.read.format(fmt).schema(schema).option("ignoreMissingFiles", "true").option("header", "true").load(path)


def read_features(spark: SparkSession, paths: Sequence[str], schemas: Sequence[str], pattern: str = r"(S\d{4}_\d+)") -> DataFrame:
    """A2: feature CSVs by generation of columns, joined by name; subject_id comes from the file name."""
    out = None
    for path, schema in zip(paths, schemas, strict=True):
        one = spark.read.schema(schema).option("header", "true").option("ignoreMissingFiles", "true").csv(path).withColumn("subject_id", F.regexp_extract(F.input_file_name(), pattern, 1))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def select_features(df: DataFrame, prefixes: Sequence[str], not_features: Sequence[str]) -> DataFrame:
    """A3: columns with one of the prefixes; without any match all but labels and ids."""
    named = [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    return df.select(*(named or [c for c in df.columns if c not in not_features]))


def write_features(df: DataFrame, path: str, by: Sequence[str] = ("stage", "pipeline")) -> None:
    """A4: Parquet partitioned by stage and pipeline."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_eval_results(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A5: evaluation records in all folders below path; records that do not parse are null rows and go."""
    rows = spark.read.schema(EVAL_SCHEMA).option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.coalesce("tag", "model").isNotNull())


def fbeta(p: Column, r: Column, beta: float = 2.0) -> Column:
    b = beta * beta
    return F.when(b * p + r > 0, (1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)))


def flatten_eval(df: DataFrame) -> DataFrame:
    """One flat row per record, metric names of all generations brought together, F2 added."""
    report = lambda f: F.coalesce(F.try_element_at("classification_report", F.lit("1"))[f], F.try_element_at("classification_report", F.lit("1.0"))[f], F.try_element_at("classification_report", F.lit("macro avg"))[f])
    p, r = F.coalesce("precision", report("precision")), F.coalesce("recall", report("recall"))
    cell = lambda i, j: F.col("confusion_matrix")[i][j]
    return df.select("model", "mode", "tag", "distance", "level", "accuracy", p.alias("precision"), r.alias("recall"), F.coalesce("f1", "f1_pos", report("f1-score")).alias("f1"), F.coalesce("auc", "roc_auc", F.col("roc_curve.auc")).alias("auc"), "auc_pr", "thr", fbeta(p, r).alias("f2"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def write_results(df: DataFrame, path: str) -> None:
    """Nested records as JSON, and their flat form as CSV beside it."""
    df.write.mode("overwrite").json(f"{path}/json")
    flatten_eval(df).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, line, value: the lines of text logs in all folders below path; line orders a file's lines.

    A line's place is where its split of the file begins, and its row in there.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    return rows.select(F.input_file_name().alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"), "value")


def _stated(value: Column, line: str, last: bool = False) -> Column:
    """The first (or last) non-empty value by line."""
    some = F.nullif(value, F.lit(""))
    return (F.max_by if last else F.min_by)(some, F.when(some.isNotNull(), F.col(line)))


def parse_tuning_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """File, tag, mode, trial, value, best: one row per trial; tag and mode are the first stated in the file, by line number."""
    first = lines.groupBy("file").agg(*(_stated(F.regexp_extract("value", p, 1), line).alias(n) for n, p in (("tag", r"tag=(\S+)"), ("mode", r"mode=(\w+)"))))
    pattern = r"Trial\s+(\d+): value=(-?[\d.]+), best=(-?[\d.]+)"
    trials = lines.where(F.col("value").rlike(pattern)).select("file", *(F.regexp_extract("value", pattern, k).cast(t).alias(n) for k, n, t in ((1, "trial", "int"), (2, "value", "double"), (3, "best", "double"))))
    return trials.join(first, "file", "left").select("file", "tag", "mode", "trial", "value", "best")


def parse_sampling_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """File, method, ratio, seed, class counts before and after, ratio reached; of several statements the last in the file."""
    got = lambda p, k=1: _stated(F.regexp_extract("value", p, k), line, last=True)
    after = r"Class distribution after oversampling: \[\s*(\d+)[,\s]+(\d+)\s*\]"
    one = lines.groupBy("file").agg(got(r"method=(\w+)").alias("method"), got(r"ratio=([\d.]+)").cast("double").alias("ratio"), got(r"seed=(\d+)").cast("int").alias("seed"), got(r"train n=(\d+) pos=(\d+)").cast("long").alias("n"), got(r"train n=(\d+) pos=(\d+)", 2).cast("long").alias("pos"), got(after).cast("long").alias("after_neg"), got(after, 2).cast("long").alias("after_pos"))
    return one.withColumn("after_ratio", F.col("after_pos") / F.nullif(F.col("after_neg"), F.lit(0)))


def parse_hyperparameters(lines: DataFrame, names: Sequence[str], line: str = "line") -> DataFrame:
    """Best-parameter dictionaries of Python notation, one column per parameter, the last of each file by line number."""
    text = F.regexp_extract("value", r"[Bb]est (?:hyper)?param\w*: (\{.*\})", 1)
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    last = lines.where(text != "").groupBy("file").agg(F.max_by(F.from_json(json, "map<string,string>"), line).alias("p"))
    return last.select("file", *(F.col("p")[n].alias(n) for n in names))


def read_tuning_logs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A8 over all files below path."""
    return parse_tuning_logs(log_lines(spark, path))


def read_sampling_logs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A9 over all files below path."""
    return parse_sampling_logs(log_lines(spark, path))


def read_hyperparameters(spark: SparkSession, path: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """A11 over all files below path."""
    return parse_hyperparameters(log_lines(spark, path), names)


def matrix_to_pairs(df: DataFrame, row_col: str, columns: Sequence[str], metric: str) -> DataFrame:
    """A10: a square matrix (one row per name, one column per name) as metric, a, b, d.

    Rows must be named like the columns, one each; another shape is an error.
    """
    names = [r[0] for r in df.select(row_col).limit(len(columns) + 1).collect()]
    if sorted(names) != sorted(columns):
        raise ValueError("the matrix is not square over its names")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("b"), F.col(f"`{c}`").cast(T.DoubleType()).alias("d")) for c in columns))).alias("c")
    return df.select(F.lit(metric).alias("metric"), F.col(row_col).alias("a"), cells).select("metric", "a", "c.b", "c.d")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """L1: the row with the largest order of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
