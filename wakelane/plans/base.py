"""How the given tables stand in for recordings, feature matrices and result grids, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakelane.functions.columns import OFF_TIE
from wakelane.functions.storage import written
from wakelane.operators.primitives import row_index, sliding_frames

SIZE, STEP, RATE = 16, 8, 60.0
KEYS, BY = ["user_id"], ["user_id", "win"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as recordings: user_id, idx, t (seconds), x, event_type, event_id."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("x"), "event_type")
    return row_index(e, KEYS, ["ts", "event_id"]).drop("ts")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_frames(signals(spark, sf_dir), KEYS, SIZE, STEP)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a feature matrix: id, y (1 for label 0), label, vec (doubles)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def features(df: DataFrame, n: int) -> DataFrame:
    """Long form of the first n vector components: f, v next to the other columns."""
    return df.select(*[c for c in df.columns if c != "vec"], F.posexplode(F.slice("vec", 1, n)).alias("f", "v"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as predictions: row_id, y (returned), score (discount, heavily tied), grp (ship mode of the key)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"), F.col("l_linestatus").alias("grp"), "l_suppkey")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders as a result grid: condition, mode, distance, level, seed and a metric per cell and block.

    The cells are few and written once: plans refer to them many times, and each would join the tables again.
    """
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    cell = [F.col("o_orderpriority").alias("condition"), F.col("l_returnflag").alias("mode"), F.col("o_orderstatus").alias("distance"), F.col("l_linestatus").alias("level"), F.month("l_shipdate").alias("seed")]
    return written(rows.groupBy(*cell).agg(F.round(F.avg("l_discount"), 6).alias("f2"), F.round(F.avg("l_tax"), 6).alias("auc"), F.round(F.avg("l_quantity"), 6).alias("recall")), "grid")


def r(sql: str, digits: int = 6) -> str:
    """SQL that rounds as functions.columns.shown does."""
    return f"round(({sql}) + {OFF_TIE!r}, {digits})"


SIG = "sig AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
FRAMES = SIG + f""", len AS (SELECT user_id, count(*) AS n FROM sig GROUP BY user_id),
fr0 AS (SELECT sig.*, n, unnest([idx // {STEP} - 1, idx // {STEP}]) AS win FROM sig JOIN len USING (user_id)),
fr AS (SELECT user_id, event_id, event_type, t, x, idx, win FROM fr0 WHERE win >= 0 AND win * {STEP} <= idx AND idx < win * {STEP} + {SIZE} AND win * {STEP} + {SIZE} <= n)"""
MATRIX = "m AS (SELECT vec_id AS id, CAST(label = 0 AS INTEGER) AS y, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS vec FROM embeddings)"
SCORED = "s AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 5 + l_tax AS score, l_linestatus AS grp, l_suppkey FROM lineitem)"
GRID = """g AS (SELECT o_orderpriority AS condition, l_returnflag AS mode, o_orderstatus AS distance, l_linestatus AS level, month(l_shipdate) AS seed,
  round(avg(l_discount), 6) AS f2, round(avg(l_tax), 6) AS auc, round(avg(l_quantity), 6) AS recall
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def long_matrix(n: int) -> str:
    return MATRIX + f", lm AS (SELECT id, y, label, k - 1 AS f, vec[k] AS v FROM m, (SELECT unnest(generate_series(1, {n})) AS k))"


def fill(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Rounds every double column of a result."""
    return df.select(*(F.round(F.col(c) + OFF_TIE, digits).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


