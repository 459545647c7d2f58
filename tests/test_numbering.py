"""Numbering, prefix sums and what rests on them, over tables that span many partitions (rows, widths and ties)."""

import pytest
from pyspark.sql import functions as F

from wakelane.operators import joins, models, primitives, resample


@pytest.fixture
def many(spark):
    """Small partitions after shuffles, so that adaptive execution has some to join."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def wide(spark, n, classes=5):
    """n rows of (id, y, vec of 24): every `classes`-th row is of the minority."""
    vec = F.array(*(F.rand(i) for i in range(24)))
    return spark.range(n).select("id", (F.col("id") % classes == 0).cast("int").alias("y"), vec.alias("vec")).repartition(9)


@pytest.mark.parametrize("n", [20_000, 1_000_000])
def test_numbered_is_exact(many, n):
    rows = wide(many, n).withColumn("k", F.md5(F.col("id").cast("string")))
    out = primitives.numbered(rows, [], ["k"], "no")
    got = out.agg(F.count("*").alias("n"), F.count_distinct("no").alias("d"), F.min("no").alias("a"), F.max("no").alias("b"), F.count_distinct("id").alias("ids")).first()
    assert tuple(got) == (n, n, 1, n, n)
    assert out.orderBy("no").select("k").limit(50).collect() == rows.orderBy("k").select("k").limit(50).collect()


def test_indexed_by_key(many):
    rows = many.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 60_000).alias("o"))
    out = primitives.indexed(rows, ["g"], ["o"], "i", "n")
    from pyspark.sql import Window

    w = Window.partitionBy("g")
    want = rows.withColumn("i", (F.row_number().over(w.orderBy("o")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    assert out.exceptAll(want).count() == 0 and out.count() == 60_000


@pytest.mark.parametrize("down", [False, True])
def test_prefix_sum(many, down):
    rows = many.range(50_000).select((F.col("id") * 7919 % 50_000).alias("o"), F.when(F.col("id") % 10 != 0, F.col("id") % 17).alias("a"), (F.col("id") / 4).alias("b"), F.repeat(F.lit("x"), 60).alias("pad"))
    got = primitives.prefix_sum(rows, ["o"], ["a", "b"], down).orderBy("o").collect()
    a = b = 0
    for r in sorted(rows.collect(), key=lambda r: -r.o if down else r.o):
        a, b = a + (r.a or 0), b + r.b
        mine = got[r.o]
        assert mine.o == r.o and mine.cum_a == a and abs(mine.cum_b - b) < 1e-6 * b + 1e-9
    assert len(got) == 50_000


def test_tie_rank_without_keys(many):
    rows = many.range(40_000).select((F.col("id") % 9_001).cast("double").alias("v"))
    got = primitives.tie_rank(rows, [], "v").agg(F.count("*").alias("n"), F.sum("rank").alias("s")).first()
    assert tuple(got) == (40_000, 40_000 * 40_001 / 2)


def test_prefix_sum_of_an_empty_table(spark):
    assert primitives.prefix_sum(spark.createDataFrame([], "o long, v long"), ["o"], ["v"]).count() == 0
    assert primitives.numbered(spark.createDataFrame([], "o long"), [], ["o"], "no").count() == 0


def test_resampling_keeps_its_formulas(many):
    """G1, G2, G7, G8, G10, G11 at 40,000 rows: 8,000 of the minority, 32,000 of the majority."""
    rows = wide(many, 40_000).select("id", "y", F.slice("vec", 1, 4).alias("vec")).cache()
    counts = lambda df: {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    assert counts(resample.random_undersample(rows, "y", "id", 0.8, 3)) == {1: 8_000, 0: 10_000}
    assert counts(resample.random_undersample(rows, "y", "id", 1.0, 4)) == {1: 8_000, 0: 8_000}
    new = resample.smote(rows, "y", 0.5, 3)
    assert new.count() == new.select("n").distinct().count() == 8_000
    both = resample.with_smote(rows, "y", 0.5, 3, after=lambda d: resample.random_undersample(d, "y", "id", 1.0, 5))
    assert counts(both) == {1: 16_000, 0: 16_000}
    for method in ("jitter", "scale", "jitter_scale"):
        made = resample.augment_minority(rows, "y", 0.5, 3, 0.1, method)
        assert made.count() == made.select("n").distinct().count() == 8_000
    per = resample.random_undersample(rows.withColumn("g", F.col("id") % 3), "y", "id", 0.5, 3, ["g"])
    want = {g: (n1, min(n0, 2 * n1)) for g, n1, n0 in rows.groupBy((F.col("id") % 3).alias("g")).agg(F.sum("y"), F.sum(1 - F.col("y"))).collect()}
    assert {r.g: (r.a, r.b) for r in per.groupBy("g").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).collect()} == want


def test_borderline_smote_fills_up(many):
    u = F.when(F.col("y") == 1, F.rand(1) * 0.6 + 0.35).otherwise(F.rand(2))
    rows = wide(many, 3_000, 6).select("id", "y").withColumn("vec", F.array(u, F.rand(3))).cache()
    parents = resample.danger(rows, "y")
    new = resample.borderline_smote(rows, "y", 0.6, 3)
    assert 0 < parents.count() < 500 and new.count() == 1_500 - 500
    assert new.join(parents, new.parent == parents.id, "left_anti").count() == 0


def test_balanced_bag(many):
    rows = wide(many, 6_000, 6).withColumn("vec", F.transform(F.slice("vec", 1, 2), lambda v: v + F.col("y"))).cache()
    train, test = models.split_rows(rows)
    scores = models.balanced_bag(train, test, bags=2)
    got = scores.groupBy("y").agg(F.avg("score").alias("s"), F.count("*").alias("n")).orderBy("y").collect()
    assert sum(r.n for r in got) == test.count() and got[1].s - got[0].s > 0.5


def test_interval_join_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 5, None), (1, 9, "b"), (2, 5, "c"), (None, 5, "d")], "k int, t int, z string")
    ranges = spark.createDataFrame([(1, 0, 6, 10, 1), (1, 4, 7, 20, 2), (2, 6, 9, 30, 3), (None, 0, 9, 40, 4)], "k int, s int, e int, label int, no int")
    got = sorted(joins.interval_join(rows, ranges, "t", ["k"], "s", "e", "label", "no").collect(), key=repr)
    assert [tuple(r) for r in got] == [(1, 5, "a", 20), (1, 5, "a", 20), (1, 5, None, 20)]


def test_joins_rename_and_fill(spark):
    left = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k int, v string")
    right = spark.createDataFrame([(1, "p", 5), (3, "q", 6), (None, "r", 7)], "k int, v string, w int")
    assert sorted(map(tuple, joins.inner_join(left, right, ["k"]).collect())) == [(1, "x", "p", 5)] * 2
    out = joins.left_join(left, right, ["k"], fill={"w": 0})
    assert out.columns == ["k", "v", "v_right", "w"] and sorted(map(tuple, out.collect()), key=repr) == [(1, "x", "p", 5), (1, "x", "p", 5), (2, "y", None, 0), (None, "z", None, 0)]
