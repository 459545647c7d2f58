"""Language ID: held-out accuracy, independence of labels, odd rows."""

from pyspark.sql import functions as F

from wakelane.llm import langid
from wakelane.llm.queries import op4_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op4_language(spark, sf).join(docs, "doc_id").where("held_out")
    rows = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert rows.n > 150 and rows.a > 0.93
    assert 0 <= rows.lo <= rows.hi <= 1


def test_odd_rows(spark):
    model = {"aa": langid.plain("the cat sat on the mat and then the dog came " * 9), "bb": langid.plain("der hund und die katze sind nicht auf dem tisch " * 9)}
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 34 !?", "x"), (4, "the dog sat on the mat", "x"), (5, "die katze und der hund", "x"), (5, "die katze und der hund", "x"), (6, "THE DOG CAME AND SAT. " * 20000, "x")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    got = sorted((r.doc_id, r.lang_pred, r.lang_rejected) for r in out)
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "aa", False), (5, "bb", False), (5, "bb", False), (6, "aa", False)]


def test_brute_force_sizes():
    import zstandard as z

    model = {"aa": b"the cat sat on the mat", "bb": b"der hund und die katze"}
    settings = z.ZstdCompressionParameters.from_level(5, min_match=4)
    for text in ["the cat sat", "und die katze", "x y z"]:
        sizes = {k: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(v, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(text.encode())) for k, v in model.items()}
        assert langid.classify(text, tuple(sorted(model.items())))[0] == min(sorted(sizes), key=sizes.get)


def test_labels_are_no_input(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i}", "en") for i in range(30)] + [(100 + i, f"der hund ist im haus {i}", "de") for i in range(30)] + [(200, "nichts", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert sorted(model) == ["de", "en"]
    a = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(empty) == {}
    assert langid.identify(empty, {}).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), {}).first().lang_pred == "und"
