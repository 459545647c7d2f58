"""The streaming features equal the batch ones on the same rows."""

from pyspark.sql import functions as F

from wakelane.streaming.windows import run_to_memory, stream_features

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    query = run_to_memory(stream_features(stream, "user_id", "ts", "value", "1 day", "0 seconds"), "features", "complete")
    query.processAllAvailable()
    query.stop()
    want = batch.groupBy(F.window("ts", "1 day").start.alias("start"), "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    got = spark.sql("SELECT * FROM features").select("start", "user_id", F.round("mean", 6), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("start", "user_id", F.round("mean", 6), "n").collect()))
