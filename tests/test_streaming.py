from pyspark.sql import functions as F

from rowloom.streaming import events as E


def test_windows(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    n = events.count()
    assert E.tumbling(events, "1 hour").agg(F.sum("n")).first()[0] == n
    assert E.tumbling(events, "1 hour", slide="30 minutes").agg(F.sum("n")).first()[0] == 2 * n
    assert E.sessions(events, "1 hour").agg(F.sum("n")).first()[0] == n


def test_stream_of_windows(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = E.tumbling(stream, "1 day", late="1 hour").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == events.count()


def test_change_feed(spark, tmp_path):
    spark.range(10).select("id", F.when(F.col("id") < 8, "W").otherwise("?").alias("op")).write.parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema("id long, op string").parquet(f"{tmp_path}/feed")
    q = E.consume_changes(feed, "op IN ('W', 'D')", lambda df: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/dead", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 2
