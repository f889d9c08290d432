"""Incremental forms agree with their batch twins."""

from pyspark.sql import functions as F

from isopleth.streaming import running

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def stream(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def test_windowed_mean(spark, tmp_path):
    batch, events = stream(spark, tmp_path)
    got = drain(running.windowed_mean(events, "ts", "value", ["event_type"], "1 day", "12 hours", "2 days"), "windowed", "update")
    want = batch.groupBy(F.window("ts", "1 day", "12 hours"), "event_type").agg(F.count("value").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0]


def test_cumulative_average(spark, tmp_path):
    batch, events = stream(spark, tmp_path)
    got = {r.user_id: (r.n, round(r["mean"], 9)) for r in drain(running.cumulative_average(events, "user_id", "value"), "cumulative", "update").collect()}
    want = {r.user_id: (r.n, round(r.m, 9)) for r in batch.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("m")).collect()}
    assert got == want
