"""Series and grids made from star-schema tables, and thin readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    df.write.format(kind).mode(mode).partitionBy(*(partition_by or [])).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, t, v): each user's events in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("int").alias("t"), F.col("value").alias("v"))


def hourly(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """(keys, t, v): sums of the events of each hour, zero where there are none.

    The spine runs from the first to the last hour of the data: a dimension, as
    long as their span, not as the data; it meets each key once, as the result does.
    """
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    sums = table(spark, sf_dir, "events").groupBy(*keys, hour.alias("h")).agg(F.sum("value").alias("s"))
    ends = sums.agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    spine = ends.select("h0", F.explode(F.sequence("h0", "h1")).alias("h"))
    if keys:
        spine = sums.select(*keys).distinct().crossJoin(F.broadcast(spine))
    return spine.join(sums, [*keys, "h"], "left").select(*keys, (F.col("h") - F.col("h0")).cast("int").alias("t"), F.coalesce("s", F.lit(0.0)).alias("v"))


def day_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, hour, v)"""
    return hourly(spark, sf_dir).select(F.floor(F.col("t") / 24).cast("int").alias("day"), (F.col("t") % 24).alias("hour"), "v")


def _coords() -> dict:
    return {
        "lat": (F.col("l_orderkey") % 18 * 10 - 85).cast("double"),
        "lon": (F.col("l_partkey") % 36 * 10).cast("double"),
        "lev": (F.col("l_linenumber") * 100).cast("double"),
        "month": F.date_trunc("month", "l_shipdate"),
    }


def grid(spark: SparkSession, sf_dir: str, *dims: str) -> DataFrame:
    """(dims, v): mean quantity by the coordinate labels that keys give."""
    c = _coords()
    return table(spark, sf_dir, "lineitem").groupBy(*(c[d].alias(d) for d in dims)).agg(F.avg("l_quantity").alias("v"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, i, v): embeddings as samples by components."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
