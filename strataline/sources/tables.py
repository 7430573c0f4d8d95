"""Signals made from the test tables, and a stand-in for a file index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged channels: a user's event values in order of time (renamed before the window, so that filters on ch reach the scan)."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ch"), "ts", "event_id", F.col("value").alias("v"))
    at = F.row_number().over(Window.partitionBy("ch").orderBy("ts", "event_id")) - 1
    return rows.select("ch", at.cast("long").alias("ti"), "v")


def em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense frame: a vector is a channel, its components the samples."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ch"), F.posexplode("embedding").alias("ti", "v"))
    return rows.select("ch", F.col("ti").cast("long").alias("ti"), F.col("v").cast("double").alias("v"))


def eg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular time axis: the hourly sums of event values by type, from the first event's hour to the last one's, zero where none.

    Types are channels in the order of their names; the axis and the types come from the events.
    """
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000))
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), hour.alias("hour")).agg(F.sum("value").alias("s"))
    # one row: the axis, and the few types
    axis = sums.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    hours = axis.filter("lo IS NOT NULL").select("lo", "kinds", F.explode(F.sequence("lo", "hi")).alias("hour"))
    grid = hours.select("hour", (F.col("hour") - F.col("lo")).alias("ti"), F.posexplode("kinds").alias("ch", "kind"))
    return grid.join(sums, ["kind", "hour"], "left").select(F.col("ch").cast("long").alias("ch"), "ti", F.coalesce("s", F.lit(0.0)).alias("v"))


def ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: path, start and end (a day later), with attributes."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("start_time"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("end_time"),
        (F.col("o_orderkey") % 7 + 1).alias("n_samples"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("attrs"),
    )
