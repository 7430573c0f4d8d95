"""Synthetic frames as expressions: equal for every partitioning and run."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strataline.frame import SignalFrame


def noise(seed: int, *columns: str) -> Column:
    """Normal deviates as a function of the columns' values (Box-Muller on two hashes)."""
    one, two = (F.pmod(F.xxhash64(*columns, F.lit(seed + k)), F.lit(1 << 52)) / float(1 << 52) for k in (0, 1))
    return F.sqrt(-2 * F.log(1 - one)) * F.cos(F.lit(2 * math.pi) * two)


def frame(spark: SparkSession, n: int, channels: int, fs: float, value: Column, dx: float = 1.0) -> SignalFrame:
    rows = spark.range(n * channels).select((F.col("id") % channels).alias("ch"), F.floor(F.col("id") / channels).alias("ti"))
    return SignalFrame(rows.withColumn("t", F.col("ti") / F.lit(float(fs))).withColumn("v", value).select("ch", "ti", "v"), fs, dx)


def random(spark, n=10_000, channels=64, fs=1000.0, seed=0) -> SignalFrame:
    return frame(spark, n, channels, fs, noise(seed, "ch", "ti"))


def sine(spark, n=10_000, channels=64, fs=1000.0, freq=50.0, amplitude=1.0) -> SignalFrame:
    return frame(spark, n, channels, fs, F.lit(float(amplitude)) * F.sin(F.lit(2 * math.pi * freq) * F.col("t")))


def chirp(spark, n=10_000, channels=64, fs=1000.0, f0=1.0, f1=100.0) -> SignalFrame:
    end = n / fs
    phase = F.lit(2 * math.pi) * (F.lit(f0) * F.col("t") + F.lit((f1 - f0) / (2 * end)) * F.col("t") * F.col("t"))
    return frame(spark, n, channels, fs, F.cos(phase))


def impulse(spark, n=10_000, channels=64, fs=1000.0, at=None) -> SignalFrame:
    place = n // 2 if at is None else at
    return frame(spark, n, channels, fs, F.when(F.col("ti") == place, 1.0).otherwise(0.0))


def event(spark, n=10_000, channels=64, fs=1000.0, speed=1000.0, freq=30.0, dx=1.0, level=0.1, seed=0) -> SignalFrame:
    """A Ricker pulse that crosses the channels at ``speed``, over noise."""
    a = F.pow(F.lit(math.pi * freq) * (F.col("t") - F.lit(0.2) - F.col("ch") * F.lit(dx / speed)), F.lit(2.0))
    return frame(spark, n, channels, fs, (1 - 2 * a) * F.exp(-a) + F.lit(level) * noise(seed, "ch", "ti"), dx)


EXAMPLES = {"random_das": random, "sine_wave": sine, "chirp": chirp, "impulse": impulse, "event": event}


def example(spark: SparkSession, kind: str, **options) -> SignalFrame:
    if kind not in EXAMPLES:
        raise ValueError(f"unknown example {kind}")
    return EXAMPLES[kind](spark, **options)


def spool_rows(spark: SparkSession, files: int = 3, n: int = 1000, channels: int = 10, fs: float = 1000.0, gap_s: float = 0.0, start: str = "2024-01-01 00:00:00"):
    """An index of files that follow one another, as spool rows."""
    length = n / fs
    begin = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(start))) + F.round(F.col("id") * F.lit((length + gap_s) * 1e6)).cast("long"))
    end = F.timestamp_micros(F.unix_micros(begin) + F.lit(round(length * 1e6)))
    return spark.range(files).select(
        F.format_string("file_%04d", "id").alias("path"), begin.alias("start_time"), end.alias("end_time"), F.lit(n).cast("long").alias("n_samples"), F.lit(channels).alias("n_channels"),
        F.lit(float(fs)).alias("sampling_rate"), F.lit(1.0).alias("channel_spacing"), F.create_map(F.lit("project"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string"))).alias("attrs"),
    )
