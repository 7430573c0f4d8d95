"""Thresholds, events as islands of consecutive samples, and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.layout import BLOCK, with_stats

EVENT_SCHEMA = "id string, start_time timestamp, end_time timestamp, min_channel long, max_channel long, confidence double, event_type string, attrs map<string,string>"


def threshold_detect(df: DataFrame, threshold: float | None = None, sigma: float = 3.0) -> DataFrame:
    """Boolean v: |v| above the threshold, or above mean + sigma * deviation of the signed data of all channels."""
    if threshold is not None:
        return df.withColumn("v", F.abs("v") > F.lit(float(threshold)))
    out = with_stats(df, [], __m=F.avg("v"), __s=F.stddev_pop("v"))
    return out.withColumn("v", F.abs("v") > F.col("__m") + F.lit(float(sigma)) * F.col("__s")).drop("__m", "__s")


def islands(times: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ti (and further columns) with ``island``: the first ti of its run of consecutive ones.

    Runs are numbered within blocks of ti. Only runs that touch a block's edge are then joined over the edges, at most
    two of a block: no task sees all times or all runs.
    """
    cut = times.withColumn("__block", F.floor(F.col("ti") / block))
    run = F.col("ti") - F.row_number().over(Window.partitionBy("__block").orderBy("ti"))
    local = cut.withColumn("__run", run).withColumn("__first", F.min("ti").over(Window.partitionBy("__block", "__run")))
    runs = local.groupBy("__first").agg(F.max("ti").alias("last"))
    begins, ends = F.pmod("__first", F.lit(block)) == 0, F.pmod(F.col("last") + 1, F.lit(block)) == 0
    # a run begins unless the one before ends just ahead of it
    w = Window.partitionBy(F.lit(0)).orderBy("__first")
    new = F.col("__first") != F.coalesce(F.lag("last").over(w), F.lit(-2)) + 1
    starts = runs.filter(begins | ends).withColumn("__start", F.max(F.when(new, F.col("__first"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(starts.select("__first", "__start"), "__first", "left").withColumn("island", F.coalesce("__start", "__first"))
    return out.drop("__block", "__first", "__run", "__start")


def numbered(rows: DataFrame, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Rows with their number from 0 in the order of an integer column: within blocks of it, then by the blocks' counts."""
    cut = rows.withColumn("__block", F.floor(F.col(order) / block))
    ahead = Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block
    before = cut.groupBy("__block").agg(F.count("*").alias("n")).select("__block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1
    return cut.withColumn("__i", inner).join(before, "__block").withColumn(name, F.col("__before") + F.col("__i")).drop("__block", "__before", "__i")


def trigger_events(df: DataFrame, threshold: float, fs: float, base_time: str = "1970-01-01 00:00:00", trigger_off: float | None = None) -> DataFrame:
    """The catalogue of runs of times in which any channel is above the threshold.

    With ``trigger_off`` below ``threshold``, a run goes on while some channel stays above it and counts if it
    ever reaches the threshold (hysteresis).
    """
    low = threshold if trigger_off is None else min(threshold, trigger_off)
    over = df.filter(F.abs("v") > F.lit(float(low)))
    times = over.groupBy("ti").agg(F.min("ch").alias("lo"), F.max("ch").alias("hi"), F.max(F.abs("v")).alias("peak"))
    runs = islands(times).groupBy("island").agg(F.max("ti").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("peak").alias("peak"))
    base = F.to_timestamp(F.lit(base_time))
    at = lambda c: F.timestamp_micros(F.unix_micros(base) + F.round(F.col(c) / F.lit(float(fs)) * 1e6).cast("long"))
    return numbered(runs.filter(F.col("peak") > threshold), "island", "number").select(
        F.concat(F.lit("evt_"), F.unix_timestamp(base).cast("string"), F.lit("_"), F.col("number").cast("string")).alias("id"),
        at("island").alias("start_time"),
        at("last").alias("end_time"),
        F.col("lo").cast("long").alias("min_channel"),
        F.col("hi").cast("long").alias("max_channel"),
        F.lit(1.0).alias("confidence"),
        F.lit("trigger").alias("event_type"),
        F.create_map().cast("map<string,string>").alias("attrs"),
    )


def rms_events(df: DataFrame, fs: float, threshold_db: float = -30.0, min_duration_ms: float = 10.0, keep_open: bool = False, most: int | None = 20) -> DataFrame:
    """Runs of times whose level across channels, in dB below the highest, is above the threshold.

    As a rule a run that is still open at the end of the data is left out (``keep_open`` takes it in), and the first ``most`` are reported.
    """
    level = df.groupBy("ti").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    top = level.agg(F.max("rms").alias("top"), F.max("ti").alias("end"))
    db = level.crossJoin(F.broadcast(top)).withColumn("db", 20 * F.log10(F.col("rms") / F.col("top") + 1e-10))
    runs = islands(db.filter(F.col("db") > threshold_db)).groupBy("island").agg(F.max("ti").alias("last"), F.max("db").alias("peak_db"), F.max("end").alias("end"))
    length = (F.col("last") + 1 - F.col("island")) / F.lit(float(fs)) * 1000
    out = runs.filter((length >= min_duration_ms) & (F.lit(keep_open) | (F.col("last") < F.col("end"))))
    out = out.select((F.col("island") / F.lit(float(fs))).alias("start_s"), ((F.col("last") + 1) / F.lit(float(fs))).alias("end_s"), length.alias("duration_ms"), "peak_db").orderBy("start_s")
    return out.limit(most) if most else out


def overlapping(events: DataFrame, start, stop) -> DataFrame:
    """Catalogue rows that touch [start, stop); an event without an end lasts a second."""
    end = F.coalesce(F.col("end_time"), F.col("start_time") + F.expr("INTERVAL 1 SECOND"))
    return events.filter((F.col("start_time") < F.to_timestamp(F.lit(stop))) & (end > F.to_timestamp(F.lit(start))))


def quality_report(df: DataFrame, fs: float) -> DataFrame:
    """One row of quality measures: noisy and dead channels, mains hum, trend, clipping, level, floor and SNR."""
    from strataline.operators.spectral import fft_mag

    energy = df.groupBy("ch").agg(F.avg(F.col("v") * F.col("v")).alias("e"))
    median = energy.agg(F.median("e").alias("m"), F.count("*").alias("channels"))
    safe = F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(1e-10))
    noisy, dead = F.col("e") > 100 * safe, F.col("e") < 0.01 * safe
    judged = energy.crossJoin(F.broadcast(median)).agg(
        F.sort_array(F.collect_list(F.when(noisy | dead, F.col("ch")))).alias("bad"), F.count_if(dead).alias("dead_channels"), F.count_if(noisy).alias("noisy_channels"), F.max("channels").alias("channels")
    )
    middle = df.join(F.broadcast(df.select("ch").distinct().agg(F.floor(F.count("*") / 2).alias("ch"))), "ch", "left_semi")
    spec = fft_mag(middle, fs)
    near = lambda f: F.coalesce(F.max(F.when(F.abs(F.col("freq") - f) <= 1, F.col("mag"))), F.lit(0.0))
    hum = spec.agg(near(50.0).alias("p50"), near(60.0).alias("p60"), F.median("mag").alias("bg"), F.max("mag").alias("peak"))
    bg = F.when(F.col("bg") > 0, F.col("bg")).otherwise(F.lit(1e-10))
    whole = df.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max(F.abs("v")).alias("top"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    clipped = df.crossJoin(F.broadcast(whole.select("top"))).agg(F.avg((F.abs("v") >= 0.99 * F.col("top")).cast("double")).alias("clip"), F.max("top").alias("t"))
    one = judged.crossJoin(hum).crossJoin(whole).crossJoin(clipped)  # a row each
    return one.select(
        F.col("bad").alias("bad_channels"), "dead_channels", "noisy_channels",
        (F.col("p50") > 10 * bg).alias("has_50hz"), (F.col("p60") > 10 * bg).alias("has_60hz"), (F.abs("mean") > 0.1 * F.col("std")).alias("has_trend"),
        F.when(F.col("t") > 0, F.col("clip")).otherwise(0.0).alias("clipping_ratio"), F.col("rms").alias("rms_level"),
        (20 * F.log10(bg + 1e-10)).alias("noise_floor_db"), (20 * F.log10(F.col("peak") / bg)).alias("snr_db"),
    )
