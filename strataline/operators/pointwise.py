"""Selection, scaling, trend removal and cumulative operators on long frames (ch, ti, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.layout import BLOCK, own_rows, with_halo, with_stats

V = F.col
AXIS = {"time": ("ch", "ti"), "distance": ("ti", "ch"), 0: ("ch", "ti"), 1: ("ti", "ch")}


def _bounds(s: slice, size: int) -> tuple[int, int, int]:
    start, stop, step = s.indices(size)
    if step < 1:
        raise ValueError("steps must be positive")
    return start, stop, step


def select(df: DataFrame, start: int, stop: int, step: int = 1, column: str = "ti", renumber: bool = True) -> DataFrame:
    """Rows start, start + step, ... below stop by position; positions count anew from 0, other labels stay."""
    c = F.col(column)
    out = df.filter((c >= start) & (c < stop) & (F.pmod(c - start, F.lit(step)) == 0))
    return out.withColumn(column, F.floor((c - start) / step).cast(df.schema[column].dataType)) if renumber else out


def decimate(df: DataFrame, size: int, most: int) -> DataFrame:
    """Every ceil(size / most)-th sample."""
    return select(df, 0, size, max(1, -(-size // most)))


def scale(df: DataFrame, factor: float = 1.0) -> DataFrame:
    return df.withColumn("v", F.col("v") * F.lit(float(factor)))


def absolute(df: DataFrame) -> DataFrame:
    """|v|, or the modulus of a frame with re and im."""
    if "im" in df.columns:
        return df.withColumn("v", F.hypot("re", "im")).drop("re", "im")
    return df.withColumn("v", F.abs("v"))


def select_channels(df: DataFrame, metadata: DataFrame, condition) -> DataFrame:
    """Samples of the channels whose metadata row (channel_index, ...) meets the condition."""
    return df.join(metadata.filter(condition).select(F.col("channel_index").alias("ch")), "ch", "left_semi")


def detrend(df: DataFrame, axis: str = "time") -> DataFrame:
    """Subtract the least-squares line along the axis."""
    key, order = AXIS[axis]
    fitted = with_stats(df, [key], __k=F.regr_slope("v", order), __b=F.regr_intercept("v", order))
    line = F.coalesce(F.col("__k"), F.lit(0.0)) * F.col(order) + F.coalesce("__b", "v")
    return fitted.withColumn("v", F.col("v") - line).drop("__k", "__b")


def demean(df: DataFrame, axis: str = "time") -> DataFrame:
    key, _ = AXIS[axis]
    return with_stats(df, [key], __m=F.avg("v")).withColumn("v", F.col("v") - F.col("__m")).drop("__m")


def normalize(df: DataFrame, method: str = "minmax") -> DataFrame:
    """Per channel: zscore by population deviation, anything else to [-1, 1]; a constant channel is divided by 1."""
    one = lambda c: F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.col(c))
    if method == "zscore":
        out = with_stats(df, ["ch"], __m=F.avg("v"), __s=F.stddev_pop("v"))
        return out.withColumn("v", (F.col("v") - F.col("__m")) / one("__s")).drop("__m", "__s")
    out = with_stats(df, ["ch"], __m=F.min("v"), __s=F.max("v") - F.min("v"))
    return out.withColumn("v", 2 * (F.col("v") - F.col("__m")) / one("__s") - 1).drop("__m", "__s")


def integrate(df: DataFrame, fs: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Running sum over time / fs: sums within blocks, then the sums of the blocks before."""
    cut = df.withColumn("__block", F.floor(F.col("ti") / block))
    totals = cut.groupBy("ch", "__block").agg(F.sum("v").alias("__sum"))
    ahead = Window.partitionBy("ch").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("ch", "__block", F.coalesce(F.sum("__sum").over(ahead), F.lit(0.0)).alias("__before"))
    inner = Window.partitionBy("ch", "__block").orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(before, ["ch", "__block"]).withColumn("v", (F.col("__before") + F.sum("v").over(inner)) / F.lit(float(fs)))
    return out.drop("__block", "__before")


def differentiate(df: DataFrame, fs: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Difference to the sample before, times fs; the first sample takes the second one's."""
    w = Window.partitionBy("ch", "__block").orderBy("ti")
    step = F.coalesce(F.col("v") - F.lag("v").over(w), F.lead("v").over(w) - F.col("v"))
    return own_rows(with_halo(df, 1, 1, block=block).withColumn("v", step * F.lit(float(fs))))
