"""Rolling operators on long frames; every window goes by blocks with overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.layout import BLOCK, own_rows, with_halo
from strataline.operators.pointwise import AXIS


def _frame(key: str, order: str, before: int, after: int):
    return Window.partitionBy(key, "__block").orderBy(order).rowsBetween(-before, after)


def _centred(k: int) -> tuple[int, int]:
    return k // 2, k - 1 - k // 2


def rms(df: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """Square root of the centred rolling mean of squares; NULL where the window is not full."""
    before, after = _centred(window)
    f = _frame("ch", "ti", before, after)
    value = F.when(F.count("v").over(f) == window, F.sqrt(F.avg(F.col("v") * F.col("v")).over(f)))
    return own_rows(with_halo(df, before, after, block=block).withColumn("v", value))


def spatial_smooth(df: DataFrame, kernel: int = 3, block: int = BLOCK) -> DataFrame:
    """Centred rolling mean over channels; NULL where the window is not full."""
    before, after = _centred(kernel)
    f = _frame("ti", "ch", before, after)
    value = F.when(F.count("v").over(f) == kernel, F.avg("v").over(f))
    return own_rows(with_halo(df, before, after, "ti", "ch", block).withColumn("v", value))


def median_filter(df: DataFrame, k: int = 5, axis: str = "time", block: int = BLOCK) -> DataFrame:
    """The sorted window's element k // 2; beyond the ends the signal is mirrored, edge samples repeated."""
    key, order = AXIS[axis]
    before, after = _centred(k)
    size = df.groupBy(key).agg((F.max(order) + 1).alias("__n"))
    sized = df.join(size, key).withColumn("__at", F.col(order).cast("long"))
    mirrored = F.array(F.col("__at"), -1 - F.col("__at"), 2 * F.col("__n") - 1 - F.col("__at"))
    near = F.filter(mirrored, lambda p: (p >= -before) & (p < F.col("__n") + after))
    placed = sized.withColumn("__real", F.col("__at")).withColumn("__at", F.explode(F.array_distinct(near)))
    shifted = placed.withColumn("__at", F.col("__at") + before)
    f = _frame(key, "__at", before, after)
    value = F.get(F.sort_array(F.collect_list("v").over(f)), F.lit(k // 2))
    out = own_rows(with_halo(shifted, before, after, key, "__at", block).withColumn("v", value))
    return out.filter(F.col("__at") == F.col("__real") + before).drop("__n", "__at", "__real")


def sta_lta(df: DataFrame, n_sta: int, n_lta: int, block: int = BLOCK) -> DataFrame:
    """Trailing mean of squares over n_sta samples divided by that over n_lta; 0 for the first n_lta - 1 samples."""
    if n_sta >= n_lta:
        raise ValueError("n_sta must be below n_lta")
    square = F.col("v") * F.col("v")
    short, long = (F.avg(square).over(_frame("ch", "ti", n - 1, 0)) for n in (n_sta, n_lta))
    ratio = short / F.when(long == 0, F.lit(1e-10)).otherwise(long)
    value = F.when(F.col("ti") < n_lta - 1, F.lit(0.0)).otherwise(ratio)
    return own_rows(with_halo(df, n_lta - 1, 0, block=block).withColumn("v", value))
