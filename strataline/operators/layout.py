"""Long and trace layouts of a time x channel frame.

Long rows are (ch, ti, v) and may carry more columns; a trace row is
(ch, v) with a channel's samples in time order as an array. NaN means missing: it becomes NULL at every scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a channel that one window task holds; longer channels are cut into blocks with overlap.
BLOCK = 1 << 20


def clean(df: DataFrame, column: str = "v") -> DataFrame:
    return df.withColumn(column, F.when(~F.isnan(column), F.col(column)))


def to_traces(df: DataFrame) -> DataFrame:
    """One row per channel: ch and its values by ti; one shuffle that serves a whole chain of kernels."""
    rows = F.array_sort(F.collect_list(F.struct("ti", "v")))
    return df.groupBy("ch").agg(F.transform(rows, lambda s: s["v"]).alias("v"))


def to_long(traces: DataFrame) -> DataFrame:
    return traces.select("ch", F.posexplode("v").alias("ti", "v")).withColumn("ti", F.col("ti").cast("long"))


def with_halo(df: DataFrame, before: int, after: int, key: str = "ch", order: str = "ti", block: int = BLOCK) -> DataFrame:
    """Rows dealt to blocks of ``order``, with ``before`` and ``after`` neighbours repeated in the next blocks.

    Adds ``__block`` and ``__own`` (false for repeated rows). Windows then go by (key, __block), so
    that no task depends on how long a channel is.
    """
    own = F.floor(F.col(order) / block)
    first = F.floor((F.col(order) - F.lit(after)) / block)
    last = F.floor((F.col(order) + F.lit(before)) / block)
    return df.withColumn("__block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("__own", F.col("__block") == own)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__block", "__own")


def with_stats(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of its groups: partial aggregation and a join, so the samples are not sorted or gathered.

    The statistics are one row per group; Spark broadcasts them where their measured size allows.
    """
    aggs = [c.alias(n) for n, c in aggregates.items()]
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggs)))  # exactly one row
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, keys)
