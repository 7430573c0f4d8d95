"""Template matching: cosine similarity of a template with every place of the frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.layout import BLOCK, own_rows, with_halo


def template_1d(df: DataFrame, template, block: int = BLOCK) -> DataFrame:
    """ch, ti, score of each full lag: sum(v * T) over the root of both energies, 0 without energy."""
    t = np.asarray(template, float)
    m, energy = len(t), float(t @ t)
    w = Window.partitionBy("ch", "__block").orderBy("ti").rowsBetween(0, m - 1)
    span = with_halo(df, 0, m - 1, block=block).withColumn("__w", F.collect_list("v").over(w))
    taps = F.array(*[F.lit(float(x)) for x in t])
    dot = F.aggregate(F.zip_with("__w", taps, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    square = F.aggregate("__w", F.lit(0.0), lambda a, x: a + x * x)
    norm = F.sqrt(square * F.lit(energy))
    full = own_rows(span).filter(F.size("__w") == m)
    return full.select("ch", "ti", F.when(norm > 0, dot / norm).otherwise(0.0).alias("score"))


def template_2d(df: DataFrame, template) -> DataFrame:
    """ti, ch, score of each full placement of a (time, channel) patch; ti and ch are its first sample and channel.

    The template's cells are a small table: each sample meets every cell once, and sums go by placement with partial aggregation.
    """
    t = np.asarray(template, float)
    cells = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j"), F.lit(float(t[i, j])).alias("w")) for i in range(t.shape[0]) for j in range(t.shape[1])])
    met = df.select("ch", "ti", "v", F.inline(cells))
    sums = met.groupBy((F.col("ti") - F.col("i")).alias("ti"), (F.col("ch") - F.col("j")).alias("ch")).agg(
        F.sum(F.col("v") * F.col("w")).alias("dot"), F.sum(F.col("v") * F.col("v")).alias("square"), F.count("v").alias("n")
    )
    norm = F.sqrt(F.col("square") * F.lit(float((t * t).sum())))
    return sums.filter(F.col("n") == t.size).select("ti", "ch", F.when(norm > 0, F.col("dot") / norm).otherwise(0.0).alias("score"))


def match(df: DataFrame, template, axis: str = "time") -> DataFrame:
    """By the template's dimensions; along distance, channels and times change places."""
    t = np.asarray(template, float)
    if t.ndim == 2 and min(t.shape) > 1:
        return template_2d(df, t)
    if axis == "distance":
        return template_1d(df.select(F.col("ti").alias("ch"), F.col("ch").alias("ti"), "v"), t.ravel()).select(F.col("ti").alias("ch"), F.col("ch").alias("ti"), "score")
    return template_1d(df, t.ravel())
