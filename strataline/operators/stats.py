"""Reductions of long frames along an axis: 0 gives a row per channel, 1 a row per time, None one row."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys(axis) -> list[str]:
    return {0: ["ch"], "time": ["ch"], None: []}.get(axis, ["ti"])




def measures() -> dict[str, Column]:
    square = F.col("v") * F.col("v")
    return {
        "mean": F.avg("v"), "std": F.stddev_pop("v"), "max": F.max("v"), "min": F.min("v"),
        "rms": F.sqrt(F.avg(square)), "var": F.var_pop("v"), "n": F.count("v"),
        "any": F.bool_or(F.col("v") != 0), "all": F.bool_and(F.col("v") != 0),
    }


def reduce(df: DataFrame, names: list[str], axis=0) -> DataFrame:
    """The named measures in one pass."""
    known = measures()
    aggs = [known[n].alias(n) for n in names]
    by = keys(axis)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


#: Bins of a pass, and values that are sorted on the driver at the end.
BINS, FEW = 4096, 10_000


def order_statistics(values: DataFrame, ranks: list[int], low: float, high: float) -> dict[int, float]:
    """The values of these ranks (from 0) of the column x, exactly, in passes of histograms.

    Each pass counts the values of a rank's bin in ``BINS`` finer ones; no task sorts or holds the values. What
    comes to the driver is a row per bin, and at the end at most ``FEW`` values.
    """
    out: dict[int, float] = {}
    spans = {r: (low, high, 0) for r in ranks}
    while spans:
        nxt = {}
        for span in set(spans.values()):
            a, b, below = span
            mine = sorted(r for r, s in spans.items() if s == span)
            inside = values.filter((F.col("x") >= a) & (F.col("x") <= b))
            place = F.least(F.floor((F.col("x") / 2 - a / 2) / (b / 2 - a / 2) * BINS), F.lit(BINS - 1)) if b > a else F.lit(0)
            bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("bin").collect()
            for row in bins:
                here = [r for r in mine if below <= r < below + row.n]
                if here and row.a == row.b:
                    out |= dict.fromkeys(here, row.a)
                elif here and row.n <= FEW:
                    got = np.sort(values.filter((F.col("x") >= row.a) & (F.col("x") <= row.b)).toArrow().column(0).to_numpy())
                    out |= {r: float(got[r - below]) for r in here}
                else:
                    nxt |= dict.fromkeys(here, (row.a, row.b, below))
                below += row.n
        spans = nxt
    return out


def _percentiles(values: DataFrame, at: list[float]) -> tuple[list[float | None], float | None]:
    """Percentiles of the column x with linear interpolation, and the least value; null and NaN take no part."""
    values = values.filter("x IS NOT NULL AND NOT isnan(x)")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(at), None
    places = [p * (n - 1) for p in at]
    known = order_statistics(values, sorted({r for x in places for r in (math.floor(x), math.ceil(x))}), low, high)
    return [known[math.floor(x)] + (x - math.floor(x)) * (known[math.ceil(x)] - known[math.floor(x)]) for x in places], low


def percentiles(df: DataFrame, at: list[float], value: Column | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, a column for each; runs some aggregations."""
    got, _ = _percentiles(df.select((F.col("v") if value is None else value).cast("double").alias("x")), at)
    names = [f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}" for p in at]
    return df.sparkSession.createDataFrame([tuple(got)], ", ".join(f"{n} double" for n in names))


def profile(df: DataFrame, stat: str = "rms", dx: float | None = None) -> DataFrame:
    """A statistic per channel with its place x, in channels or metres."""
    if stat not in ("rms", "mean", "std", "max", "min"):
        raise ValueError(f"unknown statistic {stat}")
    return reduce(df, [stat]).select("ch", (F.col("ch") * F.lit(1.0 if dx is None else float(dx))).alias("x"), F.col(stat).alias("value"))


def limits(df: DataFrame) -> DataFrame:
    """Colour limits: 5th and 95th percentile, made symmetric if any value is negative."""
    (lo, hi), least = _percentiles(df.select(F.col("v").cast("double").alias("x")), [0.05, 0.95])
    if least is not None and least < 0:
        hi = max(abs(lo), abs(hi))
        lo = -hi
    return df.sparkSession.createDataFrame([(lo, hi)], "lo double, hi double")
