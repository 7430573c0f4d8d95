"""Chains on the trace layout: all steps of a chain run in one pass over each group of channels, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from strataline.functions import dsp
from strataline.operators.filters import map_traces

Step = Callable[[np.ndarray], np.ndarray]


def detrend() -> Step:
    """Subtract each column's least-squares line (closed form on the centred time axis)."""

    def run(x: np.ndarray) -> np.ndarray:
        t = np.arange(len(x)) - (len(x) - 1) / 2
        slope = t @ x / max(t @ t, 1e-300)
        return x - x.mean(0) - np.multiply.outer(t, slope)

    return run


def demean() -> Step:
    return lambda x: x - x.mean(0)


def absolute() -> Step:
    return np.abs


def scale(factor: float) -> Step:
    return lambda x: x * factor


def normalize(method: str = "minmax") -> Step:
    def run(x: np.ndarray) -> np.ndarray:
        if method == "zscore":
            s = x.std(0)
            return (x - x.mean(0)) / np.where(s == 0, 1, s)
        lo, span = x.min(0), np.ptp(x, 0)
        return 2 * (x - lo) / np.where(span == 0, 1, span) - 1

    return run


def running_sum() -> Step:
    return lambda x: x.cumsum(0)


def envelope() -> Step:
    return lambda x: np.abs(dsp.analytic(x))


def zero_phase(sos: np.ndarray) -> Step:
    return lambda x: dsp.zero_phase(sos, x)


def spectrum_magnitude() -> Step:
    return lambda x: np.abs(np.fft.rfft(x, axis=0))


def chain(traces: DataFrame, *steps: Step) -> DataFrame:
    """Trace rows (ch, v) with all steps applied."""

    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return x

    return map_traces(traces, run)
