"""Zero-phase IIR filters on long frames: one shuffle to traces, channels of equal length filtered together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import dsp
from strataline.operators import pointwise
from strataline.operators.layout import to_long, to_traces

TRACE = "ch long, v array<double>"
#: Samples that a kernel works on at once; more channels go in turns.
SAMPLES = 1 << 22


def _lists(x: np.ndarray) -> pa.ListArray:
    """The columns of (samples, channels) as a list each."""
    offsets = np.arange(x.shape[1] + 1, dtype=np.int64) * x.shape[0]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(x.T, dtype=float).ravel()))


def map_traces(traces: DataFrame, kernel: Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, ...]], schema: str = TRACE) -> DataFrame:
    """Apply a kernel on (samples, channels) to all traces, in groups of one length.

    Spark hands over at most ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB) of traces at a time, or one trace.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chans, lists = b.column(0).to_numpy(), b.column(1)
            sizes = lists.value_lengths().to_numpy()
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                width = max(1, SAMPLES // max(int(n), 1))
                for at in range(0, len(rows), width):
                    mine = rows[at : at + width]
                    x = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(mine), n).T
                    got = kernel(x)
                    cols = [_lists(y) for y in (got if isinstance(got, tuple) else (got,))]
                    yield pa.RecordBatch.from_arrays([pa.array(chans[mine]), *cols], names=["ch", *[f"c{i}" for i in range(len(cols))]])

    names, kinds = zip(*(f.split(" ", 1) for f in schema.split(", ")), strict=True)
    inner = ", ".join(f"{n} {k}" for n, k in zip(["ch", *(f"c{i}" for i in range(len(kinds) - 1))], kinds, strict=True))
    return traces.select(F.col("ch").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, inner).toDF(*names)


def sos_zero_phase(df: DataFrame, sos: np.ndarray) -> DataFrame:
    return to_long(map_traces(to_traces(df), lambda x: dsp.zero_phase(sos, x)))


def bandpass(df: DataFrame, fs: float, low: float, high: float, order: int = 4) -> DataFrame:
    return sos_zero_phase(df, dsp.butter_sos(order, (low, high), "bandpass", fs))


def bandstop(df: DataFrame, fs: float, low: float, high: float, order: int = 4) -> DataFrame:
    return sos_zero_phase(df, dsp.butter_sos(order, (low, high), "bandstop", fs))


def lowpass(df: DataFrame, fs: float, cutoff: float, order: int = 4) -> DataFrame:
    return sos_zero_phase(df, dsp.butter_sos(order, cutoff, "lowpass", fs))


def highpass(df: DataFrame, fs: float, cutoff: float, order: int = 4) -> DataFrame:
    return sos_zero_phase(df, dsp.butter_sos(order, cutoff, "highpass", fs))


def notch(df: DataFrame, fs: float, freq: float, q: float = 30) -> DataFrame:
    return sos_zero_phase(df, dsp.notch_sos(freq, q, fs))


def process_differential(df: DataFrame, fs: float, wn: float = 1.0, order: int = 4) -> DataFrame:
    """High-pass, then the channel's mean removed."""
    return pointwise.demean(highpass(df, fs, wn, order))


def integrate_data(df: DataFrame, fs: float, wn: float = 1.0, order: int = 4) -> DataFrame:
    """Plain running sum, high-pass, mean removed."""
    return pointwise.demean(highpass(pointwise.integrate(df, 1.0), fs, wn, order))


def causal(df: DataFrame, sos: np.ndarray) -> DataFrame:
    """One forward pass that starts from the sections' steady state: what a stream of the same samples gives."""
    return to_long(map_traces(to_traces(df), lambda x: dsp.sos_filter(sos, x, dsp.steady_state(sos)[:, :, None])[0]))
