"""Spectra by FFT kernels on whole traces, or on blocks of segments of any channel length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import dsp
from strataline.operators import filters, pointwise
from strataline.operators.filters import SAMPLES, map_traces
from strataline.operators.layout import to_traces

#: Samples of a channel that one task transforms by segments; longer channels are cut into blocks with overlap.
BLOCK = 1 << 18


def fft_mag(df: DataFrame, fs: float) -> DataFrame:
    """ch, k, freq, mag: magnitude of bins 0 to n // 2 of each channel."""
    return fft_traces(to_traces(df), fs)


def spectra(traces: DataFrame) -> DataFrame:
    """ch, n (samples) and mag, the magnitudes of bins 0 to n // 2, of a row per channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = lists.value_lengths().to_numpy()
            for n in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == n)
                for at in range(0, len(rows), max(1, SAMPLES // int(n))):
                    mine = rows[at : at + max(1, SAMPLES // int(n))]
                    x = (lists if len(mine) == len(lists) else lists.take(pa.array(mine))).flatten()
                    z = np.abs(np.fft.rfft(x.to_numpy(zero_copy_only=False).reshape(len(mine), n), axis=1)).astype(float, copy=False)
                    offsets = np.arange(len(mine) + 1, dtype=np.int32) * z.shape[1]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine)), pa.array(np.full(len(mine), n), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))], names=["ch", "n", "mag"])

    return traces.select(F.col("ch").cast("long"), "v").mapInArrow(run, "ch long, n long, mag array<double>")


def fft_traces(traces: DataFrame, fs: float) -> DataFrame:
    """As fft_mag, of a row per channel."""
    cells = spectra(traces).select("ch", "n", F.posexplode("mag").alias("k", "mag")).withColumn("k", F.col("k").cast("long"))
    return cells.select("ch", "k", (F.col("k") * F.lit(float(fs)) / F.col("n")).alias("freq"), "mag")


def hilbert(df: DataFrame) -> DataFrame:
    """ch, ti, re, im of the analytic signal."""
    return hilbert_traces(to_traces(df))


def hilbert_traces(traces: DataFrame) -> DataFrame:
    """As hilbert, of a row per channel."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = dsp.analytic(x)
        return z.real, z.imag

    made = map_traces(traces, kernel, "ch long, re array<double>, im array<double>")
    return made.select("ch", F.posexplode(F.arrays_zip("re", "im")).alias("ti", "z")).select("ch", F.col("ti").cast("long").alias("ti"), "z.re", "z.im")


def envelope(df: DataFrame) -> DataFrame:
    return pointwise.absolute(hilbert(df))


def _by_segments(df: DataFrame, n: int, hop: int, centred: bool, kernel: Callable[[np.ndarray], np.ndarray], total: bool = False) -> DataFrame:
    """A kernel on segments of ``n`` samples, ``hop`` apart, as (segments, n) with NaN where no sample is.

    Centred segments start n // 2 before s * hop and reach beyond the ends; others lie within the data. A channel
    is dealt in blocks of segments, so that no task depends on its length; each sample goes to the blocks it is
    part of, as a rule one. Gives ch, seg and the kernel's row of each segment with samples, or with ``total`` ch, n
    (segments) and the sum of these rows per block.
    """
    pad, per = n // 2 if centred else 0, max(1, BLOCK // hop)
    size = df.groupBy("ch").agg((F.max("ti") + 1).alias("len"))
    count = F.ceil(F.col("len") / hop) + 1 if centred else F.floor((F.col("len") - (n - hop)) / hop)
    at = F.col("ti") + pad
    first = F.greatest(F.ceil((at - (n - 1)) / hop), F.lit(0))
    last = F.least(F.floor(at / hop), count - 1)
    placed = df.join(size, "ch").filter(last >= first).select("ch", "ti", F.col("v").cast("double").alias("v"), count.cast("long").alias("count"), F.explode(F.sequence(F.floor(first / per), F.floor(last / per))).alias("block"))
    blocks = placed.groupBy("ch", "block").agg(F.max("count").alias("count"), F.collect_list(F.struct("ti", "v")).alias("s"))
    key = "n" if total else "seg"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ch, block, segments, s in zip(*(b.column(i) for i in range(4)), strict=True):
                begin = block.as_py() * per
                m = min(per, segments.as_py() - begin)
                x = np.full((m - 1) * hop + n, np.nan)
                j = s.values.field("ti").to_numpy() + pad - begin * hop
                x[j] = s.values.field("v").to_numpy(zero_copy_only=False)
                rows = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
                some = np.flatnonzero(~np.isnan(rows).all(1))
                if not len(some):
                    continue
                got = kernel(rows[some])
                ids = np.array([len(some)]) if total else begin + some
                got = got.sum(0, keepdims=True) if total else got
                offsets = np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([ch.as_py()] * len(got), pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(got).ravel()))], names=["ch", key, "row"])

    return blocks.select(F.col("ch").cast("long"), "block", "count", "s").mapInArrow(run, f"ch long, {key} long, row array<double>")


def _hann(n: int) -> np.ndarray:
    """The periodic window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _freq(fs: float, n: int):
    return (F.col("k") * F.lit(float(fs)) / n).alias("freq")


def stft_mag(df: DataFrame, fs: float, nperseg: int = 256, noverlap: int | None = None) -> DataFrame:
    """ch, k, freq, seg, t, mag: Hann, zeros beyond the ends, scaled by the window's sum, one-sided without doubling."""
    hop = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    hann = _hann(nperseg)
    rows = _by_segments(df, nperseg, hop, True, lambda x: np.abs(np.fft.rfft(np.nan_to_num(x) * hann, axis=1)) / (nperseg / 2))
    cells = rows.select("ch", "seg", F.posexplode("row").alias("k", "mag")).withColumn("k", F.col("k").cast("long"))
    return cells.select("ch", "k", _freq(fs, nperseg), "seg", (F.col("seg") * F.lit(hop / float(fs))).alias("t"), "mag")


def _power(fs: float, n: int, scaling: str) -> Callable[[np.ndarray], np.ndarray]:
    """Power of Hann segments, each without its mean; one-sided and doubled."""
    hann = _hann(n)
    norm = (n / 2) ** 2 if scaling == "spectrum" else float(fs) * 0.375 * n  # the sum squared, or the sum of squares
    twice = np.full(n // 2 + 1, 2.0)
    twice[0] = 1
    if n % 2 == 0:
        twice[-1] = 1
    return lambda x: np.abs(np.fft.rfft(np.nan_to_num(x - np.nanmean(x, 1, keepdims=True)) * hann, axis=1)) ** 2 / norm * twice


def spectrogram(df: DataFrame, fs: float, nperseg: int = 256, noverlap: int | None = None, scaling: str = "spectrum", db: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """ch, seg, t, k, freq, power of Hann segments within the data, each without its mean; one-sided and doubled.

    t is the segment's middle. With ``db`` the power is in decibels, with ``low`` and ``high`` limited to these.
    """
    hop = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    rows = _by_segments(df, nperseg, hop, False, _power(fs, nperseg, scaling))
    cells = rows.select("ch", "seg", F.posexplode("row").alias("k", "power")).withColumn("k", F.col("k").cast("long"))
    value = to_db(F.col("power")) if db else F.col("power")
    value = value if low is None else F.greatest(value, F.lit(float(low)))
    value = value if high is None else F.least(value, F.lit(float(high)))
    return cells.select("ch", "seg", ((F.col("seg") * hop + nperseg / 2) / F.lit(float(fs))).alias("t"), "k", _freq(fs, nperseg), value.alias("power"))


def spectrum(df: DataFrame, fs: float, nperseg: int = 1024, overlap: float = 0.5) -> DataFrame:
    """ch, k, freq, power: the mean over segments."""
    parts = _by_segments(df, nperseg, nperseg - int(nperseg * overlap), False, _power(fs, nperseg, "spectrum"), total=True)
    cells = parts.select("ch", "n", F.posexplode("row").alias("k", "power")).withColumn("k", F.col("k").cast("long"))
    return cells.groupBy("ch", "k").agg((F.sum("power") / F.sum("n")).alias("power")).select("ch", "k", _freq(fs, nperseg), "power")


def welch(df: DataFrame, fs: float, size: int) -> DataFrame:
    """ch, k, freq, mag: square root of the spectrum, with segments of min(2048, max(8, size // 4))."""
    return spectrum(df, fs, min(2048, max(8, size // 4))).select("ch", "k", "freq", F.sqrt("power").alias("mag"))


def to_db(value, factor: float = 10.0):
    return F.lit(factor) * F.log10(value + 1e-12)


def peaks(spec: DataFrame, value: str = "power", min_freq: float = 0.0, max_freq: float | None = None, n_peaks: int = 3, min_prominence: float | None = None) -> DataFrame:
    """The n highest local maxima of each channel's spectrum (ch, k, freq, value): rank, freq, value.

    A plateau counts once, at its middle; with ``min_prominence`` only peaks that rise so far count.
    """
    rows = spec.filter(F.col("freq") >= min_freq)
    rows = rows if max_freq is None else rows.filter(F.col("freq") <= max_freq)
    if min_prominence is not None:
        rows = _prominent(rows, value, min_prominence)
    else:
        w = Window.partitionBy("ch").orderBy("k")
        new = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")
        runs = rows.withColumn("run", F.sum(new).over(w)).groupBy("ch", "run").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.first(value).alias("top"))
        r = Window.partitionBy("ch").orderBy("run")
        top = runs.withColumn("l", F.lag("top").over(r)).withColumn("r", F.lead("top").over(r)).filter("top > l AND top > r")
        middle = top.select("ch", F.floor((F.col("a") + F.col("b")) / 2).alias("k"))
        rows = rows.join(middle, ["ch", "k"])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ch").orderBy(F.col(value).desc(), F.col("k").desc())))
    return ranked.filter(F.col("rank") <= n_peaks).select("ch", "rank", "freq", value)


def _prominent(rows: DataFrame, value: str, least: float) -> DataFrame:
    def kernel(pdf):
        pdf = pdf.sort_values("k")
        x = pdf[value].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        last = np.concatenate((edge[1:], [len(x)])) - 1
        inner = [(a + b) // 2 for i, (a, b) in enumerate(zip(edge, last)) if 0 < i < len(edge) - 1 and x[a] > x[edge[i - 1]] and x[a] > x[edge[i + 1]]]
        at = np.array(inner, int)
        return pdf.iloc[at[dsp.prominences(x, at) >= least]] if len(at) else pdf.iloc[:0]

    return rows.groupBy("ch").applyInPandas(kernel, rows.schema)


def dominant(spec: DataFrame, value: str = "power", n_peaks: int = 5, **options) -> DataFrame:
    """Per channel: the highest peak's frequency and value, and the frequencies and values of the first ``n_peaks``, highest first."""
    found = F.sort_array(F.collect_list(F.struct("rank", "freq", F.col(value).alias("value"))))
    return (
        peaks(spec, value, n_peaks=n_peaks, **options)
        .groupBy("ch")
        .agg(found.alias("p"))
        .select("ch", F.col("p")[0]["freq"].alias("freq"), F.col("p")[0]["value"].alias(value), F.col("p.freq").alias("freqs"), F.col("p.value").alias(f"{value}s"))
    )


def band_power(spec: DataFrame, low: float, high: float, value: str = "power", edge: int = 5) -> DataFrame:
    """Power of a band over the line between the means of its first and last bins: ch, band_power (trapezoid rule)."""
    rows = spec.filter((F.col("freq") >= low) & (F.col("freq") <= high))
    up, down = Window.partitionBy("ch").orderBy("k"), Window.partitionBy("ch").orderBy(F.col("k").desc())
    placed = rows.withColumn("i", F.row_number().over(up)).withColumn("j", F.row_number().over(down))
    ends = placed.groupBy("ch").agg(F.avg(F.when(F.col("i") <= edge, F.col(value))).alias("first"), F.avg(F.when(F.col("j") <= edge, F.col(value))).alias("last"), F.count("*").alias("n"))
    part = F.when(F.col("n") > 1, (F.col("i") - 1) / (F.col("n") - 1)).otherwise(0.0)
    net = placed.join(ends, "ch").withColumn("net", F.greatest(F.col(value) - (F.col("first") + (F.col("last") - F.col("first")) * part), F.lit(0.0)))
    strip = (F.lead("freq").over(up) - F.col("freq")) * (F.lead("net").over(up) + F.col("net")) / 2
    return net.withColumn("strip", strip).groupBy("ch").agg(F.coalesce(F.sum("strip"), F.lit(0.0)).alias("band_power"))


def frequency_response(df: DataFrame, fs: float, freqs: list[float]) -> DataFrame:
    """Per frequency: the channel of highest RMS in a band of 5 % either side, and that RMS."""
    out: DataFrame | None = None
    for f in freqs:
        level = filters.bandpass(df, fs, 0.95 * f, 1.05 * f).groupBy("ch").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
        best = level.agg(F.max_by("ch", F.struct("rms", -F.col("ch"))).alias("ch"), F.max("rms").alias("rms")).select(F.lit(float(f)).alias("freq"), "ch", "rms")
        out = best if out is None else out.unionByName(best)
    return out


def fk_transform(df: DataFrame, fs: float, dx: float = 1.0, n_time: int | None = None, n_chan: int | None = None) -> DataFrame:
    """fi, ki, freq, wavenumber, re, im of a dense frame whose channels count from 0: two one-dimensional transforms.

    First each channel's spectrum, then, dealt by frequency bin, each bin's spectrum over the
    channels. No task holds the whole frame. Bins are unshifted; freq and wavenumber are signed.
    """
    if n_time is None or n_chan is None:
        n_time, n_chan = df.agg(F.max("ti") + 1, F.max("ch") + 1).first()

    def over_time(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.fft.fft(x, axis=0)
        return z.real, z.imag

    made = map_traces(to_traces(df), over_time, "ch long, re array<double>, im array<double>")
    cells = made.select("ch", F.posexplode(F.arrays_zip("re", "im")).alias("fi", "z")).select("ch", "fi", "z.re", "z.im")
    return _across(cells, "fi", "ch", "ki", np.fft.fft).select(
        "fi", "ki", (_signed("fi", n_time) * F.lit(float(fs)) / n_time).alias("freq"), (_signed("ki", n_chan) / F.lit(float(dx)) / n_chan).alias("wavenumber"), "re", "im"
    )


def _signed(c: str, n: int):
    return F.when(F.col(c) < (n + 1) // 2, F.col(c)).otherwise(F.col(c) - n)


def _across(cells: DataFrame, key: str, order: str, name: str, transform) -> DataFrame:
    """A complex transform over ``order`` within each ``key``: key, name, re, im."""

    def kernel(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        z = transform(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        return pd.DataFrame({key: pdf[key].to_numpy(), name: np.arange(len(z), dtype=np.int32), "re": z.real, "im": z.imag})

    return cells.groupBy(key).applyInPandas(kernel, f"{key} int, {name} int, re double, im double")


def fk_filter(df: DataFrame, fs: float, v_min: float | None = None, v_max: float | None = None, dx: float = 1.0) -> DataFrame:
    """ch, ti, v with the cells of the F-K plane kept whose apparent speed lies between v_min and v_max."""
    spec = fk_transform(df, fs, dx)
    speed = F.when(F.col("wavenumber") == 0, F.when(F.col("freq") == 0, F.lit(None)).otherwise(F.lit(float("inf")))).otherwise(F.abs(F.try_divide("freq", "wavenumber")))
    keep = F.lit(True)
    if v_min is not None:
        keep = keep & F.coalesce(speed >= abs(v_min), F.lit(True))
    if v_max is not None:
        keep = keep & F.coalesce(speed <= abs(v_max), F.lit(True))
    masked = spec.select("fi", "ki", F.when(keep, F.col("re")).otherwise(0.0).alias("re"), F.when(keep, F.col("im")).otherwise(0.0).alias("im"))
    return fk_inverse(masked)


def fk_inverse(spec: DataFrame) -> DataFrame:
    """ch, ti, v: the real part of the inverse of fi, ki, re, im."""
    rows = _across(spec.select("fi", "ki", "re", "im"), "fi", "ki", "ch", np.fft.ifft)
    back = _across(rows, "ch", "fi", "ti", np.fft.ifft)
    return back.select(F.col("ch").cast("long").alias("ch"), F.col("ti").cast("long").alias("ti"), F.col("re").alias("v"))


def psd(df: DataFrame, fs: float, window: int, hop: int) -> DataFrame:
    """ch, k, freq, psd: mean power of symmetric Hann segments within the data, filled with zeros to twice their length."""
    hann = np.hanning(window)
    norm = 2 / (fs * (hann @ hann))

    def kernel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, n = 0.0, 0
        for at in range(0, len(x) - window + 1, hop):
            total = total + np.abs(np.fft.rfft(x[at : at + window] * hann[:, None], 2 * window, axis=0)) ** 2
            n += 1
        freq = np.broadcast_to(np.fft.rfftfreq(2 * window, 1 / fs)[:, None], (window + 1, x.shape[1]))
        return total / max(n, 1) * norm + np.zeros_like(freq), freq

    made = map_traces(to_traces(df), kernel, "ch long, psd array<double>, freq array<double>")
    return made.select("ch", F.posexplode(F.arrays_zip("freq", "psd")).alias("k", "z")).select("ch", F.col("k").cast("long").alias("k"), "z.freq", "z.psd")
