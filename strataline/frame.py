"""An immutable, lazy time x channel frame over a Spark DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import dsp, units
from strataline.operators import chirp, detect, match, pointwise, rolling, spectral, stats, traces
from strataline.operators.layout import clean, to_long, to_traces
from strataline.sources import parts

#: Cells up to which arrays go between driver and tasks directly.
IN_MEMORY = 1 << 20


class SignalFrame:
    """Rows (ch, ti, v) with the sampling rate fs, the channel spacing dx and metadata beside them.

    Every method gives a new frame or a small DataFrame; nothing runs before a sink (collect, count, write).
    Steps along time that work channel by channel (detrend, demean, scale, abs, normalize, filters) are held
    back: ``df`` runs a chain with a filter in it in one pass over whole traces, after one shuffle, and any other chain
    on the rows. A frame that was made from traces (``from_traces``) needs no shuffle at all.
    """

    def __init__(self, df: DataFrame | None, fs: float = 1.0, dx: float = 1.0, meta: dict | None = None, *, steps: tuple = (), whole: DataFrame | None = None):
        self._rows, self._steps, self._whole = df, steps, whole
        self.fs, self.dx, self.meta = fs, dx, {} if meta is None else meta

    @classmethod
    def from_traces(cls, rows: DataFrame, fs: float, dx: float = 1.0, **meta) -> SignalFrame:
        """A frame from a row per channel: ch and v, its samples in order of time."""
        return cls(None, float(fs), float(dx), meta, whole=rows)

    @cached_property
    def df(self) -> DataFrame:
        """The rows (ch, ti, v)."""
        if self._whole is not None or any(on_rows is None for on_rows, _ in self._steps):
            return to_long(self.traces)
        out = self._rows
        for on_rows, _ in self._steps:
            out = on_rows(out)
        return out

    @cached_property
    def traces(self) -> DataFrame:
        """A row per channel: ch and v, its samples in order of time."""
        whole = to_traces(self._rows) if self._whole is None else self._whole
        return traces.chain(whole, *(on_trace for _, on_trace in self._steps)) if self._steps else whole

    def _step(self, on_trace: traces.Step, on_rows: Callable[[DataFrame], DataFrame] | None = None) -> SignalFrame:
        """This frame with a step more: on a trace (samples, channels), and on rows unless it needs whole channels."""
        return SignalFrame(self._rows, self.fs, self.dx, self.meta, steps=(*self._steps, (on_rows, on_trace)), whole=self._whole)

    # --- construction and sinks

    @classmethod
    def from_array(cls, spark: SparkSession, data, fs: float, dx: float = 1.0, **meta) -> SignalFrame:
        """A frame from (time, channel) values; one dimension is one channel. NaN becomes NULL."""
        x = np.asarray(data, float)
        x = x[:, None] if x.ndim == 1 else x
        n, c = x.shape
        if x.size > IN_MEMORY:
            return cls(parts.from_array(spark, x), float(fs), float(dx), meta)
        rows = pa.table({"ch": np.tile(np.arange(c), n), "ti": np.repeat(np.arange(n), c), "v": x.ravel()})
        return cls(clean(spark.createDataFrame(rows)), float(fs), float(dx), meta)

    def _with(self, df: DataFrame) -> SignalFrame:
        return SignalFrame(df, self.fs, self.dx, self.meta)

    @property
    def shape(self) -> tuple[int, int]:
        """Samples and channels (runs one aggregation)."""
        n, c = self.df.agg(F.max("ti") + 1, F.count_distinct("ch")).first()
        return n or 0, c

    @property
    def inventory(self):
        return self.meta.get("inventory")

    def coordinates(self) -> DataFrame:
        """The rows with time t in seconds and place x in units of dx."""
        return self.df.select("ch", "ti", (F.col("ti") / F.lit(self.fs)).alias("t"), (F.col("ch") * F.lit(self.dx)).alias("x"), "v")

    def collect(self) -> np.ndarray:
        """(time, channel) values on the driver; missing ones are NaN. Large arrays, 8 bytes a cell, come through the shared folder."""
        rows = self.df.select("ti", "ch", "v")
        if rows.count() > IN_MEMORY and dict(rows.dtypes)["v"] != "boolean":
            return parts.to_array(rows)
        got = rows.orderBy("ti", "ch").toArrow()
        ti, ch = (np.unique(got.column(c).to_numpy(), return_inverse=True) for c in ("ti", "ch"))
        v = got.column("v").to_numpy(zero_copy_only=False)
        out = np.full((len(ti[0]), len(ch[0])), False if v.dtype == bool else np.nan)
        out[ti[1], ch[1]] = v
        return out

    def flatten(self) -> np.ndarray:
        return self.collect().ravel()

    def write(self, path: str, channels_per_part: int = 64) -> None:
        """Parquet, zstd, partitioned by blocks of channels so that reading some of them prunes files."""
        blocks = self.df.withColumn("block", F.floor(F.col("ch") / channels_per_part).cast("int"))
        blocks.repartition("block").sortWithinPartitions("ch", "ti").write.option("compression", "zstd").partitionBy("block").parquet(path)

    # --- selection and point operators

    def slice(self, t: slice = slice(None), x: slice = slice(None)) -> SignalFrame:
        """Positional selection along time and channels; sizes are only looked up for open or negative ends."""
        df = self.df
        for column, s, size in (("ti", t, 0), ("ch", x, 1)):
            if s == slice(None):
                continue
            known = s.start is not None and s.stop is not None and s.start >= 0 and s.stop >= 0
            a, b, step = s.indices(s.stop if known else self.shape[size])
            if step < 1:
                raise ValueError("steps must be positive")
            df = pointwise.select(df, a, b, step, column)
        return self._with(df)

    def seconds(self, start: float = 0.0, stop: float | None = None, channels: list[int] | None = None) -> SignalFrame:
        """A range of seconds, and of channels from the least to the greatest one named."""
        t = slice(int(start * self.fs), None if stop is None else int(stop * self.fs))
        return self.slice(t, slice(min(channels), max(channels) + 1) if channels else slice(None))

    def astype(self, kind: str) -> SignalFrame:
        return self._with(self.df.withColumn("v", F.col("v").cast(kind)))

    def scale(self, factor: float = 1.0) -> SignalFrame:
        return self._step(traces.scale(factor), lambda df: pointwise.scale(df, factor))

    def abs(self) -> SignalFrame:
        return self._step(traces.absolute(), pointwise.absolute)

    def detrend(self, axis: str = "time") -> SignalFrame:
        return self._step(traces.detrend(), pointwise.detrend) if axis == "time" else self._with(pointwise.detrend(self.df, axis))

    def demean(self, axis: str = "time") -> SignalFrame:
        return self._step(traces.demean(), pointwise.demean) if axis == "time" else self._with(pointwise.demean(self.df, axis))

    def normalize(self, method: str = "minmax") -> SignalFrame:
        return self._step(traces.normalize(method), lambda df: pointwise.normalize(df, method))

    def integrate(self) -> SignalFrame:
        return self._with(pointwise.integrate(self.df, self.fs))

    def differentiate(self) -> SignalFrame:
        return self._with(pointwise.differentiate(self.df, self.fs))

    # --- rolling

    def median_filter(self, k: int = 5, axis: str = "time") -> SignalFrame:
        return self._with(rolling.median_filter(self.df, k, axis))

    def spatial_smooth(self, kernel: int = 3) -> SignalFrame:
        return self._with(rolling.spatial_smooth(self.df, kernel))

    def sta_lta(self, n_sta: int, n_lta: int) -> SignalFrame:
        return self._with(rolling.sta_lta(self.df, n_sta, n_lta))

    def template_match(self, template, axis: str = "time") -> SignalFrame:
        t = template.collect() if isinstance(template, SignalFrame) else template
        return self._with(match.match(self.df, t, axis).withColumnRenamed("score", "v"))

    # --- filters

    def _filter(self, sos: np.ndarray) -> SignalFrame:
        return self._step(traces.zero_phase(sos))

    def bandpass(self, low: float, high: float, order: int = 4) -> SignalFrame:
        return self._filter(dsp.butter_sos(order, (low, high), "bandpass", self.fs))

    def bandstop(self, low: float, high: float, order: int = 4) -> SignalFrame:
        return self._filter(dsp.butter_sos(order, (low, high), "bandstop", self.fs))

    def lowpass(self, cutoff: float, order: int = 4) -> SignalFrame:
        return self._filter(dsp.butter_sos(order, cutoff, "lowpass", self.fs))

    def highpass(self, cutoff: float, order: int = 4) -> SignalFrame:
        return self._filter(dsp.butter_sos(order, cutoff, "highpass", self.fs))

    def notch(self, freq: float, q: float = 30) -> SignalFrame:
        return self._filter(dsp.notch_sos(freq, q, self.fs))

    def process_differential(self, wn: float = 1.0) -> SignalFrame:
        return self.highpass(wn).demean()

    def integrate_data(self, wn: float = 1.0) -> SignalFrame:
        return self._step(traces.running_sum(), lambda df: pointwise.integrate(df, 1.0)).highpass(wn).demean()

    # --- spectra: DataFrames with ch, k, freq and a value

    def fft(self) -> DataFrame:
        return spectral.fft_traces(self.traces, self.fs)

    def hilbert(self) -> SignalFrame:
        return self._with(spectral.hilbert_traces(self.traces))

    def envelope(self) -> SignalFrame:
        return self._step(traces.envelope())

    def stft(self, nperseg: int = 256, noverlap: int | None = None, window: str = "hann") -> DataFrame:
        if window != "hann":
            raise ValueError("only the hann window is offered")
        return spectral.stft_mag(self.df, self.fs, nperseg, noverlap)

    def spectrum(self, channel: int | None = None, window: int = 1024, overlap: float = 0.5) -> DataFrame:
        df = self.df if channel is None else self.df.filter(F.col("ch") == channel)
        if channel is not None and df.isEmpty():
            raise IndexError(f"no channel {channel}")
        return spectral.spectrum(df, self.fs, window, overlap)

    def welch(self) -> DataFrame:
        return spectral.welch(self.df, self.fs, self.shape[0])

    def chirp_power(self, f0: float = 1000.0, f1: float = 2000.0, length: float = 3.0, **options) -> DataFrame:
        return chirp.chirp_power(self.traces, self.fs, f0, f1, length, **options)

    def dominant_frequencies(self, n_peaks: int = 5, window: int = 1024, **options) -> DataFrame:
        """Per channel its highest spectral peak and the first ``n_peaks``."""
        return spectral.dominant(self.spectrum(window=window), n_peaks=n_peaks, **options)

    def frequency_response(self, freqs: list[float]) -> DataFrame:
        return spectral.frequency_response(self.df, self.fs, freqs)

    def fk(self, dx: float | None = None) -> DataFrame:
        return spectral.fk_transform(self.df, self.fs, self.dx if dx is None else dx)

    def fk_filter(self, v_min: float | None = None, v_max: float | None = None, dx: float | None = None) -> SignalFrame:
        return self._with(spectral.fk_filter(self.df, self.fs, v_min, v_max, self.dx if dx is None else dx))

    # --- reductions: by axis 0 a row per channel, by 1 a row per time, by None one row

    def _reduce(self, name: str, axis) -> DataFrame:
        return stats.reduce(self.df, [name], axis)

    def mean(self, axis=0) -> DataFrame:
        return self._reduce("mean", axis)

    def std(self, axis=0) -> DataFrame:
        return self._reduce("std", axis)

    def max(self, axis=0) -> DataFrame:
        return self._reduce("max", axis)

    def min(self, axis=0) -> DataFrame:
        return self._reduce("min", axis)

    def any(self, axis=None) -> DataFrame:
        return stats.reduce(self.df.withColumn("v", F.col("v").cast("double")), ["any"], axis)

    def all(self, axis=None) -> DataFrame:
        return stats.reduce(self.df.withColumn("v", F.col("v").cast("double")), ["all"], axis)

    def rms(self, window: int | None = None):
        return self._reduce("rms", 0) if window is None else self._with(rolling.rms(self.df, window))

    def stats(self, per_channel: bool = False) -> DataFrame:
        return stats.reduce(self.df, ["mean", "std", "min", "max"], 0) if per_channel else stats.reduce(self.df, ["mean", "std", "min", "max", "rms"], None)

    # --- detection

    def threshold_detect(self, threshold: float | None = None, sigma: float = 3.0) -> SignalFrame:
        return self._with(detect.threshold_detect(self.df, threshold, sigma))

    def trigger_detection(self, threshold: float, trigger_off: float | None = None) -> DataFrame:
        start = (self.inventory or {}).get("acquisition", {}).get("start_time") or "1970-01-01 00:00:00"
        return detect.trigger_events(self.df, threshold, self.fs, start, trigger_off)

    def detect_events(self, threshold_db: float = -30.0, min_duration_ms: float = 10.0) -> DataFrame:
        return detect.rms_events(self.df, self.fs, threshold_db, min_duration_ms)

    def quality(self) -> DataFrame:
        return detect.quality_report(self.df, self.fs)

    # --- data behind plots

    def series(self, channels: list[int] | None = None, most: int = 5000) -> DataFrame:
        """The given or first five channels, decimated to ``most`` samples, with time."""
        df = self.df.filter(F.col("ch").isin(channels)) if channels else self.df.filter("ch < 5")
        return self._with(pointwise.decimate(df, self.shape[0], most)).coordinates()

    def heatmap(self, most: int = 2000) -> tuple[DataFrame, DataFrame]:
        """Decimated rows, and the 98th percentile of |v| as colour limit."""
        small = pointwise.decimate(self.df, self.shape[0], most)
        return small, stats.percentiles(small, [0.98], F.abs("v"))

    def spectrum_curve(self, window: int = 1024, most: int = 10_000) -> DataFrame:
        """ch, freq and db of the spectrum, thinned to at most ``most`` points a channel."""
        step = max(1, -(-(window // 2 + 1) // most))
        return self.spectrum(window=window).filter(F.pmod("k", F.lit(step)) == 0).select("ch", "freq", spectral.to_db(F.col("power")).alias("db"))

    def spectrogram_image(self, channel: int, window: int = 1024, overlap: float = 0.5) -> tuple[DataFrame, DataFrame]:
        """t, freq and db of one channel's magnitude spectrogram, and its colour limits: two deviations either side of the mean."""
        rows = spectral.spectrogram(self.df.filter(F.col("ch") == channel), self.fs, window, int(window * overlap), "density")
        image = rows.select("t", "freq", spectral.to_db(F.sqrt("power") / F.sqrt(F.when((F.col("k") == 0) | (F.col("k") * 2 == window), 1.0).otherwise(2.0))).alias("db"))
        return image, image.agg((F.avg("db") - 2 * F.stddev_pop("db")).alias("lo"), (F.avg("db") + 2 * F.stddev_pop("db")).alias("hi"))

    def profile(self, stat: str = "rms", metres: bool = False) -> DataFrame:
        return stats.profile(self.df, stat, self.dx if metres else None)

    def limits(self) -> DataFrame:
        return stats.limits(self.df)

    def fk_image(self, most_time: int = 2000, most_chan: int = 2000) -> DataFrame:
        """The decimated F-K plane in dB below its maximum."""
        n, c = self.shape
        step, skip = max(1, -(-n // most_time)), max(1, -(-c // most_chan))
        small = pointwise.select(pointwise.select(self.df, 0, n, step), 0, c, skip, "ch")
        plane = spectral.fk_transform(small, self.fs / step, self.dx * skip)
        db = plane.withColumn("db", spectral.to_db(F.hypot("re", "im"), 20.0))
        return db.crossJoin(F.broadcast(db.agg(F.max("db").alias("top")))).select("freq", "wavenumber", (F.col("db") - F.col("top")).alias("db"))

    # --- units

    @property
    def unit(self) -> str | None:
        return ((self.inventory or {}).get("acquisition", {}) or {}).get("data_unit") or self.meta.get("units")

    def _in_unit(self, df: DataFrame, name: str) -> SignalFrame:
        meta = dict(self.meta, units=name)
        if self.inventory:
            meta["inventory"] = dict(self.inventory, acquisition=dict(self.inventory.get("acquisition") or {}, data_unit=name))
        return SignalFrame(df, self.fs, self.dx, meta)

    def to_standard_units(self) -> SignalFrame:
        """Optical phase as strain (rad) or strain rate (rad/s); other units stay."""
        target = units.PHASE_UNITS.get(self.unit or "")
        if target is None:
            return self
        acquisition = (self.inventory or {}).get("acquisition") or {}
        gauge = acquisition.get("gauge_length") or self.meta.get("gauge_length") or 10.0
        wavelength = ((self.inventory or {}).get("interrogator") or {}).get("wavelength") or self.meta.get("wavelength") or 1550.0
        return self._in_unit(pointwise.scale(self.df, units.phase_scale(gauge, wavelength)), target)

    def convert_units(self, target: str) -> SignalFrame:
        if self.unit is None:
            raise ValueError("the frame has no unit")
        return self._in_unit(pointwise.scale(self.df, units.factor(self.unit, target)), target)

    # --- user functions and models

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> SignalFrame:
        return self._with(f(self.df))

    def predict(self, model: Callable[[np.ndarray], np.ndarray] | str, before: Callable | None = None, after: Callable | None = None) -> DataFrame:
        """ch and the model's output for each channel's trace; a model is a function on (channels, samples) or the path of an ONNX file."""
        from strataline.plans.models import predict

        return predict(self.df, model, before, after)

    # --- other packages, where they are installed; small frames, on the driver

    def to_obspy(self):
        """An ObsPy stream with a trace per channel."""
        import obspy

        header = {"sampling_rate": self.fs, "network": "DA", "station": "S"}
        return obspy.Stream([obspy.Trace(data=x, header=header | {"channel": str(c)}) for c, x in enumerate(np.ascontiguousarray(self.collect().T))])

    @classmethod
    def from_obspy(cls, spark: SparkSession, stream) -> SignalFrame:
        """The traces of an ObsPy stream as channels; all need one rate, shorter ones are filled with missing values."""
        rates = {float(t.stats.sampling_rate) for t in stream}
        if len(rates) != 1:
            raise ValueError("the stream has no traces, or traces of several rates")
        x = np.full((max(len(t.data) for t in stream), len(stream)), np.nan)
        for c, t in enumerate(stream):
            x[: len(t.data), c] = t.data
        return cls.from_array(spark, x, rates.pop())

    def to_dascore(self):
        """A DASCore patch of (time, distance)."""
        import dascore

        x = self.collect()
        start = np.datetime64(((self.inventory or {}).get("acquisition") or {}).get("start_time") or "1970-01-01T00:00:00", "ns")
        time = start + np.round(np.arange(len(x)) * (1e9 / self.fs)).astype("timedelta64[ns]")
        return dascore.Patch(data=x, coords={"time": time, "distance": np.arange(x.shape[1]) * self.dx}, dims=("time", "distance"), attrs={"data_units": self.unit})
