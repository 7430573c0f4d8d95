"""Power of a linear chirp of known slope in noisy channels, by its ridge in the time-frequency plane and what stands along it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import dsp
from strataline.operators.filters import map_traces


class Plane:
    """Short-time spectra of one signal with overlap-add as their inverse; frame m is centred on sample m * hop."""

    def __init__(self, x: np.ndarray, fs: float, n: int, hop: int):
        self.size, self.n, self.hop = len(x), n, hop
        self.bins = 1 << (n - 1).bit_length()
        self.window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        padded = np.concatenate((np.zeros(n // 2), x, np.zeros(n)))
        frames = np.lib.stride_tricks.sliding_window_view(padded, n)[::hop][: len(x) // hop + 1]
        self.z = np.fft.rfft(frames * self.window, self.bins, axis=1)
        self.time, self.freq = np.arange(len(frames)) * hop / fs, np.fft.rfftfreq(self.bins, 1 / fs)

    def signal(self, z: np.ndarray) -> np.ndarray:
        """The signal whose spectra come nearest to ``z``."""
        frames = np.fft.irfft(z, self.bins, axis=1)[:, : self.n] * self.window
        at = np.arange(len(z))[:, None] * self.hop + np.arange(self.n)
        total, weight = (np.bincount(at.ravel(), v.ravel(), at[-1, -1] + 1) for v in (frames, np.broadcast_to(self.window**2, frames.shape)))
        out = total / np.maximum(weight, 1e-12)
        return out[self.n // 2 : self.n // 2 + self.size]


def _centre(offsets: np.ndarray, strong: np.ndarray, spread: float, rounds: int) -> float:
    """The offsets' median: first of the strong ones, then of those within so many deviations of it."""
    centre = float(np.median(offsets[strong] if strong.sum() >= 5 else offsets))
    for _ in range(rounds):
        away = offsets - centre
        deviation = 1.4826 * np.median(np.abs(away - np.median(away))) + 1e-12
        near = offsets[np.abs(away) <= spread * deviation]
        if len(near) < 5 or (new := float(np.median(near))) == centre:
            break
        centre = new
    return centre


def locate(x: np.ndarray, fs: float, f0: float, f1: float, length: float, gamma: float = 8.0, tolerance: float = 80.0, width: float = 120.0, margin: float = 0.1) -> tuple[float, float, float]:
    """Onset (s; NaN if there is none), mean power where the chirp is on, and how long that is (s)."""
    slope, (low, high) = (f1 - f0) / length, sorted((f0, f1))
    n = max(256, round(0.04 * fs))
    if slope == 0 or len(x) < 2 * n:
        return np.nan, 0.0, 0.0
    plane = Plane(dsp.zero_phase(dsp.butter_sos(4, (max(1.0, low), min(high, 0.4995 * fs)), "bandpass", fs), (x - x.mean())[:, None])[:, 0], fs, n, n // 4)
    band = np.flatnonzero((plane.freq >= low) & (plane.freq <= high))
    power = np.abs(plane.z[:, band]) ** 2
    if len(band) < 3:
        return np.nan, 0.0, 0.0
    peak, ridge = power.max(1), plane.freq[band[power.argmax(1)]]
    heard = peak > gamma * (np.median(power, 1) + 1e-20)
    if heard.sum() < 5:
        return np.nan, 0.0, 0.0
    starts = (plane.time - (ridge - f0) / slope)[heard]
    onset = _centre(starts, peak[heard] > 0.1 * peak[heard].max(), 3.5, 3)
    since = plane.time - onset
    line = f0 + slope * since
    on = heard & (since >= -margin) & (since <= length + margin) & (np.abs(ridge - line) <= tolerance)
    runs = np.split(np.flatnonzero(on), np.flatnonzero(np.diff(np.flatnonzero(on)) > 1) + 1)
    run = max(runs, key=lambda r: peak[r].sum())
    if not len(run):
        return onset, 0.0, 0.0
    kept = np.zeros_like(plane.z)
    kept[run[:, None], band] = plane.z[run[:, None], band] * (np.abs(plane.freq[band] - line[run, None]) <= width / 2)
    first, last = max(0, run[0] * plane.hop - n // 2), min(len(x), run[-1] * plane.hop + n - n // 2)
    y = plane.signal(kept)[first:last]
    return onset, float(np.mean(y * y)), (last - first) / fs


def chirp_power(traces: DataFrame, fs: float, f0: float = 1000.0, f1: float = 2000.0, length: float = 3.0, **options) -> DataFrame:
    """ch, onset, power and duration of the chirp from f0 to f1 Hz over ``length`` seconds in each channel (a row per channel: ch, v)."""

    def kernel(x: np.ndarray) -> np.ndarray:
        return np.array([locate(c, fs, f0, f1, length, **options) for c in x.T]).reshape(-1, 3).T

    found = map_traces(traces, kernel, "ch long, found array<double>")
    onset = F.col("found")[0]
    return found.select("ch", F.when(~F.isnan(onset), onset).alias("onset"), F.col("found")[1].alias("power"), F.col("found")[2].alias("duration"))
