import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.frame import SignalFrame
from strataline.functions import dsp
from strataline.operators import detect, filters, match, pointwise, rolling, spectral, stats
from strataline.plans import chains
from strataline.sources import synthetic

RNG = np.random.default_rng(42)


def frame(spark, x, fs=100.0, **meta):
    return SignalFrame.from_array(spark, x, fs, **meta)


@pytest.fixture(scope="module")
def noise():
    return RNG.normal(size=(200, 6))


def table(df, value, rows="ti", cols="ch"):
    p = df.select(rows, cols, value).toPandas().pivot(index=rows, columns=cols, values=value)
    return p.to_numpy()


def test_roundtrip_and_shape(spark, noise):
    f = frame(spark, noise)
    assert f.shape == noise.shape and np.array_equal(f.collect(), noise)
    assert frame(spark, np.arange(5.0)).shape == (5, 1)
    assert np.array_equal(f.flatten(), noise.ravel())


def test_missing_values_are_skipped(spark):
    x = np.array([[1.0, np.nan], [3.0, 2.0], [np.nan, 4.0]])
    f = frame(spark, x)
    assert [r.mean for r in f.mean().orderBy("ch").collect()] == [2.0, 3.0]
    assert np.allclose(f.demean().collect(), x - np.nanmean(x, 0), equal_nan=True)


def test_point_operators(spark, noise):
    f, n, t = frame(spark, noise), len(noise), np.arange(len(noise))
    line = np.stack([np.polyval(np.polyfit(t, c, 1), t) for c in noise.T], 1)
    assert np.allclose(f.detrend().collect(), noise - line)
    across = np.stack([np.polyval(np.polyfit(np.arange(6), r, 1), np.arange(6)) for r in noise])
    assert np.allclose(f.detrend("distance").collect(), noise - across)
    assert np.allclose(f.demean().collect(), noise - noise.mean(0)) and np.allclose(f.demean("distance").collect(), noise - noise.mean(1, keepdims=True))
    z = f.normalize("zscore").collect()
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0), 1)
    m = f.normalize().collect()
    assert np.allclose(m.min(0), -1) and np.allclose(m.max(0), 1)
    assert np.allclose(frame(spark, np.ones((9, 1))).normalize().collect(), -1)
    assert np.allclose(f.scale(3).abs().collect(), abs(3 * noise))
    assert np.allclose(f.integrate().collect(), noise.cumsum(0) / 100)
    d = np.diff(noise, axis=0) * 100
    assert np.allclose(f.differentiate().collect(), np.vstack((d[:1], d)))
    assert np.array_equal(f.slice(slice(10, 50, 3), slice(1, 4)).collect(), noise[10:50:3, 1:4])
    assert np.array_equal(f.slice(slice(-7, None)).collect(), noise[-7:])
    assert n == 200


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_rolling_is_the_same_for_every_block(spark, noise, block):
    df = frame(spark, noise).df
    get = lambda d: SignalFrame(d).collect()
    for k in (5, 6):
        want = np.full(noise.shape, np.nan)
        for i in range(k // 2, len(noise) - (k - 1 - k // 2)):
            want[i] = np.sqrt((noise[i - k // 2 : i - k // 2 + k] ** 2).mean(0))
        assert np.allclose(get(rolling.rms(df, k, block)), want, equal_nan=True)
        pad = np.pad(noise, ((k // 2, k - 1 - k // 2), (0, 0)), mode="symmetric")
        med = np.stack([np.sort(pad[i : i + k], 0)[k // 2] for i in range(len(noise))])
        assert np.allclose(get(rolling.median_filter(df, k, block=block)), med)
    sq = noise**2
    tail = lambda n: np.stack([sq[max(0, i - n + 1) : i + 1].mean(0) for i in range(len(sq))])
    want = tail(4) / tail(20)
    want[:19] = 0
    assert np.allclose(get(rolling.sta_lta(df, 4, 20, block)), want)
    assert np.allclose(get(pointwise.integrate(df, 1.0, block)), noise.cumsum(0))
    t = noise[40:50, 2]
    got = table(match.template_1d(df, t, block), "score")
    ref = np.array([[w @ t / np.sqrt((w @ w) * (t @ t)) for w in (noise[i : i + 10, c] for c in range(6))] for i in range(191)])
    assert np.allclose(got, ref) and np.argmax(got[:, 2]) == 40
    with pytest.raises(ValueError):
        rolling.sta_lta(df, 5, 5)


def test_template_2d(spark):
    x = 0.1 * RNG.normal(size=(200, 20))
    patch = RNG.normal(size=(20, 5))
    x[100:120, 10:15] += patch
    got = match.template_2d(frame(spark, x).df, patch).orderBy(F.col("score").desc()).first()
    assert (got.ti, got.ch) == (100, 10) and got.score > 0.9


def test_reductions(spark, noise):
    f = frame(spark, noise)
    for name, want in (("mean", np.mean), ("std", np.std), ("max", np.max), ("min", np.min)):
        for axis, key in ((0, "ch"), (1, "ti")):
            assert np.allclose([r[name] for r in getattr(f, name)(axis).orderBy(key).collect()], want(noise, axis=axis))
        assert np.isclose(getattr(f, name)(None).first()[0], want(noise))
    assert np.isclose(f.stats().first().rms, np.sqrt((noise**2).mean()))
    over = f.threshold_detect(sigma=1.0)
    lim = noise.mean() + noise.std()
    assert np.array_equal(over.collect(), abs(noise) > lim)
    assert over.any().first()[0] and not over.all().first()[0]
    assert np.isclose(stats.percentiles(f.df, [0.98], F.abs("v")).first()[0], np.percentile(abs(noise), 98))


# --- filters: no reference library is at hand, so the properties that define them are tested


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 8])
def test_butterworth_gain(order):
    fs = 100.0
    gain = lambda sos, f: abs(dsp.response(sos, np.array([2 * np.pi * f / fs])))[0]
    for kind, edges, flat in (("lowpass", 20.0, 0.001), ("highpass", 20.0, 49.9), ("bandpass", (10.0, 30.0), None), ("bandstop", (10.0, 30.0), 0.001)):
        sos = dsp.butter_sos(order, edges, kind, fs)
        for e in np.atleast_1d(edges):
            assert np.isclose(gain(sos, e), np.sqrt(0.5), atol=1e-9), (kind, order)
        if flat:
            assert np.isclose(gain(sos, flat), 1, atol=1e-4)
        assert np.all(abs(np.concatenate([np.roots(s[3:]) for s in sos])) < 1)
        # the analogue magnitude at the warped frequencies
        for f in (3.0, 15.0, 27.0, 41.0):
            w, c = np.tan(np.pi * f / fs), np.tan(np.pi * np.atleast_1d(edges) / fs)
            x = {"lowpass": lambda: w / c[0], "highpass": lambda: c[0] / w, "bandpass": lambda: (w * w - c[0] * c[1]) / (w * (c[1] - c[0])), "bandstop": lambda: w * (c[1] - c[0]) / (w * w - c[0] * c[1])}[kind]()
            assert np.isclose(gain(sos, f), 1 / np.sqrt(1 + x ** (2 * order)), rtol=1e-6)


def test_filter_bank(spark):
    t = np.arange(2000) / 1000
    x = (np.sin(2 * np.pi * 20 * t) + np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 120 * t))[:, None]
    f = frame(spark, x, 1000.0)
    level = lambda y, hz: abs(np.fft.rfft(y[:, 0]))[round(hz * 2)] / 1000
    band = f.bandpass(40, 60).collect()
    assert level(band, 50) > 0.9 and level(band, 20) < 0.09 and level(band, 120) < 0.09
    low, high = f.lowpass(30).collect(), f.highpass(80).collect()
    assert level(low, 20) > 0.95 and level(low, 50) < 0.05 and level(high, 120) > 0.9 and level(high, 50) < 0.05
    notched = f.notch(50, 5).collect()
    assert level(notched, 50) < 0.1 and level(notched, 20) > 0.9
    stop = f.bandstop(40, 60).collect()
    assert level(stop, 50) < 0.05 and level(stop, 120) > 0.95
    # zero phase: an impulse stays where it is and its answer is symmetric
    imp = np.zeros((401, 1))
    imp[200] = 1
    y = dsp.zero_phase(dsp.butter_sos(4, 10.0, "lowpass", 100.0), imp)[:, 0]
    assert y.argmax() == 200 and np.allclose(y, y[::-1], atol=1e-9)
    const = dsp.zero_phase(dsp.butter_sos(4, 10.0, "lowpass", 100.0), np.full((60, 1), 7.0))
    assert np.allclose(const, 7)
    with pytest.raises(ValueError):
        dsp.zero_phase(dsp.butter_sos(4, (10.0, 20.0), "bandpass", 100.0), np.zeros((27, 1)))
    assert filters.SAMPLES


def test_causal_filter_over_chunks_is_one_pass():
    x = np.sin(np.arange(500) / 7)[:, None] + RNG.normal(size=(500, 1))
    sos = dsp.butter_sos(4, 10.0, "lowpass", 100.0)
    z = dsp.steady_state(sos)[:, :, None]
    whole, _ = dsp.sos_filter(sos, x, z)
    a, mid = dsp.sos_filter(sos, x[:123], z)
    b, _ = dsp.sos_filter(sos, x[123:], mid)
    assert np.allclose(np.vstack((a, b)), whole)


# --- spectra


def test_transforms(spark, noise):
    f = frame(spark, noise)
    want = abs(np.fft.rfft(noise, axis=0))
    assert np.allclose(table(f.fft(), "mag", "k"), want)
    env = f.envelope().collect()
    for n in (200, 199):
        z = dsp.analytic(noise[:n])
        assert np.allclose(z.real, noise[:n])
    assert np.allclose(env, abs(dsp.analytic(noise)))
    carrier = np.cos(2 * np.pi * 10 * np.arange(400) / 100)[:, None]
    assert np.allclose(frame(spark, carrier).envelope().collect(), 1, atol=1e-6)


def test_stft_and_spectrum(spark):
    n, hop, x = 32, 16, RNG.normal(size=(100, 2))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    pad = np.pad(x, ((16, 16 + (-(len(x)) % hop)), (0, 0)))
    segs = [pad[i : i + n] for i in range(0, len(pad) - n + 1, hop)]
    want = np.stack([abs(np.fft.rfft(s * hann[:, None], axis=0)) / hann.sum() for s in segs])
    rows = frame(spark, x).stft(n).toPandas()
    for s, w in enumerate(want):
        assert np.allclose(rows[rows.seg == s].pivot(index="k", columns="ch", values="mag").to_numpy(), w)
    assert rows.seg.max() + 1 == len(want)
    parts = [x[i : i + n] for i in range(0, len(x) - n + 1, hop)]
    power = np.mean([abs(np.fft.rfft((p - p.mean(0)) * hann[:, None], axis=0)) ** 2 for p in parts], 0) / hann.sum() ** 2
    power[1:-1] *= 2
    spec = spectral.spectrum(frame(spark, x).df, 100.0, n)
    assert np.allclose(table(spec, "power", "k"), power)
    with pytest.raises(IndexError):
        frame(spark, x).spectrum(channel=9)


def test_peaks(spark):
    t = np.arange(4000) / 1000
    x = (3 * np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 120 * t) + 0.01 * RNG.normal(size=4000))[:, None]
    spec = frame(spark, x, 1000.0).spectrum(window=1000)
    top = spectral.peaks(spec, n_peaks=2).orderBy("rank").collect()
    assert [round(r.freq) for r in top] == [50, 120]
    assert [round(r.freq) for r in spectral.peaks(spec, min_freq=100).filter("rank = 1").collect()] == [120]
    wide = spectral.peaks(spec, n_peaks=9, min_prominence=0.1).collect()
    assert sorted(round(r.freq) for r in wide) == [50, 120]
    flat = spark.createDataFrame([(0, k, float(k), v) for k, v in enumerate([0.0, 2.0, 2.0, 2.0, 1.0, 0.0])], "ch long, k long, freq double, power double")
    assert [r.freq for r in spectral.peaks(flat).collect()] == [2.0]


def test_fk(spark):
    t, fs = np.arange(512) / 1000, 1000.0
    ricker = lambda u: (1 - 2 * (np.pi * 30 * u) ** 2) * np.exp(-((np.pi * 30 * u) ** 2))
    x = np.stack([ricker(t - 0.2 - c / 1000) for c in range(50)], 1)
    f = frame(spark, x, fs)
    plane = f.fk().toPandas()
    z = np.fft.fft2(x)
    assert np.allclose(plane.pivot(index="fi", columns="ki", values="re").to_numpy(), z.real) and np.allclose(plane.pivot(index="fi", columns="ki", values="im").to_numpy(), z.imag)
    assert np.allclose(SignalFrame(spectral.fk_inverse(f.fk())).collect(), x)
    kept, cut = f.fk_filter(v_min=500).collect(), f.fk_filter(v_max=500).collect()
    assert (kept**2).sum() > 0.9 * (x**2).sum() and (cut**2).sum() < 0.1 * (x**2).sum()
    mask = dsp.fk_mask(np.fft.fftfreq(512, 1 / fs), np.fft.fftfreq(50), 200.0, 2000.0)
    assert np.allclose(f.fk_filter(200, 2000).collect(), np.fft.ifft2(z * mask).real)
    assert f.fk_image(64, 10).agg(F.max("db")).first()[0] == 0


def test_band_power_and_response(spark):
    freqs, p = np.arange(40.0), np.ones(40)
    p[15:25] += 3
    spec = spark.createDataFrame([(0, k, float(k), float(p[k])) for k in range(40)], "ch long, k long, freq double, power double")
    assert np.isclose(spectral.band_power(spec, 5, 35).first().band_power, np.trapezoid((p - 1)[5:36], freqs[5:36]))
    t = np.arange(600) / 100
    x = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 25 * t)], 1)
    rows = {r.freq: r.ch for r in frame(spark, x).frequency_response([10.0, 25.0]).collect()}
    assert rows == {10.0: 0, 25.0: 1}


# --- events and quality


def test_trigger(spark):
    x = np.zeros((1000, 10))
    x[200:300, 2:6] = 5.0
    x[990:, 9] = 4.0
    inv = {"acquisition": {"start_time": "2024-01-01 12:00:00"}}
    rows = frame(spark, x, inventory=inv).trigger_detection(1.0).orderBy("start_time").collect()
    assert [(r.min_channel, r.max_channel) for r in rows] == [(2, 5), (9, 9)]
    assert str(rows[0].start_time) == "2024-01-01 12:00:02" and str(rows[0].end_time) == "2024-01-01 12:00:02.990000" and rows[0].id.endswith("_0")
    levels = np.array([0, 1, 3, 1, 1, 0, 1, 1, 0.0])[:, None]
    assert frame(spark, levels).trigger_detection(2.0).count() == 1
    got = frame(spark, levels).trigger_detection(2.0, trigger_off=0.5).first()
    assert (got.end_time - got.start_time).total_seconds() == pytest.approx(0.03)


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_islands(spark, block):
    hit = sorted(set(RNG.integers(0, 120, 60).tolist()))
    got = detect.islands(spark.createDataFrame([(i,) for i in hit], "ti long"), block).groupBy("island").agg(F.min("ti"), F.max("ti")).orderBy("island").collect()
    want, start = [], hit[0]
    for a, b in zip(hit, [*hit[1:], None]):
        if b != a + 1:
            want.append((start, start, a))
            start = b
    assert [tuple(r) for r in got] == want


def test_rms_events(spark):
    x = np.full((300, 4), 1e-3)
    x[50:100] = 1.0
    x[280:] = 1.0
    f = frame(spark, x)
    rows = f.detect_events().collect()
    assert len(rows) == 1 and (rows[0].start_s, rows[0].end_s, rows[0].duration_ms) == (0.5, 1.0, 500.0)
    assert detect.rms_events(f.df, 100.0, keep_open=True).count() == 2


def test_quality(spark):
    x = RNG.normal(size=(400, 9))
    x[:, 1] *= 100
    x[:, 5] *= 1e-4
    x[:, 4] += 8 * np.sin(2 * np.pi * 50 * np.arange(400) / 400)
    q = frame(spark, x, 400.0).quality().first()
    assert q.bad_channels == [1, 5] and q.dead_channels == 1 and q.noisy_channels == 1 and q.has_50hz and not q.has_60hz
    assert np.isclose(q.rms_level, np.sqrt((x**2).mean()))


# --- units, chains, synthetic sources


def test_units(spark):
    f = frame(spark, np.ones((5, 2)), units="rad/s", gauge_length=10.0)
    s = f.to_standard_units()
    assert s.unit == "strain_rate" and 1e-9 < s.collect()[0, 0] < 1e-7 and f.unit == "rad/s"
    assert np.allclose(s.convert_units("nanostrain/s").collect(), s.collect() * 1e9)
    with pytest.raises(ValueError):
        s.convert_units("m")


def test_chains(spark, noise):
    f = frame(spark, noise)
    a = chains.process(f, chains.parse("detrend | bandpass low=5 high=20.5 order=2 | normalize method=zscore | abs")).collect()
    assert np.allclose(a, f.detrend().bandpass(5, 20.5, 2).normalize("zscore").abs().collect())
    assert np.allclose(chains.clean(f, "standard_denoise").collect(), f.detrend().highpass(1.0).collect())
    for bad in ([{"op": "collect"}], [{"op": "__init__"}]):
        with pytest.raises(ValueError):
            chains.process(f, bad)
    with pytest.raises(ValueError):
        chains.clean(f, "none")
    s = chains.Session()
    name = s.store(f, note=1)
    other = s.process(name, [{"op": "abs"}])
    assert spark.table(name).count() == noise.size and s.metadata(other)["source"] == name and len(s.list()) == 2
    s.delete(name)
    with pytest.raises(KeyError):
        s.get(name)
    assert s.clear() == 1


def test_models(spark, noise):
    from strataline.plans import models

    out = frame(spark, noise).predict(lambda x: np.stack((x.mean(1), x.max(1)), 1))
    rows = {r.ch: r.output for r in out.collect()}
    assert np.allclose([rows[c] for c in range(6)], np.stack((noise.mean(0), noise.max(0)), 1))
    assert models.summary(out).collect()[0]["class"] == 1


def test_synthetic(spark):
    for kind in synthetic.EXAMPLES:
        f = synthetic.example(spark, kind, n=500, channels=4)
        assert f.shape == (500, 4) and np.array_equal(f.collect(), SignalFrame(f.df.repartition(7)).collect())
    x = synthetic.random(spark, 5000, 4).collect()
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    assert np.allclose(synthetic.chirp(spark, 1000, 1, 1000.0, 1, 100).collect()[:, 0], np.cos(2 * np.pi * (np.arange(1000) / 1000 + 99 / 2 * (np.arange(1000) / 1000) ** 2)), atol=1e-9)
    with pytest.raises(ValueError):
        synthetic.example(spark, "none")


def test_data_behind_plots(spark, noise):
    f = frame(spark, noise)
    assert f.series(most=50).count() == 5 * 50
    small, lim = f.heatmap(100)
    assert small.count() == 600 and np.isclose(lim.first()[0], np.percentile(abs(noise[::2]), 98))
    assert np.isclose(f.limits().first().hi, max(abs(np.percentile(noise, [5, 95]))))
    assert f.profile("std", True).count() == 6
    with pytest.raises(ValueError):
        f.profile("median")


def test_trace_chain_equals_long_chain(spark, noise):
    from strataline.operators import layout, traces

    f = frame(spark, noise)
    t = layout.to_traces(f.df)
    sos = dsp.butter_sos(4, (5.0, 20.0), "bandpass", 100.0)
    got = layout.to_long(traces.chain(t, traces.detrend(), traces.zero_phase(sos), traces.normalize(), traces.absolute(), traces.scale(2.0)))
    assert np.allclose(SignalFrame(got).collect(), f.detrend().bandpass(5.0, 20.0).normalize().abs().scale(2.0).collect())
    z = layout.to_long(traces.chain(t, traces.demean(), traces.normalize("zscore")))
    assert np.allclose(SignalFrame(z).collect(), f.normalize("zscore").collect())


def test_block_filter_is_the_recursion():
    x = RNG.normal(size=(1000, 3)).cumsum(0)
    for sos in (dsp.butter_sos(4, (1.0, 20.0), "bandpass", 100.0), dsp.butter_sos(5, 0.5, "highpass", 100.0), dsp.notch_sos(10.0, 30.0, 100.0)):
        z = dsp.steady_state(sos)[:, :, None] * x[0]
        (y, s), (want, last) = dsp.sos_filter(sos, x, z), dsp._recursion(sos, x, z)
        assert np.allclose(y, want, rtol=1e-9, atol=1e-9) and np.allclose(s, last, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block", [40, 1 << 18])
def test_segments_are_the_same_for_every_block(spark, monkeypatch, block):
    monkeypatch.setattr(spectral, "BLOCK", block)
    x = RNG.normal(size=(333, 2))
    x[50:120, 1] = np.nan
    n, hop = 32, 12
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    f = frame(spark, x)
    rows = spectral.stft_mag(f.df.filter("v IS NOT NULL"), 100.0, n, n - hop).toPandas()
    for c in range(2):
        pad = np.concatenate((np.full(16, np.nan), x[:, c], np.full(60, np.nan)))
        for s in range(-(-333 // hop) + 1):
            part = pad[s * hop : s * hop + n]
            got = rows[(rows.ch == c) & (rows.seg == s)].sort_values("k").mag.to_numpy()
            want = abs(np.fft.rfft(np.nan_to_num(part) * hann)) / 16 if not np.isnan(part).all() else np.zeros(0)
            assert len(got) == len(want) and np.allclose(got, want)
    db = spectral.spectrogram(f.df, 100.0, n, n - hop, db=True, low=-20.0, high=0.0).toPandas()
    plain = spectral.spectrogram(f.df, 100.0, n, n - hop).toPandas()
    both = db.merge(plain, on=["ch", "seg", "k"])
    assert np.allclose(both.power_x, np.clip(10 * np.log10(both.power_y + 1e-12), -20, 0)) and np.allclose(both.t_x, (both.seg * hop + 16) / 100)
    mean = plain.groupby(["ch", "k"]).power.mean()
    spec = spectral.spectrum(f.df, 100.0, n, 0.5).toPandas()
    again = spectral.spectrogram(f.df, 100.0, n, n // 2).toPandas().groupby(["ch", "k"]).power.mean()
    assert np.allclose(spec.set_index(["ch", "k"]).power.sort_index(), again.sort_index()) and len(mean) == 34


def test_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(stats, "BINS", 16)
    monkeypatch.setattr(stats, "FEW", 5)
    for x in (RNG.normal(size=3000), np.repeat(RNG.integers(0, 9, 40), 25).astype(float), np.array([3.0]), np.concatenate((np.zeros(500), 1e9 * RNG.random(5))), np.array([1.0, np.nextafter(1.0, 2)] * 40)):
        df = frame(spark, x[:, None]).df
        got = stats.percentiles(df, [0.0, 0.05, 0.5, 0.977, 1.0]).first()
        assert np.allclose(got, np.percentile(x, [0, 5, 50, 97.7, 100]), rtol=1e-15, atol=0), x[:5]
    assert stats.percentiles(df.limit(0), [0.5]).first()[0] is None


def test_numbers_go_on_over_blocks(spark):
    at = sorted(set(RNG.integers(0, 1000, 200).tolist()))
    rows = detect.numbered(spark.createDataFrame([(i,) for i in at], "ti long").repartition(5), "ti", "n", 64).orderBy("ti").collect()
    assert [r.n for r in rows] == list(range(len(at)))


def test_dominant(spark):
    t = np.arange(2000) / 1000
    x = np.stack([3 * np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 120 * t), np.sin(2 * np.pi * 200 * t) + 2 * np.sin(2 * np.pi * 30 * t)], 1)
    got = {r.ch: r for r in spectral.dominant(frame(spark, x, 1000.0).spectrum(window=1000), min_prominence=0.1).collect()}
    assert {c: [round(f) for f in r.freqs] for c, r in got.items()} == {0: [50, 120], 1: [30, 200]} and round(got[0].freq) == 50


def test_a_chain_takes_one_shuffle(spark, noise):
    f = frame(spark, noise).detrend().bandpass(5, 20).normalize("zscore").abs()
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1
    t = SignalFrame.from_traces(f.traces, 100.0).lowpass(10.0).scale(2.0)
    plan = SignalFrame.from_traces(spark.createDataFrame([(0, [1.0] * 50)], "ch long, v array<double>"), 100.0).lowpass(10.0).scale(2.0).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert np.allclose(t.collect(), f.lowpass(10.0).scale(2.0).collect())
    # without a filter the rows are not gathered
    assert "MapInArrow" not in frame(spark, noise).detrend().abs().scale(2.0).df._jdf.queryExecution().executedPlan().toString()
    sos = dsp.butter_sos(4, 1.0, "highpass", 100.0)
    assert np.allclose(frame(spark, noise).integrate_data(1.0).collect(), (lambda y: y - y.mean(0))(dsp.zero_phase(sos, noise.cumsum(0))))
    assert np.allclose(frame(spark, noise).process_differential(1.0).collect(), (lambda y: y - y.mean(0))(dsp.zero_phase(sos, noise)))


def test_chirp_power(spark):
    from strataline.operators import chirp

    fs, n = 8000.0, 40_000
    t = np.arange(n) / fs
    x = 0.05 * RNG.normal(size=(n, 3))
    for c, (onset, level) in enumerate(((0.8, 0.5), (1.6, 1.0))):
        on = (t >= onset) & (t < onset + 3)
        u = t[on] - onset
        x[on, c] += level * np.cos(2 * np.pi * (1000 * u + 1000 / 6 * u**2))
    rows = {r.ch: r for r in frame(spark, x, fs).chirp_power().collect()}
    assert abs(rows[0].onset - 0.8) < 0.02 and abs(rows[1].onset - 1.6) < 0.02 and rows[2].power < 0.01
    assert np.isclose(rows[0].power, 0.125, rtol=0.2) and np.isclose(rows[1].power, 0.5, rtol=0.2)
    assert 2.5 < rows[0].duration < 3.2
    y = RNG.normal(size=3000)
    plane = chirp.Plane(y, fs, 256, 64)
    assert np.allclose(plane.signal(plane.z), y)


def test_curves(spark):
    x = RNG.normal(size=(4096, 2))
    f = frame(spark, x, 100.0)
    assert f.spectrum_curve(1024, 100).groupBy("ch").count().agg(F.max("count")).first()[0] <= 100
    image, lim = f.spectrogram_image(1, 256)
    db, edge = image.toPandas().db, lim.first()
    assert len(db) == 31 * 129 and np.isclose(edge.lo, db.mean() - 2 * db.std(ddof=0)) and np.isclose(edge.hi, db.mean() + 2 * db.std(ddof=0))
    assert f.dominant_frequencies(3).count() == 2
