"""Registry of the library's own queries and their SQL.

Signals: EV, EM and EG of ``sources.tables``. Values are rounded alike on both sides; adding 0.0 removes a negative zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import dsp, timeutil, units
from strataline.operators import detect, filters, match, pointwise, rolling, spectral, stats
from strataline.sources import spool
from strataline.sources.tables import FS, eg, em, ev, ix, table
from strataline.streaming import stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ti, value AS v FROM events)"
EM = "em AS (SELECT vec_id AS ch, u.i - 1 AS ti, CAST(embedding[u.i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS u(i))"
EG = """
    eg_sums AS (SELECT event_type AS kind, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, sum(value) AS s FROM events GROUP BY 1, 2),
    eg_kinds AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS ch FROM (SELECT DISTINCT kind FROM eg_sums WHERE kind IS NOT NULL)),
    eg_hours AS (SELECT unnest(range(min(hour), max(hour) + 1)) AS hour, min(hour) AS lo FROM eg_sums),
    eg AS (SELECT k.ch, h.hour - h.lo AS ti, coalesce(s.s, CAST(0 AS DOUBLE)) AS v FROM eg_kinds k CROSS JOIN eg_hours h LEFT JOIN eg_sums s ON s.kind = k.kind AND s.hour = h.hour),
    len AS (SELECT max(ti) + 1 AS n FROM eg)
"""
TAU = repr(2 * math.pi)


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + CAST(0 AS DOUBLE)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _out(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(F.col("ch").cast("long").alias("ch"), F.col("ti").cast("long").alias("ti"), rounded("v", digits).alias("v"))


def _long(cte: str, name: str, expr: str, where: str = "", digits: int = 6) -> str:
    return f"WITH {cte} SELECT CAST(ch AS BIGINT) AS ch, CAST(ti AS BIGINT) AS ti, {r(expr, digits)} AS v FROM {name} {where}"


# --- reductions


@query(f"WITH {EV} SELECT ch, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, max(v) AS max, min(v) AS min, {r('sqrt(avg(v * v))')} AS rms, {r('var_pop(v)', 4)} AS var FROM ev GROUP BY ch")
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.reduce(ev(spark, d), ["mean", "std", "max", "min", "rms", "var"])
    return s.select("ch", rounded("mean").alias("mean"), rounded("std").alias("std"), "max", "min", rounded("rms").alias("rms"), rounded("var", 4).alias("var"))


@query(f"WITH {EM} SELECT CAST(ti AS BIGINT) AS ti, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, max(v) AS max, min(v) AS min FROM em GROUP BY ti")
def time_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.reduce(em(spark, d), ["mean", "std", "max", "min"], axis=1)
    return s.select("ti", rounded("mean").alias("mean"), rounded("std").alias("std"), "max", "min")


@query(f"WITH {EM} SELECT {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, max(v) AS max, min(v) AS min, {r('sqrt(avg(v * v))')} AS rms FROM em")
def global_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.reduce(em(spark, d), ["mean", "std", "max", "min", "rms"], axis=None)
    return s.select(rounded("mean").alias("mean"), rounded("std").alias("std"), "max", "min", rounded("rms").alias("rms"))


THRESHOLD = "t AS (SELECT avg(v) + 2 * stddev_pop(v) AS lim FROM ev)"


@query(f"WITH {EV}, {THRESHOLD} SELECT ch, bool_or(abs(v) > lim) AS any, bool_and(abs(v) > lim) AS all FROM ev, t GROUP BY ch".replace("AS any", 'AS "any"').replace("AS all", 'AS "all"'))
def any_all(spark: SparkSession, d: str) -> DataFrame:
    over = detect.threshold_detect(ev(spark, d), sigma=2.0).withColumn("v", F.col("v").cast("int"))
    return stats.reduce(over, ["any", "all"])


@query(f"WITH {EM} SELECT {r('quantile_cont(abs(v), 0.98)')} AS p98 FROM em")
def heatmap_limit(spark: SparkSession, d: str) -> DataFrame:
    return stats.percentiles(em(spark, d), [0.98], F.abs("v")).select(rounded("p98").alias("p98"))


@query(
    f"WITH {EM}, p AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi, min(v) AS least FROM em)"
    f" SELECT {r('CASE WHEN least < 0 THEN -greatest(abs(lo), abs(hi)) ELSE lo END')} AS lo, {r('CASE WHEN least < 0 THEN greatest(abs(lo), abs(hi)) ELSE hi END')} AS hi FROM p"
)
def waterfall_limits(spark: SparkSession, d: str) -> DataFrame:
    return stats.limits(em(spark, d)).select(rounded("lo").alias("lo"), rounded("hi").alias("hi"))


@query(f"WITH {EM} SELECT CAST(ch AS BIGINT) AS ch, ch * CAST(2 AS DOUBLE) AS x, {r('sqrt(avg(v * v))')} AS value FROM em GROUP BY ch")
def channel_profile(spark: SparkSession, d: str) -> DataFrame:
    return stats.profile(em(spark, d), "rms", 2.0).select("ch", "x", rounded("value").alias("value"))


# --- selection and point operators


@query(_long(EM, "(SELECT ch, (ti - 3) // 5 AS ti, v FROM em WHERE ti >= 3 AND ti < 60 AND (ti - 3) % 5 = 0)", "v"))
def slice_step(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.select(em(spark, d), 3, 60, 5))


@query(_long(EM, "(SELECT ch, ti // 4 AS ti, v FROM em WHERE ti % 4 = 0)", "v"))
def decimate(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.decimate(em(spark, d), 64, 20))


@query(_long(EV, "ev", "abs(v * CAST(-2.5 AS DOUBLE))"))
def scale_abs(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.absolute(pointwise.scale(ev(spark, d), -2.5)))


@query(_long(EV, "ev", "v", "WHERE ch IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"))
def channel_select(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "customer").select(F.col("c_custkey").alias("channel_index"), F.col("c_acctbal").alias("quality"))
    return _out(pointwise.select_channels(ev(spark, d), meta, "quality > 5000"))


def _line(key: str, order: str) -> str:
    return f"v - (regr_slope(v, {order}) OVER (PARTITION BY {key}) * {order} + regr_intercept(v, {order}) OVER (PARTITION BY {key}))"


@query(_long(EV, "ev", _line("ch", "ti")))
def detrend(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.detrend(ev(spark, d)))


@query(_long(EM, "em", _line("ti", "ch")))
def detrend_distance(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.detrend(em(spark, d), "distance"))


@query(_long(EV, "ev", "v - avg(v) OVER (PARTITION BY ch)", digits=9))
def demean(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.demean(ev(spark, d)), 9)


@query(_long(EM, "em", "v - avg(v) OVER (PARTITION BY ti)"))
def demean_distance(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.demean(em(spark, d), "distance"))


SPAN = "(max(v) OVER (PARTITION BY ch) - min(v) OVER (PARTITION BY ch))"


@query(_long(EV, "ev", f"2 * (v - min(v) OVER (PARTITION BY ch)) / CASE WHEN {SPAN} = 0 THEN CAST(1 AS DOUBLE) ELSE {SPAN} END - 1"))
def normalize_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.normalize(ev(spark, d)))


DEV = "stddev_pop(v) OVER (PARTITION BY ch)"


@query(_long(EV, "ev", f"(v - avg(v) OVER (PARTITION BY ch)) / CASE WHEN {DEV} = 0 THEN CAST(1 AS DOUBLE) ELSE {DEV} END"))
def normalize_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.normalize(ev(spark, d), "zscore"))


# --- rolling and cumulative operators


@query(_long(EV, "ev", "CASE WHEN count(v) OVER w = 6 THEN sqrt(avg(v * v) OVER w) END", "WINDOW w AS (PARTITION BY ch ORDER BY ti ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"))
def rolling_rms(spark: SparkSession, d: str) -> DataFrame:
    return _out(rolling.rms(ev(spark, d), 6, block=32))


@query(_long(EM, "em", "CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END", "WINDOW w AS (PARTITION BY ti ORDER BY ch ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))
def spatial_smooth(spark: SparkSession, d: str) -> DataFrame:
    return _out(rolling.spatial_smooth(em(spark, d), 3, block=100))


@query(_long(EV, "ev", "sum(v) OVER (PARTITION BY ch ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(100 AS DOUBLE)"))
def integrate(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.integrate(ev(spark, d), FS, block=32))


@query(_long(EV, "ev", "coalesce(v - lag(v) OVER w, lead(v) OVER w - v) * CAST(100 AS DOUBLE)", "WINDOW w AS (PARTITION BY ch ORDER BY ti)", 4))
def differentiate(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.differentiate(ev(spark, d), FS, block=32), 4)


@query(
    f"""WITH {EV}, n AS (SELECT ch, max(ti) + 1 AS n FROM ev GROUP BY ch),
    m AS (
        SELECT e.ch, a.ti, list_sort(list(e.v))[3] AS v
        FROM (SELECT ev.ch, ev.ti, ev.ti + o.o AS p, n.n FROM ev JOIN n ON n.ch = ev.ch CROSS JOIN (SELECT i AS o FROM unnest(range(-2, 3)) AS x(i)) o) a
        JOIN ev e ON e.ch = a.ch AND e.ti = CASE WHEN a.p < 0 THEN -1 - a.p WHEN a.p >= a.n THEN 2 * a.n - 1 - a.p ELSE a.p END
        GROUP BY e.ch, a.ti
    ) SELECT ch, CAST(ti AS BIGINT) AS ti, {r('v')} AS v FROM m"""
)
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    return _out(rolling.median_filter(ev(spark, d), 5, block=32))


@query(
    _long(
        EV,
        "(SELECT ch, ti, avg(v * v) OVER (PARTITION BY ch ORDER BY ti ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, avg(v * v) OVER (PARTITION BY ch ORDER BY ti ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM ev)",
        "CASE WHEN ti < 9 THEN CAST(0 AS DOUBLE) ELSE s / CASE WHEN l = 0 THEN CAST(1e-10 AS DOUBLE) ELSE l END END",
    )
)
def sta_lta(spark: SparkSession, d: str) -> DataFrame:
    return _out(rolling.sta_lta(ev(spark, d), 3, 10, block=32))


@query(f"WITH {EV}, {THRESHOLD} SELECT ch, CAST(ti AS BIGINT) AS ti, abs(v) > lim AS v FROM ev, t")
def threshold_detect(spark: SparkSession, d: str) -> DataFrame:
    return detect.threshold_detect(ev(spark, d), sigma=2.0).select("ch", "ti", "v")


# --- matching

TEMPLATE = (0.1, -0.2, 0.15, 0.05)
PATCH = ((0.1, -0.2), (0.05, 0.1), (-0.1, 0.2))
CELLS = ", ".join(f"({i}, {j}, CAST({w} AS DOUBLE))" for i, row in enumerate(PATCH) for j, w in enumerate(row))


@query(
    f"""WITH {EM}, t AS (SELECT * FROM (VALUES {", ".join(f"({i}, CAST({w} AS DOUBLE))" for i, w in enumerate(TEMPLATE))}) AS t(i, w)),
    s AS (SELECT em.ch, em.ti - t.i AS ti, sum(em.v * t.w) AS dot, sum(em.v * em.v) AS sq, count(*) AS n FROM em CROSS JOIN t GROUP BY 1, 2)
    SELECT CAST(ch AS BIGINT) AS ch, CAST(ti AS BIGINT) AS ti, {r("CASE WHEN sq > 0 THEN dot / sqrt(sq * (SELECT sum(w * w) FROM t)) ELSE CAST(0 AS DOUBLE) END")} AS score
    FROM s WHERE n = 4 AND ti >= 0"""
)
def template_1d(spark: SparkSession, d: str) -> DataFrame:
    return match.template_1d(em(spark, d), TEMPLATE, block=16).select("ch", "ti", rounded("score").alias("score"))


@query(
    f"""WITH {EM}, t AS (SELECT * FROM (VALUES {CELLS}) AS t(i, j, w)),
    s AS (SELECT em.ti - t.i AS ti, em.ch - t.j AS ch, sum(em.v * t.w) AS dot, sum(em.v * em.v) AS sq, count(*) AS n FROM em CROSS JOIN t GROUP BY 1, 2)
    SELECT CAST(ch AS BIGINT) AS ch, CAST(ti AS BIGINT) AS ti, {r("CASE WHEN sq > 0 THEN dot / sqrt(sq * (SELECT sum(w * w) FROM t)) ELSE CAST(0 AS DOUBLE) END")} AS score FROM s WHERE n = 6"""
)
def template_2d(spark: SparkSession, d: str) -> DataFrame:
    return match.template_2d(em(spark, d), PATCH).select("ch", "ti", rounded("score").alias("score"))


# --- spectra


def _dft(source: str, key: str, i: str, n: str, bins: int) -> str:
    a = f"(-{TAU} * ((k * {i}) % {n}) / {n})"
    return f"SELECT {key}, {n} AS n, k, sum(v * cos({a})) AS re, sum(v * sin({a})) AS im FROM {source} CROSS JOIN (SELECT i AS k FROM unnest(range(0, {bins})) AS b(i)) b WHERE k <= {n} // 2 GROUP BY {key}, {n}, k"


@query(
    f"WITH {EV}, z AS (SELECT ev.ch, ti, v, n FROM ev JOIN (SELECT ch, max(ti) + 1 AS n FROM ev GROUP BY ch) c ON c.ch = ev.ch), f AS ({_dft('z', 'ch', 'ti', 'n', 200)})"
    f" SELECT ch, CAST(k AS BIGINT) AS k, {r('k * CAST(100 AS DOUBLE) / n')} AS freq, {r('sqrt(re * re + im * im)', 4)} AS mag FROM f"
)
def fft_mag(spark: SparkSession, d: str) -> DataFrame:
    return spectral.fft_mag(ev(spark, d), FS).select("ch", "k", rounded("freq").alias("freq"), rounded("mag", 4).alias("mag"))


@query(
    f"WITH {EM}, z AS (SELECT ch, ti, v, 64 AS n FROM em), f AS ({_dft('z', 'ch', 'ti', 'n', 33)})"
    f" SELECT CAST(ch AS BIGINT) AS ch, CAST(k AS BIGINT) AS k, {r('k * CAST(100 AS DOUBLE) / n')} AS freq, {r('sqrt(re * re + im * im)')} AS mag FROM f"
)
def fft_kernel(spark: SparkSession, d: str) -> DataFrame:
    return spectral.fft_mag(em(spark, d), FS).select("ch", "k", rounded("freq").alias("freq"), rounded("mag").alias("mag"))


HANN = f"(CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos({TAU} * j / 32))"
STFT = f"""WITH {EG}, c AS (SELECT ch, ti + 16 - seg * 16 AS j, seg, v FROM eg CROSS JOIN (SELECT unnest(range(0, CAST(ceil(n / 16) AS BIGINT) + 1)) AS seg FROM len) g WHERE ti + 16 - seg * 16 BETWEEN 0 AND 31),
    w AS (SELECT ch, seg, j, v * {HANN} AS v, 32 AS n FROM c), f AS ({_dft("w", "ch, seg", "j", "n", 17)})"""


@query(f"{STFT} SELECT CAST(ch AS BIGINT) AS ch, CAST(seg AS BIGINT) AS seg, CAST(k AS BIGINT) AS k, {r('k * CAST(100 AS DOUBLE) / 32')} AS freq, {r('seg * CAST(16 AS DOUBLE) / 100')} AS t, {r('sqrt(re * re + im * im) / 16', 4)} AS mag FROM f")
def stft_mag(spark: SparkSession, d: str) -> DataFrame:
    s = spectral.stft_mag(eg(spark, d), FS, 32)
    return s.select("ch", "seg", "k", rounded("freq").alias("freq"), rounded("t").alias("t"), rounded("mag", 4).alias("mag"))


def _power(n: str, hop: str) -> str:
    """Mean power of Hann segments of EG; n and hop are SQL expressions over len (n samples)."""
    bins = _dft("w", "ch, seg", "j", "m", 1025)
    return f"""WITH {EG}, size AS (SELECT n, {n} AS m, {hop} AS hop FROM len), g AS (SELECT m, hop, unnest(range(0, (n - (m - hop)) // hop)) AS seg FROM size),
    c AS (SELECT ch, ti - seg * hop AS j, seg, v, g.m FROM eg CROSS JOIN g WHERE ti - seg * hop BETWEEN 0 AND g.m - 1),
    a0 AS (SELECT ch, seg, avg(v) AS mean FROM c GROUP BY ch, seg),
    w AS (SELECT c.ch, c.seg, c.j, (c.v - a0.mean) * (CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos({TAU} * j / c.m)) AS v, c.m FROM c JOIN a0 ON a0.ch = c.ch AND a0.seg = c.seg), f AS ({bins}),
    p AS (SELECT ch, seg, k, k * CAST(100 AS DOUBLE) / n AS freq, (re * re + im * im) / (n / CAST(2 AS DOUBLE) * n / 2) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS power FROM f),
    a AS (SELECT ch, k, freq, avg(power) AS power FROM p GROUP BY ch, k, freq)"""


@query(f"{_power("64", "32")} SELECT CAST(ch AS BIGINT) AS ch, CAST(k AS BIGINT) AS k, {r('freq')} AS freq, {r('power', 4)} AS power FROM a")
def spectrum(spark: SparkSession, d: str) -> DataFrame:
    return spectral.spectrum(eg(spark, d), FS, 64).select("ch", "k", rounded("freq").alias("freq"), rounded("power", 4).alias("power"))


@query(f"{_power("least(2048, greatest(8, n // 4))", "(least(2048, greatest(8, n // 4)) - least(2048, greatest(8, n // 4)) // 2)")} SELECT CAST(ch AS BIGINT) AS ch, CAST(k AS BIGINT) AS k, {r('freq')} AS freq, {r('sqrt(power)', 4)} AS mag FROM a")
def welch(spark: SparkSession, d: str) -> DataFrame:
    frame = eg(spark, d)
    return spectral.welch(frame, FS, frame.agg(F.max("ti") + 1).first()[0] or 0).select("ch", "k", rounded("freq").alias("freq"), rounded("mag", 4).alias("mag"))


@query(
    f"{_power("64", "32")}, q AS (SELECT *, lag(power) OVER (PARTITION BY ch ORDER BY k) AS l, lead(power) OVER (PARTITION BY ch ORDER BY k) AS n FROM a WHERE freq >= 2 AND freq <= 45),"
    f" o AS (SELECT ch, CAST(row_number() OVER (PARTITION BY ch ORDER BY power DESC, k DESC) AS INTEGER) AS rank, freq, power FROM q WHERE power > l AND power > n)"
    f" SELECT CAST(ch AS BIGINT) AS ch, rank, {r('freq')} AS freq, {r('power', 4)} AS power FROM o WHERE rank <= 3"
)
def peaks(spark: SparkSession, d: str) -> DataFrame:
    p = spectral.peaks(spectral.spectrum(eg(spark, d), FS, 64), "power", 2.0, 45.0)
    return p.select("ch", "rank", rounded("freq").alias("freq"), rounded("power", 4).alias("power"))


@query(
    f"{_power("64", "32")}, b AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY k) AS i, row_number() OVER (PARTITION BY ch ORDER BY k DESC) AS j FROM a WHERE freq >= 5 AND freq <= 40),"
    " e AS (SELECT ch, avg(CASE WHEN i <= 5 THEN power END) AS f, avg(CASE WHEN j <= 5 THEN power END) AS l, count(*) AS n FROM b GROUP BY ch),"
    " u AS (SELECT b.ch, b.k, b.freq, greatest(b.power - (e.f + (e.l - e.f) * (b.i - 1) / CAST(e.n - 1 AS DOUBLE)), CAST(0 AS DOUBLE)) AS net FROM b JOIN e ON e.ch = b.ch),"
    " st AS (SELECT ch, (lead(freq) OVER (PARTITION BY ch ORDER BY k) - freq) * (lead(net) OVER (PARTITION BY ch ORDER BY k) + net) / 2 AS strip FROM u)"
    f" SELECT CAST(ch AS BIGINT) AS ch, {r('sum(strip)', 4)} AS band_power FROM st GROUP BY ch"
)
def band_power(spark: SparkSession, d: str) -> DataFrame:
    return spectral.band_power(spectral.spectrum(eg(spark, d), FS, 64), 5.0, 40.0).select("ch", rounded("band_power", 4).alias("band_power"))


@query(
    f"""WITH {EM}, h AS (SELECT a.ch, a.ti, sum(b.v * CASE WHEN (a.ti - b.ti) % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE 2.0 / 64 / tan({TAU} / 2 * (a.ti - b.ti) / 64) END) AS im, max(a.v) AS re
    FROM em a JOIN em b ON b.ch = a.ch GROUP BY a.ch, a.ti)
    SELECT CAST(ch AS BIGINT) AS ch, CAST(ti AS BIGINT) AS ti, {r("sqrt(re * re + im * im)")} AS v FROM h"""
)
def hilbert_envelope(spark: SparkSession, d: str) -> DataFrame:
    return _out(spectral.envelope(em(spark, d)))


def _wave(way: str, bin: str, at: str, n: str) -> tuple[str, str]:
    """cos and sin of a bin's turn."""
    a = f"{way}{TAU} * (({bin} * {at}) % {n}) / {n}"
    return f"cos({a})", f"sin({a})"


(C1, S1), (C2, S2), (C3, S3), (C4, S4) = _wave("-", "f.a", "ti", "64"), _wave("-", "k.a", "ch", "c.n"), _wave("", "ki", "c.a", "c.n"), _wave("", "fi", "t.a", "64")
#: The plane of all channels of EM; c has a row per channel, with the number of them.
FK = f"""{EM}, i64 AS (SELECT i AS a FROM unnest(range(0, 64)) AS x(i)), c AS (SELECT unnest(range(0, n)) AS a, n FROM (SELECT max(ch) + 1 AS n FROM em)),
    t1 AS (SELECT em.ch, f.a AS fi, sum(v * {C1}) AS re, sum(v * {S1}) AS im FROM em CROSS JOIN i64 f GROUP BY em.ch, f.a),
    t2 AS (SELECT fi, k.a AS ki, k.n, sum(re * {C2.replace("c.n", "k.n")} - im * {S2.replace("c.n", "k.n")}) AS re, sum(re * {S2.replace("c.n", "k.n")} + im * {C2.replace("c.n", "k.n")}) AS im FROM t1 CROSS JOIN c k GROUP BY fi, k.a, k.n),
    fk AS (SELECT fi, ki, CASE WHEN fi < 32 THEN fi ELSE fi - 64 END * CAST(100 AS DOUBLE) / 64 AS freq, CASE WHEN ki < (n + 1) // 2 THEN ki ELSE ki - n END / CAST(1 AS DOUBLE) / n AS wavenumber, re, im FROM t2)"""


@query(f"WITH {FK} SELECT CAST(fi AS INTEGER) AS fi, CAST(ki AS INTEGER) AS ki, {r('freq')} AS freq, {r('wavenumber')} AS wavenumber, {r('re')} AS re, {r('im')} AS im FROM fk")
def fk_transform(spark: SparkSession, d: str) -> DataFrame:
    return spectral.fk_transform(em(spark, d), FS).select("fi", "ki", *[rounded(c).alias(c) for c in ("freq", "wavenumber", "re", "im")])


@query(
    f"""WITH {FK}, kept AS (SELECT fi, ki, re, im FROM fk WHERE CASE WHEN wavenumber = 0 THEN freq = 0 ELSE abs(freq / wavenumber) >= 50 AND abs(freq / wavenumber) <= 800 END),
    b1 AS (SELECT fi, c.a AS ch, sum(re * {C3} - im * {S3}) / c.n AS re, sum(re * {S3} + im * {C3}) / c.n AS im FROM kept CROSS JOIN c GROUP BY fi, c.a, c.n)
    SELECT CAST(ch AS BIGINT) AS ch, CAST(t.a AS BIGINT) AS ti, {r(f"sum(re * {C4} - im * {S4}) / 64")} AS v FROM b1 CROSS JOIN i64 t GROUP BY ch, t.a"""
)
def fk_filter(spark: SparkSession, d: str) -> DataFrame:
    return _out(spectral.fk_filter(em(spark, d), FS, 50.0, 800.0))


# --- filters: the recursion as a recursive query, a pass of each section forward and one backward


def _zero_phase(sos, source: str = "em", mark: str = "") -> tuple[list[str], str]:
    """The CTEs of a zero-phase filter of a dense source of 64 samples, and a query of its ch, ti, v: odd extension, then every section in both directions."""
    pad, n = dsp.padding(sos), 64
    total = n + 2 * pad
    parts = [
        f"x{mark} AS (SELECT ch, p.i AS i, CASE WHEN p.i < {pad} THEN 2 * max(CASE WHEN ti = 0 THEN v END) - max(CASE WHEN ti = {pad} - p.i THEN v END)"
        f" WHEN p.i >= {pad + n} THEN 2 * max(CASE WHEN ti = {n - 1} THEN v END) - max(CASE WHEN ti = {2 * n - 2 + pad} - p.i THEN v END) ELSE max(CASE WHEN ti = p.i - {pad} THEN v END) END AS v"
        f" FROM {source} CROSS JOIN (SELECT i FROM unnest(range(0, {total})) AS q(i)) p GROUP BY ch, p.i)",
    ]
    start, last = dsp.steady_state(sos), f"x{mark}"
    lit = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    for way in range(2):
        first = f"f{mark}{way}"
        parts.append(f"{first} AS (SELECT ch, v AS v0 FROM {last} WHERE i = 0)")
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            name = f"s{mark}{way}_{k}"
            y = f"{lit(b0)} * x.v + {{1}}"
            init = [f"{lit(z)} * f.v0" for z in start[k]]
            y0 = y.replace("{1}", init[0])
            y1 = y.replace("{1}", "r.s1")
            nxt = lambda yy, s2: (f"{lit(b1)} * x.v - {lit(a1)} * ({yy}) + {s2}", f"{lit(b2)} * x.v - {lit(a2)} * ({yy})")
            p, q = nxt(y0, init[1]), nxt(y1, "r.s2")
            parts.append(
                f"{name} AS (SELECT x.ch, x.i, {y0} AS v, {p[0]} AS s1, {p[1]} AS s2 FROM {last} x JOIN {first} f ON f.ch = x.ch WHERE x.i = 0"
                f" UNION ALL SELECT x.ch, x.i, {y1}, {q[0]}, {q[1]} FROM {name} r JOIN {last} x ON x.ch = r.ch AND x.i = r.i + 1)"
            )
            last = name
        parts.append(f"rev{mark}{way} AS (SELECT ch, {total - 1} - i AS i, v FROM {last})")
        last = f"rev{mark}{way}"
    return parts, f"SELECT CAST(ch AS BIGINT) AS ch, CAST(i - {pad} AS BIGINT) AS ti, v FROM {last} WHERE i >= {pad} AND i < {pad + n}"


def _recursive(sos, value: str = "v", source: str = "em", before: str = "", digits: int = 6) -> str:
    parts, rows = _zero_phase(sos, source)
    return f"WITH RECURSIVE {', '.join([EM, *([before] if before else []), *parts])}, z AS ({rows}) SELECT ch, ti, {r(value, digits)} AS v FROM z"


@query(_recursive(dsp.butter_sos(4, 20.0, "lowpass", FS)))
def lowpass(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.lowpass(em(spark, d), FS, 20.0))


@query(_recursive(dsp.butter_sos(4, 10.0, "highpass", FS)))
def highpass(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.highpass(em(spark, d), FS, 10.0))


@query(_recursive(dsp.butter_sos(4, (10.0, 30.0), "bandpass", FS)))
def bandpass(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.bandpass(em(spark, d), FS, 10.0, 30.0))


@query(_recursive(dsp.butter_sos(2, (20.0, 30.0), "bandstop", FS)))
def bandstop(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.bandstop(em(spark, d), FS, 20.0, 30.0, 2))


@query(_recursive(dsp.notch_sos(25.0, 5.0, FS)))
def notch(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.notch(em(spark, d), FS, 25.0, 5.0))


HIGH = dsp.butter_sos(4, 5.0, "highpass", FS)
CENTRED = "v - avg(v) OVER (PARTITION BY ch)"


@query(_recursive(HIGH, CENTRED))
def process_differential(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.process_differential(em(spark, d), FS, 5.0))


@query(_recursive(HIGH, CENTRED, "summed", "summed AS (SELECT ch, ti, sum(v) OVER (PARTITION BY ch ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM em)"))
def integrate_data(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.integrate_data(em(spark, d), FS, 5.0))


def _response(freqs: tuple[float, ...]) -> str:
    """Per frequency the channel of highest RMS in a band of 5 % either side."""
    parts, best = [EM], []
    for i, f in enumerate(freqs):
        more, rows = _zero_phase(dsp.butter_sos(4, (0.95 * f, 1.05 * f), "bandpass", FS), "em", f"b{i}_")
        parts += [*more, f"l{i} AS (SELECT ch, sqrt(avg(v * v)) AS rms FROM ({rows}) GROUP BY ch)"]
        best.append(f"(SELECT CAST({f!r} AS DOUBLE) AS freq, ch, {r('rms')} AS rms FROM l{i} ORDER BY l{i}.rms DESC, ch LIMIT 1)")
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(best)}"


@query(_response((10.0, 20.0, 30.0)))
def freq_response(spark: SparkSession, d: str) -> DataFrame:
    return spectral.frequency_response(em(spark, d), FS, [10.0, 20.0, 30.0]).select("freq", "ch", rounded("rms").alias("rms"))


# --- events

RUNS = "o AS (SELECT *, ti - row_number() OVER (ORDER BY ti) AS g FROM z), i AS (SELECT min(ti) AS a, max(ti) AS b, min(lo) AS lo, max(hi) AS hi, max(peak) AS peak FROM o GROUP BY g)"


@query(
    f"WITH {EG}, z AS (SELECT ti, min(ch) AS lo, max(ch) AS hi, max(abs(v)) AS peak FROM eg WHERE abs(v) > 400 GROUP BY ti), {RUNS}"
    " SELECT 'evt_0_' || CAST(row_number() OVER (ORDER BY a) - 1 AS VARCHAR) AS id, CAST(a * 10000 AS BIGINT) AS start_us, CAST(b * 10000 AS BIGINT) AS end_us, CAST(lo AS BIGINT) AS min_channel, CAST(hi AS BIGINT) AS max_channel, CAST(1 AS DOUBLE) AS confidence, 'trigger' AS event_type FROM i"
)
def trigger_events(spark: SparkSession, d: str) -> DataFrame:
    e = detect.trigger_events(eg(spark, d), 400.0, FS)
    return e.select("id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "min_channel", "max_channel", "confidence", "event_type")


@query(
    f"""WITH {EG}, m AS (SELECT ti, sqrt(avg(v * v)) AS rms FROM eg GROUP BY ti), b AS (SELECT ti, 20 * log10(rms / (SELECT max(rms) FROM m) + CAST(1e-10 AS DOUBLE)) AS db FROM m),
    z AS (SELECT ti, 0 AS lo, 0 AS hi, db AS peak FROM b WHERE db > -8), {RUNS}
    SELECT {r("a / CAST(100 AS DOUBLE)")} AS start_s, {r("(b + 1) / CAST(100 AS DOUBLE)")} AS end_s, {r("(b + 1 - a) * CAST(10 AS DOUBLE)")} AS duration_ms, {r("peak")} AS peak_db
    FROM i, len WHERE b + 1 - a >= 2 AND b < n - 1 ORDER BY a LIMIT 20"""
)
def rms_events(spark: SparkSession, d: str) -> DataFrame:
    e = detect.rms_events(eg(spark, d), FS, -8.0, 20.0)
    return e.select(*[rounded(c).alias(c) for c in ("start_s", "end_s", "duration_ms", "peak_db")])


@query(
    f"WITH {EG}, z AS (SELECT ti, min(ch) AS lo, max(ch) AS hi, max(abs(v)) AS peak FROM eg WHERE abs(v) > 400 GROUP BY ti), {RUNS}"
    " SELECT CAST(a * 10000 AS BIGINT) AS start_us, CAST(lo AS BIGINT) AS min_channel FROM i WHERE a * 10000 < 5000000 AND b * 10000 > 1000000 AND hi >= 2"
)
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    e = detect.overlapping(detect.trigger_events(eg(spark, d), 400.0, FS), "1970-01-01 00:00:01", "1970-01-01 00:00:05").filter("max_channel >= 2")
    return e.select(F.unix_micros("start_time").alias("start_us"), "min_channel")


@query(
    f"""WITH {EM}, e AS (SELECT ch, avg(v * v) AS e FROM em GROUP BY ch), m AS (SELECT CASE WHEN median(e) > 0 THEN median(e) ELSE CAST(1e-10 AS DOUBLE) END AS m, count(*) AS n FROM e),
    z AS (SELECT ch, ti, v, 64 AS n FROM em WHERE ch = (SELECT CAST(floor(n / 2) AS BIGINT) FROM m)), f AS ({_dft("z", "ch", "ti", "n", 33)}), s AS (SELECT k * CAST(100 AS DOUBLE) / 64 AS freq, sqrt(re * re + im * im) AS mag FROM f),
    h AS (SELECT coalesce(max(CASE WHEN abs(freq - 50) <= 1 THEN mag END), CAST(0 AS DOUBLE)) AS p50, coalesce(max(CASE WHEN abs(freq - 60) <= 1 THEN mag END), CAST(0 AS DOUBLE)) AS p60, median(mag) AS bg, max(mag) AS peak FROM s),
    w AS (SELECT avg(v) AS mean, stddev_pop(v) AS std, max(abs(v)) AS top, sqrt(avg(v * v)) AS rms FROM em)
    SELECT (SELECT count(*) FROM e, m WHERE e > 100 * m OR e < CAST(0.01 AS DOUBLE) * m) AS bad_channels, (SELECT count(*) FROM e, m WHERE e < CAST(0.01 AS DOUBLE) * m) AS dead_channels, p50 > 10 * bg AS has_50hz, p60 > 10 * bg AS has_60hz, abs(mean) > CAST(0.1 AS DOUBLE) * std AS has_trend,
    {r("(SELECT avg(CASE WHEN abs(v) >= CAST(0.99 AS DOUBLE) * top THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FROM em, w)")} AS clipping_ratio, {r("rms")} AS rms_level, {r("20 * log10(bg + CAST(1e-10 AS DOUBLE))")} AS noise_floor_db, {r("20 * log10(peak / bg)")} AS snr_db FROM h, w"""
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    q = detect.quality_report(em(spark, d), FS)
    return q.select(F.size("bad_channels").cast("long").alias("bad_channels"), "dead_channels", "has_50hz", "has_60hz", "has_trend", *[rounded(c).alias(c) for c in ("clipping_ratio", "rms_level", "noise_floor_db", "snr_db")])


# --- the file index


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderdate + INTERVAL 1 DAY > TIMESTAMP '1995-06-01'")
def spool_overlap(spark: SparkSession, d: str) -> DataFrame:
    return spool.overlap(ix(spark, d), "1995-06-01", "1996-01-01").select("path")


@query("SELECT o_orderkey AS path, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def spool_attrs(spark: SparkSession, d: str) -> DataFrame:
    return spool.having(ix(spark, d), status="O", priority="1-URGENT").select("path", F.element_at("attrs", F.lit("status")).alias("status"))


@query("SELECT o_orderkey AS path FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01')")
def spool_incremental(spark: SparkSession, d: str) -> DataFrame:
    index = ix(spark, d)
    return spool.unseen(index.select("path"), index.filter(F.col("start_time") < F.to_timestamp(F.lit("1996-01-01")))).select("path")


@query(
    """WITH o AS (SELECT o_orderkey AS path, coalesce(sum(o_orderkey % 7 + 1) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM orders)
    SELECT CAST(l_linenumber AS BIGINT) AS ch, CAST(l_suppkey + off AS BIGINT) AS ti, l_quantity AS v FROM lineitem JOIN o ON l_orderkey = path"""
)
def spool_concat(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("ch"), F.col("l_suppkey").alias("ti"), F.col("l_quantity").alias("v"))
    return spool.concat(rows, ix(spark, d)).select("ch", F.col("ti").cast("long").alias("ti"), "v")


@query(_long(EM, "(SELECT ch, ti, v, CAST(w.w AS BIGINT) AS w FROM em CROSS JOIN (SELECT i AS w FROM unnest(range(0, 10)) AS g(i)) w WHERE ti BETWEEN w.w * 7 AND w.w * 7 + 9)", "v").replace("AS v FROM (", "AS v, w AS chunk FROM ("))
def spool_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of ten samples that share three; the last one is short."""
    c = spool.chunks(em(spark, d), 10, 3)
    return c.select(F.col("ch").cast("long").alias("ch"), "ti", rounded("v").alias("v"), F.col("chunk").cast("long").alias("chunk"))


# --- what streams give, on the batch


@query(_long(EV, "ev", "v", "QUALIFY ti > max(ti) OVER (PARTITION BY ch) - 20"))
def ring_view(spark: SparkSession, d: str) -> DataFrame:
    return _out(stateful.view(ev(spark, d), 20))


@query(
    """WITH h AS (SELECT user_id AS ch, ts, value AS v FROM events WHERE abs(value) > 80), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new FROM h),
    s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g)
    SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) + 300000000 AS BIGINT) AS end_us, min(ch) AS min_channel, max(ch) AS max_channel, count(*) AS n, max(abs(v)) AS peak FROM s GROUP BY s.s"""
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("ch"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("v"))
    s = stateful.trigger_sessions(rows, 80.0, "300 seconds")
    return s.select(F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "min_channel", "max_channel", "n", "peak")


def _causal(sos) -> str:
    """SQL of one forward pass over EM from the sections' steady state."""
    parts, last = [EM], "em"
    lit = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    for k, ((b0, b1, b2, _, a1, a2), (z1, z2)) in enumerate(zip(sos, dsp.steady_state(sos), strict=True)):
        first, later = f"{lit(b0)} * x.v + {lit(z1)}", f"{lit(b0)} * x.v + r.s1"
        state = lambda y, s2: f"{lit(b1)} * x.v - {lit(a1)} * ({y}) + {s2}, {lit(b2)} * x.v - {lit(a2)} * ({y})"
        parts.append(
            f"c{k}(ch, ti, v, s1, s2) AS (SELECT x.ch, x.ti, {first}, {state(first, lit(z2))} FROM {last} x WHERE x.ti = 0"
            f" UNION ALL SELECT x.ch, x.ti, {later}, {state(later, 'r.s2')} FROM c{k} r JOIN {last} x ON x.ch = r.ch AND x.ti = r.ti + 1)"
        )
        last = f"c{k}"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT CAST(ch AS BIGINT) AS ch, CAST(ti AS BIGINT) AS ti, {r('v')} AS v FROM {last}"


@query(_causal(dsp.butter_sos(4, 20.0, "lowpass", FS)))
def stream_sos(spark: SparkSession, d: str) -> DataFrame:
    return _out(filters.causal(em(spark, d), dsp.butter_sos(4, 20.0, "lowpass", FS)))


@query(
    f"""WITH {EG}, c AS (SELECT ch, ti - seg * 16 AS j, seg, v FROM eg CROSS JOIN (SELECT unnest(range(0, (n - 16) // 16)) AS seg FROM len) g WHERE ti - seg * 16 BETWEEN 0 AND 31),
    w AS (SELECT ch, seg, j, v * (CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos({TAU} * j / 31)) AS v, 64 AS n FROM c), f AS ({_dft("w", "ch, seg", "j", "n", 33)}), h AS (SELECT sum((CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos({TAU} * i / 31)) * (CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos({TAU} * i / 31))) AS s FROM unnest(range(0, 32)) AS q(i))
    SELECT CAST(ch AS BIGINT) AS ch, CAST(k AS BIGINT) AS k, {r("k * CAST(100 AS DOUBLE) / 64")} AS freq, {r("avg(re * re + im * im) * 2 / (100 * max(h.s))", 4)} AS psd FROM f, h GROUP BY ch, k"""
)
def psd(spark: SparkSession, d: str) -> DataFrame:
    return spectral.psd(eg(spark, d), FS, 32, 16).select("ch", "k", rounded("freq").alias("freq"), rounded("psd", 4).alias("psd"))


@query(
    f"WITH {FK}, m AS (SELECT fi, ki, 20 * log10(sqrt(re * re + im * im) + CAST(1e-12 AS DOUBLE)) AS db FROM fk) SELECT CAST(fi AS INTEGER) AS fi, CAST(ki AS INTEGER) AS ki, {r('db - (SELECT max(db) FROM m)', 4)} AS db FROM m"
)
def fk_db(spark: SparkSession, d: str) -> DataFrame:
    plane = spectral.fk_transform(em(spark, d), FS).withColumn("db", spectral.to_db(F.hypot("re", "im"), 20.0))
    return plane.crossJoin(F.broadcast(plane.agg(F.max("db").alias("top")))).select("fi", "ki", rounded(F.col("db") - F.col("top"), 4).alias("db"))


# --- units and times


@query(f"WITH {EV} SELECT ch, CAST(ti AS BIGINT) AS ti, {r(f'v * CAST({units.phase_scale()!r} AS DOUBLE) * CAST(1e9 AS DOUBLE)', 4)} AS v FROM ev")
def units_convert(spark: SparkSession, d: str) -> DataFrame:
    return _out(pointwise.scale(pointwise.scale(ev(spark, d), units.phase_scale()), units.factor("strain", "nanostrain")), 4)


@query("SELECT event_id, CAST(round((event_id % 90 + 0.5) * 1000000) AS BIGINT) AS ns, CAST(event_id * 1000000 AS BIGINT) AS us FROM events")
def time_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id")
    text = F.concat((F.col("event_id") % 90).cast("string"), F.lit(".5ms"))
    seconds = F.unix_micros(timeutil.time_column(F.col("event_id"), "number"))
    return e.select("event_id", (timeutil.nanos_column(text)).alias("ns"), seconds.alias("us"))


# --- the flagship: detrend, normalise, detect, catalogue

PIPE = f"""WITH {EV}, d AS (SELECT ch, ti, {_line("ch", "ti")} AS v FROM ev), m AS (SELECT ch, min(v) AS lo, max(v) - min(v) AS span FROM d GROUP BY ch),
    n AS (SELECT d.ch, d.ti, 2 * (d.v - m.lo) / CASE WHEN m.span = 0 THEN CAST(1 AS DOUBLE) ELSE m.span END - 1 AS v FROM d JOIN m ON m.ch = d.ch),
    z AS (SELECT ti, min(ch) AS lo, max(ch) AS hi, max(abs(v)) AS peak FROM n WHERE abs(v) > CAST(0.999999 AS DOUBLE) GROUP BY ti), {RUNS}"""


@query(f"{PIPE} SELECT 'evt_0_' || CAST(row_number() OVER (ORDER BY a) - 1 AS VARCHAR) AS id, CAST(a * 10000 AS BIGINT) AS start_us, CAST(b * 10000 AS BIGINT) AS end_us, lo AS min_channel, hi AS max_channel FROM i")
def pipeline_trigger(spark: SparkSession, d: str) -> DataFrame:
    e = detect.trigger_events(pointwise.normalize(pointwise.detrend(ev(spark, d))), 0.999999, FS)
    return e.select("id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "min_channel", "max_channel")


def sensor_chain(df: DataFrame, factor: float = 2.0) -> DataFrame:
    """detrend, abs, scale."""
    return pointwise.scale(pointwise.absolute(pointwise.detrend(df)), factor)


from strataline import queries_files  # noqa: E402, F401 - adds the queries over files, chains and streams
