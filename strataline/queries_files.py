"""Queries over files that they write and read again, over streams, sessions and models, with their SQL.

The signals are those of ``queries``. Files and checkpoints go to the shared folder.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.frame import SignalFrame
from strataline.functions import dsp
from strataline.operators import detect, spectral
from strataline.plans import chains, models
from strataline.queries import EM, FS, ORACLES, TAU, _causal, _line, _long, _out, _power, _recursive, query, r, rounded
from strataline.scratch import Folder
from strataline.sources import arrays, catalog, formats, parts, spool, synthetic
from strataline.sources.tables import eg, em, table
from strataline.streaming import stateful


def _frame(spark: SparkSession, d: str) -> SignalFrame:
    return SignalFrame(em(spark, d), FS)


# --- files: the values are read as they were written

COUNTS = "floor(v * 1000) * pi() / 8192"


def _dat(first: int, x: np.ndarray) -> bytes:
    """Values in thousandths as flat integers."""
    return np.floor(x * 1000).astype("<i2").tobytes()


@query(_long(EM, "em", COUNTS))
def dat_read(spark: SparkSession, d: str) -> DataFrame:
    rows, n, c = parts.shaped(em(spark, d))
    path = f"{Folder(spark, 'dat').path}/a.dat"
    parts.write(parts.by_time(rows, c), [path], n * c, n * c, _dat)
    return _out(formats.read(spark, path, n_channels=c, fs=FS).df)


@query(_long(EM, "em", "v", digits=9))
def segy_read(spark: SparkSession, d: str) -> DataFrame:
    rows, n, c = parts.shaped(em(spark, d))
    path = f"{Folder(spark, 'segy').path}/a.sgy"
    parts.write(parts.by_channel(rows, n), [path], n * c, n * c, partial(_segy, n), unit=n, head=partial(_segy_head, n))
    return _out(formats.read(spark, path).df, 9)


def _segy(n: int, first: int, x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x.reshape(-1, n), ">f4").view("u1")
    return np.hstack((np.zeros((len(x), 240), "u1"), x)).tobytes()


def _segy_head(n: int) -> Iterator[bytes]:
    head = bytearray(3600)
    struct.pack_into(">H", head, 3216, 10_000)
    struct.pack_into(">H", head, 3220, n)
    struct.pack_into(">h", head, 3224, 5)
    yield bytes(head)


@query(_long(EM, "em", "v", digits=9))
def zarr_write_read(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Folder(spark, 'zarr').path}/a.zarr"
    arrays.write_zarr(_frame(spark, d), path, 20, 50)
    return _out(formats.read(spark, path).df, 9)


@query(_long(EM, "em", "v", digits=9))
def netcdf_write_read(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Folder(spark, 'netcdf').path}/a.nc"
    arrays.write_netcdf(_frame(spark, d), path)
    return _out(formats.read(spark, path).df, 9)


@query(_long(EM, "em", "v", digits=9))
def tdms_read(spark: SparkSession, d: str) -> DataFrame:
    """One segment of contiguous channels."""
    rows, n, c = parts.shaped(em(spark, d))
    path = f"{Folder(spark, 'tdms').path}/a.tdms"
    parts.write(parts.by_channel(rows, n), [path], n * c, n * c, _doubles, head=partial(_tdms_head, n, c))
    return _out(formats.read(spark, path).df, 9)


def _doubles(first: int, x: np.ndarray) -> bytes:
    return x.astype("<f8").tobytes()


def _tdms_head(n: int, c: int) -> Iterator[bytes]:
    text = lambda s: struct.pack("<I", len(s)) + s.encode()
    values = struct.pack("<IIIQI", 20, 10, 1, n, 0)
    size = 4 + sum(len(text(f"/'g'/'c{i}'")) + len(values) for i in range(c))
    yield b"TDSm" + struct.pack("<IIQQ", 0x0E, 4713, size + 8 * n * c, size) + struct.pack("<I", c)
    for i in range(0, c, 1 << 14):
        yield b"".join(text(f"/'g'/'c{j}'") + values for j in range(i, min(i + (1 << 14), c)))


@query(_long(EM, "em", "v", digits=9))
def miniseed_read(spark: SparkSession, d: str) -> DataFrame:
    """Records of 120 doubles for each channel; the channels' codes are in their order."""
    rows, n, c = parts.shaped(em(spark, d))
    path = f"{Folder(spark, 'miniseed').path}/a.mseed"
    parts.write(parts.by_channel(rows, n), [path], n * c, n * c, partial(_mseed, n), unit=n)
    return _out(formats.read(spark, path).df, 9)


def _mseed(n: int, first: int, x: np.ndarray) -> bytes:
    """Channels of n samples, from the one that begins at a place on."""
    x = x.reshape(-1, n)
    head = bytearray(64)
    head[:20] = b"000001D ".ljust(15) + b"BHZ  "
    struct.pack_into(">HHBBBBHHhh", head, 20, 2024, 1, 0, 0, 0, 0, 0, 0, int(FS), 1)
    head[39] = 1
    struct.pack_into(">HHHHBBBB", head, 44, 64, 48, 1000, 0, 5, 1, 10, 0)
    records = -(-n // 120)
    out = np.zeros((len(x), records, 1024), "u1")
    out[:, :, :64] = np.frombuffer(head, "u1")
    # channel numbers to the base of 36, in the codes of network and station
    number = first // n + np.arange(len(x))
    digits = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u1")[number[:, None] // 36 ** np.arange(6, -1, -1) % 36]
    out[:, :, 18:20], out[:, :, 8:13] = digits[:, None, :2], digits[:, None, 2:]
    for r in range(records):
        y = x[:, 120 * r : 120 * r + 120]
        ticks = round(120 * r / FS * 10_000)
        seconds = ticks // 10_000
        when = struct.pack(">HBBBBHH", 1 + seconds // 86_400, seconds // 3600 % 24, seconds // 60 % 60, seconds % 60, 0, ticks % 10_000, y.shape[1])
        out[:, r, 22:32] = np.frombuffer(when, "u1")
        out[:, r, 64 : 64 + 8 * y.shape[1]] = np.ascontiguousarray(y, ">f8").view("u1")
    return out.tobytes()


@query(_long(EM, "em", "v", digits=9))
def parquet_write_read(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Folder(spark, 'parquet').path}/a"
    _frame(spark, d).write(path)
    return _out(formats.read(spark, path, fs=FS).df, 9)


@query(_long(EM, "em", "v", digits=9))
def array_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Collected to an array, and a frame made of it again."""
    return _out(SignalFrame.from_array(spark, _frame(spark, d).collect(), FS).df, 9)


def _four_files(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """EM as four files that follow one another: their index."""
    rows, n, c = parts.shaped(em(spark, d))
    folder = Folder(spark, "spool").path
    parts.write(parts.by_time(rows, c), [f"{folder}/{i}.dat" for i in range(4)], min(n, 64) * c, 16 * c, _dat)
    listing = spark.createDataFrame([(p,) for p in spool.resolve(folder, spark)], "path string")
    return formats.scans(listing, n_channels=c, fs=FS), c


@query(f"WITH {EM}, n AS (SELECT count(DISTINCT ch) AS n FROM em) SELECT CAST(i AS VARCHAR) || '.dat' AS name, 'DAT' AS format_name, CAST(16 AS BIGINT) AS n_samples, CAST(n AS INTEGER) AS n_channels, CAST(100 AS DOUBLE) AS sampling_rate, CAST(32 * n AS BIGINT) AS file_size, 'rad/s' AS data_unit FROM n, unnest(range(0, 4)) AS f(i)")
def scan_index(spark: SparkSession, d: str) -> DataFrame:
    """What scans of a folder's files give."""
    index, _ = _four_files(spark, d)
    return index.select(F.element_at(F.split("path", "/"), -1).alias("name"), "format_name", "n_samples", "n_channels", "sampling_rate", "file_size", "data_unit")


@query(_long(EM, "em", COUNTS))
def spool_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of an index as one frame, in one plan."""
    index, n = _four_files(spark, d)
    return _out(spool.to_frame(spark, index, n_channels=n).df)


@query(f"WITH {EM} SELECT CAST(i AS VARCHAR) || '.dat' AS name, CAST(count(DISTINCT ch) AS VARCHAR) AS channels FROM em, unnest(range(0, 4)) AS f(i) GROUP BY i")
def spool_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files selected by a field of the inventories that the scans made."""
    index, n = _four_files(spark, d)
    found = spool.having(index, n_channels=n, data_unit="rad/s")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.get_json_object("inventory", "$.acquisition.n_channels").alias("channels"))


@query(ORACLES["trigger_events"])
def catalog_csv(spark: SparkSession, d: str) -> DataFrame:
    """The events, written as CSV and read back."""
    path = f"{Folder(spark, 'catalog').path}/events"
    catalog.write_csv(detect.trigger_events(eg(spark, d), 400.0, FS), path)
    e = catalog.read_csv(spark, path)
    return e.select("id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "min_channel", "max_channel", "confidence", "event_type")


# --- chains, sessions, models

LINED = f"lined AS (SELECT ch, ti, {_line('ch', 'ti')} AS v FROM em)"
ZSCORE = "abs((v - avg(v) OVER (PARTITION BY ch)) / stddev_pop(v) OVER (PARTITION BY ch))"


@query(_recursive(dsp.butter_sos(4, 1.0, "highpass", FS), "v", "lined", LINED))
def recipe_denoise(spark: SparkSession, d: str) -> DataFrame:
    return _out(chains.clean(_frame(spark, d), "standard_denoise").df)


@query(_recursive(dsp.butter_sos(4, (10.0, 30.0), "bandpass", FS), ZSCORE, "lined", LINED))
def process_line(spark: SparkSession, d: str) -> DataFrame:
    return _out(chains.process(_frame(spark, d), chains.parse("detrend | bandpass low=10 high=30 | normalize method=zscore | abs")).df)


@query(f"WITH {EM} SELECT CAST(ch AS BIGINT) AS ch, {r('avg(abs(v))')} AS mean FROM em GROUP BY ch")
def session_sql(spark: SparkSession, d: str) -> DataFrame:
    """A stored and processed frame, asked by SQL."""
    session = chains.Session()
    name = session.process(session.store(_frame(spark, d)), [{"op": "abs"}])
    return spark.sql(f"SELECT ch, round(avg(v), 6) + 0D AS mean FROM {name} GROUP BY ch")


def _two(x: np.ndarray) -> np.ndarray:
    return np.stack((x.mean(1), x.max(1)), 1)


@query(f"WITH {EM} SELECT CAST(ch AS BIGINT) AS ch, {r('2 * avg(v)')} AS mean, {r('2 * max(v)')} AS top FROM em GROUP BY ch")
def model_predict(spark: SparkSession, d: str) -> DataFrame:
    """A model with a step before it."""
    out = _frame(spark, d).predict(_two, before=lambda x: 2 * x)
    return out.select("ch", rounded(F.col("output")[0]).alias("mean"), rounded(F.col("output")[1]).alias("top"))


@query(f"WITH {EM}, o AS (SELECT ch, avg(v) AS a, max(v) AS b FROM em GROUP BY ch) SELECT CAST(1 AS BIGINT) AS class, count(*) AS n, {r('min(a)')} AS least, {r('max(b)')} AS greatest FROM o")
def inference_summary(spark: SparkSession, d: str) -> DataFrame:
    s = models.summary(_frame(spark, d).predict(_two))
    return s.select(F.col("class").cast("long").alias("class"), "n", rounded("least").alias("least"), rounded("greatest").alias("greatest"))


# --- frames

@query(f"WITH {EM} SELECT CAST(ch AS BIGINT) AS ch, CAST(ti AS BIGINT) AS ti, CAST(trunc(v * 100) AS INTEGER) AS v FROM em")
def astype_int(spark: SparkSession, d: str) -> DataFrame:
    return _frame(spark, d).scale(100.0).astype("int").df.select("ch", "ti", "v")


@query(f"SELECT CAST(c AS BIGINT) AS ch, CAST(i AS BIGINT) AS ti, {r(f'2 * sin({TAU} * 50 * (i / CAST(1000 AS DOUBLE)))')} AS v FROM unnest(range(0, 400)) AS t(i), unnest(range(0, 6)) AS h(c)")
def synthetic_sine(spark: SparkSession, d: str) -> DataFrame:
    return _out(synthetic.sine(spark, 400, 6, 1000.0, 50.0, 2.0).df)


@query(f"{_power('64', '32')} SELECT CAST(ch AS BIGINT) AS ch, CAST(seg AS BIGINT) AS seg, CAST(k AS BIGINT) AS k, {r('freq')} AS freq, {r('(seg * 32 + 32) / CAST(100 AS DOUBLE)')} AS t, {r('least(10 * log10(power + CAST(1e-12 AS DOUBLE)), 60)', 4)} AS db FROM p")
def spectrogram_db(spark: SparkSession, d: str) -> DataFrame:
    s = spectral.spectrogram(eg(spark, d), FS, 64, 32, db=True, high=60.0)
    return s.select("ch", "seg", "k", rounded("freq").alias("freq"), rounded("t").alias("t"), rounded("power", 4).alias("db"))


@query(
    f"{_power('64', '32')}, q AS (SELECT *, lag(power) OVER (PARTITION BY ch ORDER BY k) AS l, lead(power) OVER (PARTITION BY ch ORDER BY k) AS n FROM a),"
    f" o AS (SELECT ch, freq, power, row_number() OVER (PARTITION BY ch ORDER BY power DESC, k DESC) AS rank FROM q WHERE power > l AND power > n)"
    f" SELECT CAST(ch AS BIGINT) AS ch, {r('max(CASE WHEN rank = 1 THEN freq END)')} AS freq, {r('max(power)', 4)} AS power, CAST(count(*) AS INTEGER) AS n, {r('sum(freq)')} AS freqs FROM o WHERE rank <= 5 GROUP BY ch"
)
def dominant_peaks(spark: SparkSession, d: str) -> DataFrame:
    s = spectral.dominant(spectral.spectrum(eg(spark, d), FS, 64))
    total = F.aggregate("freqs", F.lit(0.0), lambda a, x: a + x)
    return s.select("ch", rounded("freq").alias("freq"), rounded("power", 4).alias("power"), F.size("freqs").alias("n"), rounded(total).alias("freqs"))


@query(
    f"SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS start_us, max(abs(value)) AS peak, {r('sqrt(avg(value * value))')} AS rms, {r('quantile_cont(abs(value), 0.995)')} AS p99_5, count(value) AS n,"
    " CAST(count(CASE WHEN abs(value) > 80 THEN 1 END) AS BIGINT) AS n_over, CAST(count(DISTINCT CASE WHEN abs(value) > 80 THEN user_id END) AS INTEGER) AS channels_over FROM events GROUP BY 1"
)
def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("ch"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("v"))
    m = stateful.metrics(rows, "1 hour", threshold=80.0)
    return m.select(F.unix_micros("window.start").alias("start_us"), "peak", rounded("rms").alias("rms"), rounded("p99_5").alias("p99_5"), "n", "n_over", "channels_over")


# --- streams: the operators with their state, batch by batch

TASKS = "8"


def _streamed(spark: SparkSession, rows: DataFrame, name: str, operator: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All that an operator gives on rows (ch, ti, v) that come in files, as a table."""
    folder = Folder(spark, name).path
    # a batch is a range of time, in order; its files hold ranges of channels
    cut = rows.select("ch", "ti", "v").withColumn("part", F.floor(F.col("ti") / 24))
    cut.repartition("part", F.floor(F.col("ch") / (1 << 14))).sortWithinPartitions("part", "ti").write.partitionBy("part").parquet(f"{folder}/in")
    batches = sorted(x.part for x in cut.select("part").distinct().collect())
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", TASKS)
    stateful.use_rocksdb(spark)
    try:
        for part in batches:  # more files for the same stream
            spark.read.schema("ch long, ti long, v double").parquet(f"{folder}/in/part={part}").write.mode("append").parquet(f"{folder}/arrived")
            stream = spark.readStream.schema("ch long, ti long, v double").parquet(f"{folder}/arrived")
            keep = lambda batch, n: batch.write.mode("append").parquet(f"{folder}/out")
            stateful.start(operator(stream), keep, f"{folder}/checkpoint", once=True, mode=mode).awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{folder}/out")


@query(_causal(dsp.butter_sos(2, 20.0, "lowpass", FS)))
def stream_sos_state(spark: SparkSession, d: str) -> DataFrame:
    """The causal filter with its state carried from batch to batch."""
    sos = dsp.butter_sos(2, 20.0, "lowpass", FS)
    return _out(_streamed(spark, em(spark, d), "sos", lambda s: stateful.sos_stream(s, sos), "append"))


@query(_long(EM, "em", "v", "QUALIFY ti > max(ti) OVER (PARTITION BY ch) - 30"))
def stream_ring_state(spark: SparkSession, d: str) -> DataFrame:
    """What the ring buffers hold after the last batch."""
    rows = _streamed(spark, em(spark, d), "ring", lambda s: stateful.ring_stream(s, 30), "update")
    last = rows.groupBy("ch").agg(F.max_by("values", "last_ti").alias("values"), F.max_by("first_ti", "last_ti").alias("first_ti"))
    held = last.select("ch", "first_ti", F.posexplode("values").alias("i", "v"))
    return _out(held.select("ch", (F.col("first_ti") + F.col("i")).alias("ti"), "v"))

