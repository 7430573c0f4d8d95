"""Streams of samples (ch, ti, v): sources, operators that carry state from batch to batch, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strataline.functions import dsp
from strataline.sources.synthetic import noise

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State beside the heap; transformWithState needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def simulate(spark: SparkSession, fs: int = 1000, channels: int = 64, seed: int = 0) -> DataFrame:
    """An endless stream: fs samples a second of normal noise; one sample block of 50 in ten has a step of 5 on one channel."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", fs).load()
    rows = ticks.select(F.col("value").alias("ti"), "timestamp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(channels - 1).cast("long"))).alias("ch"))
    block = F.floor(F.col("ti") / 50)
    hit = (F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(10)) == 0) & (F.pmod(F.xxhash64(block, F.lit(seed + 9)), F.lit(channels)) == F.col("ch"))
    return rows.select("ch", "ti", "timestamp", (noise(seed, "ch", "ti") + F.when(hit, 5.0).otherwise(0.0)).alias("v"))


def files(spark: SparkSession, folder: str, pattern: str | None = None, per_batch: int | None = None, **options) -> DataFrame:
    """The samples of files that arrive in a folder: ch, ti, timestamp, v, path; ti counts within its file.

    Each file is read once, by one task, through its format; options are the format's. A file without a start time begins when it was written.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    source = source.option("pathGlobFilter", pattern) if pattern else source
    source = source.option("maxFilesPerTrigger", per_batch) if per_batch else source
    names = source.load(folder).select("path", F.unix_micros("modificationTime").alias("written"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import strataline.sources.arrays  # noqa: F401
        from strataline.sources.formats import FORMATS, _pieces

        for b in batches:
            for path, written in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
                found = FORMATS.scan(place, **options)
                begin = written if found.start_time is None else pd.Timestamp(found.start_time).value // 1000
                for ch, ti, v in _pieces(found.format_name, place, 0, found.n_samples, np.arange(found.n_channels), options | {"n_channels": found.n_channels}):
                    at = begin + np.round(ti.to_numpy() * (1e6 / found.sampling_rate)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([ch, ti, pa.array(at, pa.timestamp("us", "UTC")), v, pa.array([path] * len(ch), pa.string())], names=["ch", "ti", "timestamp", "v", "path"])

    return names.mapInArrow(run, "ch long, ti long, timestamp timestamp, v double, path string")


class _Sos(StatefulProcessor):
    """Causal second-order sections; each channel's section states are kept."""

    def __init__(self, sos: list[list[float]]):
        self.sos = sos

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.z = handle.getValueState("z", "z array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        sos = np.array(self.sos)
        part = pd.concat(list(rows)).sort_values("ti")
        state = np.array(self.z.get()[0]).reshape(len(sos), 2, 1) if self.z.exists() else dsp.steady_state(sos)[:, :, None]
        y, state = dsp.sos_filter(sos, part["v"].to_numpy(float)[:, None], state)
        self.z.update(([float(x) for x in state.ravel()],))
        yield pd.DataFrame({"ch": part["ch"].to_numpy(), "ti": part["ti"].to_numpy(), "v": y[:, 0]})

    def close(self) -> None:
        pass


def sos_stream(df: DataFrame, sos: np.ndarray) -> DataFrame:
    """A causal filter over a stream whose batches bring each channel's samples in order."""
    return df.groupBy("ch").transformWithStateInPandas(_Sos(np.asarray(sos).tolist()), "ch long, ti long, v double", "Append", "None")


class _Ring(StatefulProcessor):
    """The last samples of the channels of a block; their state is one row of arrays."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ch binary, ti binary, v binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows))
        ch, ti, v = part["ch"].to_numpy(np.int64), part["ti"].to_numpy(np.int64), part["v"].to_numpy(float)
        order = np.lexsort((ti, ch))
        ch, ti, v, fresh = ch[order], ti[order], v[order], np.unique(ch)
        if self.held.exists():
            old = [np.frombuffer(x, kind) for x, kind in zip(self.held.get(), ("<i8", "<i8", "<f8"), strict=True)]
            order = np.argsort(np.concatenate((old[0], ch)), kind="stable")  # a channel's new samples come after its old ones
            ch, ti, v = (np.concatenate(pair)[order] for pair in zip(old, (ch, ti, v), strict=True))
        ends = np.append(np.flatnonzero(np.diff(ch)) + 1, len(ch))
        starts = np.concatenate(([0], ends[:-1]))
        keep = np.repeat(ends, ends - starts) - np.arange(len(ch)) <= self.capacity
        ch, ti, v = ch[keep], ti[keep], v[keep]
        self.held.update((ch.astype("<i8").tobytes(), ti.astype("<i8").tobytes(), v.astype("<f8").tobytes()))
        ends = np.append(np.flatnonzero(np.diff(ch)) + 1, len(ch))
        starts = np.concatenate(([0], ends[:-1]))
        seen = np.isin(ch[starts], fresh)
        starts, ends = starts[seen], ends[seen]
        yield pd.DataFrame({"ch": ch[starts], "n": ends - starts, "first_ti": ti[starts], "last_ti": ti[ends - 1], "full": ends - starts == self.capacity, "values": [v[i:j] for i, j in zip(starts, ends, strict=True)]})

    def close(self) -> None:
        pass


def ring_stream(df: DataFrame, capacity: int) -> DataFrame:
    """After each batch, the buffer of every channel that it brought samples of: n, first_ti, last_ti, full and the values, oldest first.

    Channels share their state by blocks, of some 2**15 samples.
    """
    block = F.floor(F.col("ch") / max(1, (1 << 15) // capacity))
    rows = df.select("ch", "ti", "v", block.alias("block"))
    return rows.groupBy("block").transformWithStateInPandas(_Ring(capacity), "ch long, n int, first_ti long, last_ti long, full boolean, values array<double>", "Update", "None")


def view(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The last n samples of every channel of a batch table, without a sort of the whole channel."""
    if n is None:
        return rows
    last = rows.groupBy("ch").agg((F.max("ti") - n).alias("__after"))
    return rows.join(last, "ch").filter(F.col("ti") > F.col("__after")).drop("__after")


def trigger_sessions(df: DataFrame, threshold: float, gap: str, delay: str = "10 seconds", time: str = "timestamp", section: int = 1 << 30) -> DataFrame:
    """Events of a stream, by section of so many channels: times above the threshold, joined over gaps shorter than ``gap``."""
    over = df.filter(F.abs("v") > F.lit(float(threshold)))
    over = over.withWatermark(time, delay) if df.isStreaming else over
    found = over.groupBy(F.floor(F.col("ch") / section).alias("section"), F.session_window(time, gap)).agg(F.min("ch").alias("min_channel"), F.max("ch").alias("max_channel"), F.count("*").alias("n"), F.max(F.abs("v")).alias("peak"))
    return found.select(F.col("session_window.start").alias("start_time"), F.col("session_window.end").alias("end_time"), "min_channel", "max_channel", "n", "peak")


def metrics(df: DataFrame, width: str = "1 second", delay: str = "10 seconds", time: str = "timestamp", threshold: float = 0.0) -> DataFrame:
    """Per window of time: greatest |v|, level, 99.5th percentile of |v|, samples, and samples and channels whose |v| is above the threshold."""
    timed = df.withWatermark(time, delay) if df.isStreaming else df
    size, over = F.abs("v"), F.abs("v") > F.lit(float(threshold))
    return timed.groupBy(F.window(time, width)).agg(
        F.max(size).alias("peak"),
        F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
        F.percentile(size, F.lit(0.995)).alias("p99_5"),
        F.count("v").alias("n"),
        F.count_if(over).alias("n_over"),
        F.size(F.collect_set(F.when(over, F.col("ch")))).alias("channels_over"),
    )


def sequential(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One function that applies the steps in order."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def parallel(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], list[DataFrame]]:
    return lambda df: [df.transform(s) for s in steps]


def start(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = False, mode: str = "append") -> StreamingQuery:
    """Call back with every batch; with ``once``, until the input that is there is used up."""
    writer = df.writeStream.foreachBatch(callback).outputMode(mode)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_table(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet folder, exactly once."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
