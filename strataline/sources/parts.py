"""Files that tasks write: cells are dealt to parts by their place, parts are encoded side by side, one task for each file puts them one after the other.

Nothing passes through the driver. A task holds one part; the file itself is copied in pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.scratch import Folder

#: Cells of a part.
PART = 1 << 20
COPY = 8 << 20


def place_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows with ranks (from 0) of the column's values in its place, and the number of values."""
    found = df.select(column).distinct()
    low, high, n = found.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or (low == 0 and high == n - 1):
        return df, n
    # sorted by many tasks and kept, so that rows and tasks stay the same; a row per task meets in one
    spark = df.sparkSession
    path = Folder(spark, "ranks").path
    at = F.monotonically_increasing_id()
    found.filter(F.col(column).isNotNull()).orderBy(column).select(F.col(column).alias("__value"), F.shiftright(at, 33).alias("task"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")).write.parquet(path)
    kept = spark.read.parquet(path)
    ahead = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy("task").agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranks = kept.join(F.broadcast(before), "task").select("__value", (F.col("ahead") + F.col("row")).alias("__rank"))
    return df.join(ranks, df[column] == ranks["__value"]).withColumn(column, F.col("__rank")).drop("__value", "__rank"), n


def write(place: DataFrame, paths: list[str], total: int, per: int, encode: Callable[[int, np.ndarray], bytes], unit: int = 1, head: Callable[[], Iterator[bytes]] | None = None) -> None:
    """Cells (place, v) as files of ``per`` cells each, in order of place; cells that no row has are NaN.

    ``encode`` gives the bytes of some cells from a place on that is a multiple of ``unit``, in whole units; ``head`` what comes before them.
    """
    per, unit = max(1, per), max(1, unit)
    spark, size = place.sparkSession, max(1, PART // unit) * unit
    folder = Folder(spark, "parts")
    fs, inside = place_of(folder.path)
    fs.create_dir(inside, recursive=True)
    where = folder.path
    pieces = -(-per // size)  # of a file
    cells = lambda file: max(0, min(per, total - file * per))

    def length(key: int) -> int:
        return min(size, cells(key // pieces) - key % pieces * size)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder_ = place_of(where)
        at, x = -1, np.empty(0)

        def put() -> pa.RecordBatch:
            name = f"{folder_}/{at}.{uuid.uuid4().hex}"  # a second attempt at the task may run beside the first
            with own.open_output_stream(name) as f:
                f.write(encode(at % pieces * size, x))
            return pa.RecordBatch.from_arrays([pa.array([at // pieces], pa.int64()), pa.array([at % pieces], pa.int64()), pa.array([name])], names=["file", "piece", "name"])

        for b in batches:
            p, v = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            keys = p // per * pieces + p % per // size
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if keys[i] != at:
                    if at >= 0:
                        yield put()
                    at = int(keys[i])
                    x = np.full(length(at), np.nan)
                x[p[i:j] % per - at % pieces * size] = v[i:j]
        if at >= 0:
            yield put()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names = {r["piece"]: r["name"] for r in found or []}
                own, out = place_of(paths[file])
                own.create_dir(out.rsplit("/", 1)[0], recursive=True)
                made_ = f"{out}.{uuid.uuid4().hex}"
                with own.open_output_stream(made_) as f:
                    for raw in head() if head else ():
                        f.write(raw)
                    for i in range(-(-cells(file) // size)):
                        if i not in names:
                            f.write(encode(i * size, np.full(length(file * pieces + i), np.nan)))
                            continue
                        source, name = place_of(where)[0], names[i]
                        with source.open_input_stream(name) as g:
                            while raw := g.read(COPY):
                                f.write(raw)
                own.move(made_, out)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["file"])

    key = F.floor(F.col("place") / per) * pieces + F.floor(F.col("place") % per / size)
    rows = place.filter(F.col("place") < min(total, per * len(paths))).repartition(key).sortWithinPartitions("place").select("place", F.col("v").cast("double").alias("v"))
    parts = rows.mapInArrow(made, "file long, piece long, name string").groupBy("file").agg(F.collect_list(F.struct("piece", "name")).alias("found"))
    files = spark.range(len(paths)).withColumnRenamed("id", "file").join(parts, "file", "left").select("file", "found")
    files.repartition(len(paths)).mapInArrow(joined, "file long").count()
    folder.drop()


def shaped(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(ch, ti, v) with both axes numbered from 0, and how many samples and channels there are."""
    rows, c = numbered(rows.select("ch", "ti", "v"), "ch")
    rows, n = numbered(rows, "ti")
    return rows, n, c


def by_time(rows: DataFrame, c: int) -> DataFrame:
    return rows.select((F.col("ti") * c + F.col("ch")).cast("long").alias("place"), "v")


def by_channel(rows: DataFrame, n: int) -> DataFrame:
    return rows.select((F.col("ch") * n + F.col("ti")).cast("long").alias("place"), "v")


def _raw(first: int, x: np.ndarray) -> bytes:
    return x.astype("<f8").tobytes()


def to_array(rows: DataFrame) -> np.ndarray:
    """(time, channel) values of (ch, ti, v) on the driver, read from a file that tasks wrote."""
    spark = rows.sparkSession
    folder = Folder(spark, "array")
    rows.write.parquet(f"{folder.path}/rows")  # the frame's steps run once
    kept, n, c = shaped(spark.read.parquet(f"{folder.path}/rows"))
    write(by_time(kept, c), [f"{folder.path}/a"], n * c, n * c, _raw)
    out = np.empty((n, c), "<f8")
    fs, place = place_of(f"{folder.path}/a")
    flat, at = out.reshape(-1).view("u1"), 0
    with fs.open_input_stream(place) as f:
        while raw := f.read(COPY):
            flat[at : at + len(raw)] = np.frombuffer(raw, "u1")
            at += len(raw)
    folder.drop()
    return out


def from_array(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """(ch, ti, v) of (time, channel) values that tasks read from a file; NaN becomes NULL."""
    (n, c), path = x.shape, f"{Folder(spark, 'array').path}/a"
    fs, place = place_of(path)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(place) as f:
        for r in range(n):
            for a in range(0, c, PART):
                f.write(x[r, a : a + PART].astype("<f8").tobytes())
    piece = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = place_of(path)
        with own.open_input_file(where) as f:
            for b in batches:
                for i in b.column(0).to_pylist():
                    f.seek(8 * piece * i)
                    v = np.frombuffer(f.read(8 * min(piece, n * c - piece * i)), "<f8")
                    at = piece * i + np.arange(len(v))
                    yield pa.RecordBatch.from_arrays([pa.array(at % c), pa.array(at // c), pa.array(v, mask=np.isnan(v))], names=["ch", "ti", "v"])

    tasks = -(-n * c // piece)
    return spark.range(0, tasks, 1, max(1, tasks // 8)).mapInArrow(run, "ch long, ti long, v double")
