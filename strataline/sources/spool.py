"""A multi-file index: incremental scans, time and attribute selection, concatenation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INDEX_SCHEMA = (
    "path string, start_time timestamp, end_time timestamp, n_samples long, n_channels int, sampling_rate double, channel_spacing double, gauge_length double,"
    " data_unit string, file_size long, format_name string, format_version string, attrs map<string,string>, inventory string"
)
INVENTORY_PARTS = ("interrogator", "fiber", "acquisition", "custom_attrs")


def overlap(index: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Files that touch [start, stop): start before its end and end after its start; without times they go."""
    out = index.filter(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    if stop is not None:
        out = out.filter(F.col("start_time") < F.to_timestamp(F.lit(stop)))
    return out if start is None else out.filter(F.col("end_time") > F.to_timestamp(F.lit(start)))


def having(index: DataFrame, **attrs) -> DataFrame:
    """Files whose attributes, else inventory fields, equal all given values."""
    for name, value in attrs.items():
        places = [F.try_element_at("attrs", F.lit(name))] if "attrs" in index.columns else []
        if "inventory" in index.columns:
            places += [F.get_json_object("inventory", f"$.{part}.{name}") for part in INVENTORY_PARTS]
        index = index.filter(F.coalesce(*places, F.lit(None).cast("string")) == F.lit(str(value)))
    return index


def unseen(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Listed paths that the index does not have yet."""
    return listing.join(index.select("path"), "path", "left_anti")


def update(listing: DataFrame, index: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index with the new paths scanned into it."""
    return index.unionByName(scan(unseen(listing, index)), allowMissingColumns=True)


def offsets(index: DataFrame) -> DataFrame:
    """path and the number of samples in all files before it, by start time.

    Days are summed first, so that only one row per day meets in one task.
    """
    day = F.to_date("start_time")
    days = index.groupBy(day.alias("day")).agg(F.sum("n_samples").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("day").orderBy("start_time", "path").rowsBetween(Window.unboundedPreceding, -1)
    own = index.withColumn("day", day).withColumn("inner", F.coalesce(F.sum("n_samples").over(inner), F.lit(0)))
    return own.join(before, own["day"].eqNullSafe(before["day"])).select("path", (F.col("ahead") + F.col("inner")).alias("offset"))


def concat(samples: DataFrame, index: DataFrame) -> DataFrame:
    """One frame from samples (path, ch, ti, v) of several files: ti goes on from file to file."""
    return samples.join(offsets(index), "path").select("ch", (F.col("ti") + F.col("offset")).alias("ti"), "v")


def within(samples: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Samples whose place x lies in [low, high)."""
    out = samples if low is None else samples.filter(F.col("x") >= low)
    return out if high is None else out.filter(F.col("x") < high)


def chunks(samples: DataFrame, length: int, overlap_: int = 0) -> DataFrame:
    """Samples with the number of each window of ``length`` that holds them; windows share ``overlap_`` samples."""
    hop = length - overlap_
    first = F.greatest(F.ceil((F.col("ti") - (length - 1)) / hop), F.lit(0))
    return samples.withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("ti") / hop))))


def resolve(paths: list[str] | str, spark=None) -> list[str]:
    """Files behind paths, folders and patterns, sorted: of folders those with an extension that a format knows.

    With a session, through Hadoop's file systems, so that every store that Spark reads is listed too.
    """
    import glob
    import os

    import strataline.sources.arrays  # noqa: F401 - all formats
    from strataline.sources.formats import FORMATS

    known, out = tuple(FORMATS.extensions()), set()
    for p in [paths] if isinstance(paths, str) else paths:
        if spark is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(p)
            fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for found in fs.globStatus(where) or []:
                name = found.getPath().toString()
                inside = fs.listStatus(found.getPath()) if found.isDirectory() and not name.lower().endswith(known) else [found]
                names = [x.getPath().toString() for x in inside]
                out.update(_plain(n) for n in names if not found.isDirectory() or n.lower().endswith(known))
        elif os.path.isdir(p) and not p.lower().endswith(known):
            out.update(os.path.join(p, n) for n in os.listdir(p) if n.lower().endswith(known))
        else:
            out.update(glob.glob(p) if any(c in p for c in "*?[") else [p])
    return sorted(out)


def _plain(name: str) -> str:
    """A local file's path without its scheme."""
    return "/" + name[5:].lstrip("/") if name.startswith("file:") else name


def listing(spark, paths: list[str] | str, most: int = 50) -> DataFrame:
    """The first ``most`` files, by path: path, name and size in MB."""
    rows = []
    for p in resolve(paths, spark)[:most]:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        rows.append((p, where.getName(), round(size / (1 << 20), 3)))
    return spark.createDataFrame(rows, "path string, name string, size_mb double")


def refresh(spark, listing: DataFrame, path: str, **options) -> DataFrame:
    """The index kept at ``path`` (Parquet, in any store), with files that it lacks scanned and appended; sorted by start time."""
    from strataline.sources import formats

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    kept = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = unseen(listing, spark.read.parquet(path)) if kept else listing
    found = formats.scans(new, **options)
    if not kept or not found.isEmpty():
        found.write.mode("append").parquet(path)
    return spark.read.parquet(path).orderBy("start_time", "path")


def to_frame(spark, index: DataFrame, channels: list[int] | None = None, **options):
    """The files of an index as one frame along time, in the order of their start times; rate and spacing are the first file's."""
    from strataline.frame import SignalFrame
    from strataline.sources import formats

    first = index.orderBy("start_time", "path").select("sampling_rate", "channel_spacing").first()
    if first is None:
        raise ValueError("the index has no files")
    rows = formats.samples(index.join(offsets(index), "path"), channels, **options)
    return SignalFrame(rows.select("ch", "ti", "v"), first.sampling_rate, first.channel_spacing)
