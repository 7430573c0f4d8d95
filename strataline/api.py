"""Entry points by name: read, scan, detect_format, list_formats, from_array, open_spool, stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.frame import SignalFrame
from strataline.sources import arrays, formats, spool
from strataline.streaming import stateful


def read(spark: SparkSession, path: str, **options) -> SignalFrame:
    return formats.read(spark, path, **options)


write_zarr, write_netcdf = arrays.write_zarr, arrays.write_netcdf


def scan(path: str, **options) -> formats.Scan:
    return formats.FORMATS.scan(path, **options)


def detect_format(path: str) -> str | None:
    return formats.FORMATS.detect(path)


def list_formats() -> list[str]:
    return formats.FORMATS.names()


def from_array(spark: SparkSession, data, fs: float, **options) -> SignalFrame:
    return SignalFrame.from_array(spark, data, fs, **options)


def open_spool(spark: SparkSession, paths: list[str] | str, index: str | None = None, **options) -> DataFrame:
    """The index of files, folders or patterns; with ``index`` it is kept there and only new files are scanned."""
    listing = spark.createDataFrame([(p,) for p in spool.resolve(paths, spark)], "path string")
    return spool.refresh(spark, listing, index, **options) if index else formats.scans(listing, **options)


def stream(spark: SparkSession, source: str = "simulation", fs: int = 1000, channels: int = 64, seed: int = 0, **options) -> DataFrame:
    """A stream of samples (timestamp, ch, ti, v): simulated, or of the files that arrive in a folder."""
    return stateful.simulate(spark, fs, channels, seed) if source == "simulation" else stateful.files(spark, source, fs=fs, n_channels=channels, **options)
