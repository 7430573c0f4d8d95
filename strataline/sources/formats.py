"""File formats: a registry, detection by priority, one-row scans, and readers that are Spark data sources.

A format tells by ``can_read`` whether a file is its own, by ``scan`` what is in it, and by
``block`` gives samples [start, stop) of all channels, by ``cells`` of some of them. ``spark.read.format("strataline")``
cuts files into ranges of samples, so that a long file is read by many tasks; ``samples`` does so for an index of any
number of files. Files are opened through pyarrow's file systems: local paths and URIs of stores that it knows.
"""

from __future__ import annotations

import json
import math
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from strataline.frame import SignalFrame
from strataline.sources import catalog

PHASE = math.pi / 2**13
#: Samples times channels that one partition of a file holds.
CELLS = 1 << 22


def opened(path: str):
    """A seekable binary file at a local path or URI."""
    fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(place)


def exists(path: str) -> bool:
    fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.get_file_info(place).type != pafs.FileType.NotFound


@dataclass(frozen=True)
class Scan:
    """What a file holds."""

    path: str
    format_name: str
    n_samples: int
    n_channels: int
    sampling_rate: float
    channel_spacing: float = 1.0
    gauge_length: float | None = None
    start_time: str | None = None
    data_unit: str | None = None
    file_size: int = 0
    format_version: str = "1.0.0"
    attrs: dict = field(default_factory=dict)

    def inventory(self) -> dict:
        """What the file says of the project, fibre, interrogator and acquisition, in the form of ``catalog.inventory``."""
        known = {k.lower(): v for k, v in self.attrs.items()}
        say = lambda *names: next((known[n] for n in names if known.get(n)), "Unknown")
        return catalog.inventory(
            str(known.get("projectname") or f"{self.format_name} Project"),
            acquisition={"start_time": self.start_time or "1970-01-01T00:00:00", "n_channels": self.n_channels, "n_samples": self.n_samples, "data_unit": self.data_unit},
            fiber={"channel_spacing": self.channel_spacing, "gauge_length": 1.0 if self.gauge_length is None else self.gauge_length},
            interrogator={"model": say("iumodel", "model", "instrument"), "manufacturer": say("iumanufacturer", "manufacturer", "systeminfomation"), "sampling_rate": self.sampling_rate},
            custom_attrs=dict(self.attrs),
        )


class Format:
    name = ""
    extensions: tuple[str, ...] = ()
    priority = 100
    #: A channel's samples stand together in the file: wide files are cut by channels.
    by_channel = False

    def can_read(self, path: str) -> bool:
        return path.lower().endswith(self.extensions)

    def scan(self, path: str, **options) -> Scan:
        raise NotImplementedError

    def block(self, path: str, start: int, stop: int, **options) -> np.ndarray:
        raise NotImplementedError

    def cells(self, path: str, start: int, stop: int, channels: np.ndarray, **options) -> np.ndarray:
        """Samples [start, stop) of the named channels (in ascending order); formats that can read less do."""
        return self.block(path, start, stop, **options)[:, channels]

    def places(self, path: str, channels: np.ndarray) -> Places | None:
        """Where the channels stand, for formats that have to look through a file for that; ``cells`` takes it as ``places``."""
        return None

    def tile(self, samples: int, channels: int, most: int) -> tuple[int, int]:
        """Samples and channels that are read at a time, ``most`` cells or so."""
        rows = max(1, min(samples, most) if self.by_channel else most // max(1, channels))
        return rows, max(1, most // rows if self.by_channel else channels)

    def _kept(self, path: str, make):
        """What ``make`` finds in a file, kept while the same file is asked for again."""
        fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        info = fs.get_file_info(place)
        key = (path, info.size, info.mtime_ns)
        if getattr(self, "_known", (None,))[0] != key:
            self._known = (key, make(path))
        return self._known[1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}


@dataclass
class Places:
    """Rows that say where a channel's samples stand: those of channel i are first[i] to first[i + 1]."""

    first: np.ndarray
    rows: np.ndarray

    def of(self, channels) -> Places:
        """Those of some channels, by number or range."""
        if isinstance(channels, slice):
            a, b = self.first[channels.start], self.first[min(channels.stop, len(self.first) - 1)]
            return Places(self.first[channels.start : channels.stop + 1] - a, self.rows[a:b])
        length = self.first[channels + 1] - self.first[channels]
        first = np.concatenate(([0], np.cumsum(length)))
        return Places(first, self.rows[np.repeat(self.first[channels] - first[:-1], length) + np.arange(first[-1])])


class Dat(Format):
    """Flat int16 rows of time x channel; value = raw * pi / 2**13."""

    name, extensions, priority = "DAT", (".dat", ".bin"), 40

    def scan(self, path: str, n_channels: int = 0, fs: float = 5000.0, dx: float = 1.0, **_) -> Scan:
        n_channels = int(n_channels)
        if n_channels < 1:
            raise ValueError("DAT files need n_channels")
        with opened(path) as f:
            size = f.size()
        n = size // (2 * n_channels)
        if not n:
            raise ValueError(f"{path} holds no full sample of {n_channels} channels")
        return Scan(path, self.name, n, n_channels, float(fs), float(dx), data_unit="rad/s", file_size=size)

    def block(self, path: str, start: int, stop: int, n_channels: int = 0, byte_order: str = "little", **_) -> np.ndarray:
        width = 2 * int(n_channels)
        with opened(path) as f:
            f.seek(start * width)
            raw = f.read((stop - start) * width)
        return np.frombuffer(raw, "<i2" if byte_order == "little" else ">i2").reshape(-1, int(n_channels)) * PHASE


class SegY(Format):
    """SEG-Y revision 1: a trace per channel; int16, int32, IEEE and IBM float samples."""

    name, extensions, priority = "SEGY", (".sgy", ".segy"), 50
    by_channel = True
    KINDS = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 8: ">i1"}

    def _head(self, path: str) -> tuple[int, int, int, str, int]:
        with opened(path) as f:
            size = f.size()
            f.seek(3200)
            head = f.read(400)
        interval, n, code = struct.unpack_from(">H", head, 16)[0], struct.unpack_from(">H", head, 20)[0], struct.unpack_from(">h", head, 24)[0]
        if code not in self.KINDS or not n or not interval:
            raise ValueError(f"{path}: no SEG-Y header that is known here")
        trace = 240 + n * np.dtype(self.KINDS[code]).itemsize
        return interval, n, (size - 3600) // trace, self.KINDS[code], trace

    def scan(self, path: str, dx: float = 1.0, **_) -> Scan:
        interval, n, traces, _, trace = self._head(path)
        return Scan(path, self.name, n, traces, 1e6 / interval, float(dx), file_size=3600 + traces * trace)

    def block(self, path: str, start: int, stop: int, **_) -> np.ndarray:
        return self.cells(path, start, stop, np.arange(self._head(path)[2]))

    def cells(self, path: str, start: int, stop: int, channels: np.ndarray, **_) -> np.ndarray:
        _, n, _, kind, trace = self._head(path)
        item = np.dtype(kind).itemsize
        out = np.empty((stop - start, len(channels)))
        with opened(path) as f:
            if len(channels) > 1 and channels[-1] - channels[0] == len(channels) - 1 and 2 * (stop - start) >= n:  # whole traces that follow one another
                f.seek(3600 + int(channels[0]) * trace)
                x = np.frombuffer(f.read(len(channels) * trace), "u1").reshape(-1, trace)[:, 240 + start * item : 240 + stop * item]
                x = np.ascontiguousarray(x).view(kind).T
                return _ibm(x) if kind == ">u4" else x.astype(float)
            for i, c in enumerate(channels.tolist()):
                f.seek(3600 + c * trace + 240 + start * item)
                x = np.frombuffer(f.read((stop - start) * item), kind)
                out[:, i] = _ibm(x) if kind == ">u4" else x
        return out


def _ibm(x: np.ndarray) -> np.ndarray:
    """IBM hexadecimal floats."""
    x = x.astype(np.uint32)
    sign = np.where(x >> 31, -1.0, 1.0)
    return sign * (x & 0xFFFFFF) / float(1 << 24) * 16.0 ** (((x >> 24) & 0x7F).astype(int) - 64)


class Hdf5(Format):
    """The HDF5 family: where a vendor keeps its samples and what it calls their attributes. Needs h5py."""

    def __init__(self, name: str, priority: int, paths: tuple[str, ...], mark=None, divide: float | None = None, fs: float = 1000.0, spacing: str = "SpatialSamplingInterval"):
        self.name, self.priority, self.paths, self.mark, self.divide, self.fs, self.spacing = name, priority, paths, mark, divide, fs, spacing
        self.extensions = (".h5", ".hdf5", ".hdf")

    def _file(self, path: str):
        try:
            import h5py
        except ImportError as e:
            raise ImportError(f"{self.name} files need the package h5py") from e
        return h5py.File(opened(path), "r")

    def _data(self, f):
        for p in self.paths:
            for name in _expanded(f, p):
                if name in f and hasattr(f[name], "shape") and len(f[name].shape) == 2:
                    return f[name]
        found: list = []
        f.visititems(lambda _, x: found.append(x) if hasattr(x, "shape") and len(x.shape) == 2 and not found else None)
        if not found:
            raise ValueError("no two-dimensional dataset")
        return found[0]

    @staticmethod
    def _attrs(f) -> dict:
        out = {k: v.decode() if isinstance(v, bytes) else v for k, v in f.attrs.items()}
        if "Acquisition" in f:
            out |= {k: v.decode() if isinstance(v, bytes) else v for k, v in f["Acquisition"].attrs.items()}
        return out

    def can_read(self, path: str) -> bool:
        if not super().can_read(path):
            return False
        with self._file(path) as f:
            return self.mark is None or bool(self.mark(f, self._attrs(f)))

    def scan(self, path: str, **_) -> Scan:
        with self._file(path) as f:
            a, shape = self._attrs(f), self._data(f).shape
        pick = lambda keys, default: next((float(np.ravel(a[k])[0]) for k in keys if k in a), default)
        rate = pick(("SamplingFrequency", "sampling_rate", "fs", "sample_rate", "SamplingFrequency[Hz]"), self.fs)
        gap = pick((self.spacing, "dx", "channel_spacing", "SpatialResolution[m]"), 1.0)
        start = a.get("StartTime") or a.get("start_time")
        with opened(path) as f:
            size = f.size()
        unit = a.get("DataUnit") or ("rad" if self.divide else None)
        return Scan(path, self.name, *map(int, shape), rate, gap, pick(("GaugeLength", "gauge_length"), None), None if start is None else str(start), unit, size, str(a.get("SchemaVersion") or "1.0.0"), {k: str(v) for k, v in a.items()})

    def block(self, path: str, start: int, stop: int, **_) -> np.ndarray:
        with self._file(path) as f:
            return self._scaled(self._data(f)[start:stop])

    def cells(self, path: str, start: int, stop: int, channels: np.ndarray, **_) -> np.ndarray:
        if not len(channels):
            return np.zeros((stop - start, 0))
        low = int(channels[0])
        with self._file(path) as f:
            return self._scaled(self._data(f)[start:stop, low : int(channels[-1]) + 1])[:, channels - low]

    def _scaled(self, raw) -> np.ndarray:
        x = np.asarray(raw, float)
        return x if self.divide is None else x / self.divide * PHASE


def _expanded(f, pattern: str) -> list[str]:
    """A path in which Source* and Zone* stand for any name that begins so."""
    names = [""]
    for part in pattern.split("/"):
        names = [f"{n}/{k}".lstrip("/") for n in names for k in ([part] if not part.endswith("*") else [k for k in (f[n] if n else f) if k.startswith(part[:-1])]) if not part.endswith("*") or not n or n in f]
    return names


def _says(a: dict, word: str) -> bool:
    return any(word in str(a.get(k, "")).lower() for k in ("Manufacturer", "manufacturer", "SystemInfomation", "IUManufacturer"))


class NetCdf4(Hdf5):
    """NetCDF-4 files are HDF5 files by another name."""

    def __init__(self, *args):
        super().__init__(*args)
        self.extensions = (".nc", ".nc4")

    def can_read(self, path: str) -> bool:
        with opened(path) as f:
            return f.read(4) == b"\x89HDF" and super().can_read(path)


# Places of the samples and marks of each vendor's files. (fixed values)
HDF5 = (
    Hdf5("PRODML", 20, ("Acquisition/Raw[0]/RawData", "Acquisition/Raw[0]/RawData[0]", "Acquisition/Custom/Raw[0]/RawData"), lambda f, a: "Acquisition" in f and ("SchemaVersion" in a or "Acquisition/Raw[0]/RawData" in f)),
    Hdf5("SILIXA", 21, ("Acquisition/Raw[0]/RawData", "Acquisition/Raw[0]", "RawData", "data"), lambda f, a: _says(a, "silixa") or "MeasureLength[m]" in a or "SpatialResolution[m]" in a, spacing="SpatialResolution"),
    Hdf5("FEBUS", 22, ("Source1/Zone1/Trace", "Source*/Zone*/Trace", "data"), lambda f, a: any(k.startswith("Source") for k in f), spacing="SpatialResolution"),
    Hdf5("APSENSING", 23, ("DAS/data", "data", "Acquisition/Raw[0]"), lambda f, a: _says(a, "ap sensing") or _says(a, "apsensing") or "DAS/data" in f, spacing="SpatialResolution"),
    Hdf5("TERRA15", 25, ("data_product/data",), lambda f, a: "data_product/data" in f),
    NetCdf4("NETCDF4", 39, ("data", "strain", "strain_rate", "das", "DAS", "velocity")),
    Hdf5("H5", 30, ("Acquisition/Raw[0]", "Acquisition/Raw[0]/RawData", "data", "Data", "raw_data", "DAS/data"), divide=4.0, fs=5000.0),
)


class Registry:
    """Formats by upper-case name."""

    def __init__(self):
        self._known: dict[str, Format] = {}
        self.reset()

    def reset(self) -> None:
        self._known = {f.name: f for f in (Dat(), SegY(), *HDF5)}
        arrays = sys.modules.get("strataline.sources.arrays")  # registers its formats when it is imported
        tdms = sys.modules.get("strataline.sources.tdms")
        for f in (*getattr(arrays, "CONTAINERS", ()), *((tdms.Tdms(),) if tdms else ())):
            self.register(f)

    def register(self, fmt: Format) -> None:
        self._known[fmt.name.upper()] = fmt

    def unregister(self, name: str) -> None:
        self._known.pop(name.upper(), None)

    def get(self, name: str) -> Format:
        if name.upper() not in self._known:
            raise ValueError(f"unknown format {name}")
        return self._known[name.upper()]

    def names(self) -> list[str]:
        return sorted(self._known)

    def extensions(self) -> list[str]:
        return sorted({e for f in self._known.values() for e in f.extensions})

    def detect(self, path: str) -> str | None:
        """The first format by priority that takes the file; None if there is no such file or format."""
        if not exists(path):
            return None
        for f in sorted(self._known.values(), key=lambda f: f.priority):
            try:
                if f.can_read(path):
                    return f.name
            except Exception:  # a format that can't look into the file doesn't take it
                continue
        return None

    def scan(self, path: str, name: str | None = None, **options) -> Scan:
        found = name or self.detect(path)
        if found is None:
            raise ValueError(f"no format takes {path}")
        return self.get(found).scan(path, **options)


FORMATS = Registry()


@dataclass
class Range(InputPartition):
    start: int
    stop: int
    first: int = 0
    last: int = 0
    places: Places | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        import strataline.sources.arrays  # noqa: F401 - the worker's registry gets all formats

        self.options = {k.lower(): v for k, v in options.items()}
        self.path = self.options["path"]
        known = {"n_channels", "fs", "dx", "byte_order"}
        self.args = {k: v for k, v in self.options.items() if k in known}
        self.scan = FORMATS.scan(self.path, self.options.get("kind"), **self.args)
        self.low, self.high = 0, self.scan.n_samples
        self.channels = range(self.scan.n_channels)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds and values of ti and ch: the files' other parts are not read."""
        for f in filters:
            column = getattr(f, "attribute", None)
            values = sorted(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
            if column not in (("ti",), ("ch",)) or None in values or not values:
                yield f
                continue
            low = values[0] if isinstance(f, (EqualTo, In, GreaterThanOrEqual)) else values[0] + 1 if isinstance(f, GreaterThan) else None
            high = values[-1] if isinstance(f, (EqualTo, In, LessThanOrEqual)) else values[0] - 1 if isinstance(f, LessThan) else None
            if low is None and high is None:
                yield f
            elif column == ("ti",):
                self.low = self.low if low is None else max(self.low, low)
                self.high = self.high if high is None else min(self.high, high + 1)
                if isinstance(f, In):  # the bounds alone
                    yield f
            else:
                c = np.asarray(self.channels)
                self.channels = c[np.isin(c, values)] if isinstance(f, In) else c[(c >= (0 if low is None else low)) & (c <= (self.scan.n_channels if high is None else high))]

    def partitions(self) -> list[Range]:
        fmt, width, height = FORMATS.get(self.scan.format_name), len(self.channels), max(0, self.high - self.low)
        if not width or not height:
            return [Range(0, 0)]
        rows, cols = fmt.tile(height, width, CELLS)
        known = fmt.places(self.path, np.asarray(self.channels))
        out = []
        for j in range(0, width, cols):
            own = None if known is None else known.of(slice(j, j + cols))
            out += [Range(i, min(i + rows, self.high), j, min(j + cols, width), own) for i in range(self.low, self.high, rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        import strataline.sources.arrays  # noqa: F401

        for ch, ti, v in _pieces(self.scan.format_name, self.path, part.start, part.stop, self.channels[part.first : part.last], self.args | {"n_channels": self.scan.n_channels}, part.places):
            yield pa.RecordBatch.from_arrays([ch, ti, v], names=["ch", "ti", "v"])


def _pieces(kind: str, path: str, start: int, stop: int, channels, args: dict, places: Places | None = None) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """ch, ti and v of a range of a file, some 2**18 cells at a time."""
    channels = np.asarray(channels)
    if not len(channels) or start >= stop:
        return
    fmt = FORMATS.get(kind)
    rows, cols = fmt.tile(stop - start, len(channels), 1 << 18)
    places = fmt.places(path, channels) if places is None else places
    for j in range(0, len(channels), cols):
        own = channels[j : j + cols]
        more = args if places is None else args | {"places": places.of(slice(j, j + cols))}
        for a in range(start, stop, rows):
            x = fmt.cells(path, a, min(a + rows, stop), own, **more)
            v = x.ravel().astype(float)
            yield pa.array(np.tile(own, len(x)), pa.int64()), pa.array(np.repeat(np.arange(a, a + len(x)), len(own)), pa.int64()), pa.array(v, mask=np.isnan(v))


class FileSource(DataSource):
    """``spark.read.format("strataline").option("n_channels", ...).load(path)``: ch, ti, v."""

    @classmethod
    def name(cls) -> str:
        return "strataline"

    def schema(self) -> str:
        return "ch long, ti long, v double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, kind: str | None = None, channels: list[int] | tuple[int, int] | None = None, time: tuple[int, int] | None = None, **options) -> SignalFrame:
    """A frame from a file of any known format, or from a Parquet folder with ch, ti and v.

    ``channels`` is a list, or a tuple of a first and a last channel, both included; ``time`` is a range [first, last) of
    samples. Both are pushed to the files; channels keep their numbers, times count from the first one read.
    """
    import strataline.sources.arrays  # noqa: F401

    found = _read(spark, path, kind, **options)
    df = found.df
    if channels is not None:
        df = df.filter(F.col("ch").between(*channels)) if isinstance(channels, tuple) else df.filter(F.col("ch").isin(list(channels)))
    if time is not None:
        df = df.filter((F.col("ti") >= time[0]) & (F.col("ti") < time[1])).withColumn("ti", F.col("ti") - time[0])
    return found if channels is None and time is None else SignalFrame(df, found.fs, found.dx, found.meta)


def _read(spark: SparkSession, path: str, kind: str | None, **options) -> SignalFrame:

    if kind is None and FORMATS.detect(path) is None:
        fs, dx = float(options.pop("fs", 1.0)), float(options.pop("dx", 1.0))
        return SignalFrame(spark.read.parquet(path).select("ch", "ti", "v"), fs, dx)
    spark.dataSource.register(FileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = FORMATS.scan(path, kind, **options)
    df = spark.read.format("strataline").options(kind=found.format_name, **options).load(path)
    return SignalFrame(df, found.sampling_rate, found.channel_spacing, {"units": found.data_unit, "source": path, "inventory": found.inventory()})


SCAN_SCHEMA = (
    "path string, format_name string, n_samples long, n_channels int, sampling_rate double, channel_spacing double, gauge_length double, start_time string, data_unit string, file_size long,"
    " format_version string, attrs map<string,string>, inventory string"
)


def scans(paths: DataFrame, **options) -> DataFrame:
    """Rows of the file index for a DataFrame of paths, with attributes and inventory (JSON); files that can't be read are left out."""
    names = [x.split()[0] for x in SCAN_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    like = [kinds.get(x.split()[1], pa.string()) for x in SCAN_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import strataline.sources.arrays  # noqa: F401

        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    found = FORMATS.scan(path, **options)
                except (ValueError, OSError, ImportError, KeyError):
                    continue
                row = {n: getattr(found, n) for n in names[:-1]} | {"inventory": json.dumps(found.inventory(), default=str)}
                rows.append(row | {"attrs": [(str(k), str(v)) for k, v in found.attrs.items()]})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, like, strict=True)], names=names)

    found = paths.select("path").mapInArrow(run, SCAN_SCHEMA).withColumn("start_time", F.try_to_timestamp(F.col("start_time")))
    length = F.round(F.col("n_samples") / F.col("sampling_rate") * 1e6).cast("long")
    return found.withColumn("end_time", F.timestamp_micros(F.unix_micros("start_time") + length))


def samples(index: DataFrame, channels: list[int] | None = None, **options) -> DataFrame:
    """path, ch, ti and v of all files of an index (path, format_name, n_samples, n_channels, and offset if ti is to go on from it).

    Files are cut into ranges, which are dealt to tasks: one plan for any number of files.
    """
    import strataline.sources.arrays  # noqa: F401

    offset = F.col("offset") if "offset" in index.columns else F.lit(0)
    whole = F.col("format_name").isin([n for n in FORMATS.names() if FORMATS.get(n).by_channel])
    long = lambda c: c.cast("long")
    rows = F.when(whole, F.least(F.col("n"), F.lit(CELLS))).otherwise(F.greatest(F.floor(F.lit(CELLS) / F.col("n_channels")), F.lit(1)))
    cols = F.when(whole, F.greatest(F.floor(F.lit(CELLS) / F.col("step")), F.lit(1))).otherwise(F.col("n_channels"))
    ranges = index.filter("n_samples > 0 AND n_channels > 0").select("path", "format_name", long(F.col("n_channels")).alias("n_channels"), long(offset).alias("offset"), long(F.col("n_samples")).alias("n"))
    ranges = ranges.withColumn("step", long(rows)).withColumn("width", long(cols))
    ranges = ranges.withColumn("start", F.explode(F.sequence(long(F.lit(0)), F.col("n") - 1, "step"))).withColumn("stop", F.least(F.col("start") + F.col("step"), F.col("n")))
    ranges = ranges.withColumn("first", F.explode(F.sequence(long(F.lit(0)), F.col("n_channels") - 1, "width"))).withColumn("last", F.least(F.col("first") + F.col("width"), F.col("n_channels")))
    ranges = ranges.repartition(F.col("path"), F.col("start"), F.col("first")).select("path", "format_name", "n_channels", "offset", "start", "stop", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import strataline.sources.arrays  # noqa: F401

        for b in batches:
            for path, kind, width, before, start, stop, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wanted = np.arange(first, last) if channels is None else np.array(sorted(c for c in set(channels) if first <= c < last), int)
                for ch, ti, v in _pieces(kind, path, start, stop, wanted, options | {"n_channels": width}):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(ch), pa.string()), ch, pa.array(ti.to_numpy() + before), v], names=["path", "ch", "ti", "v"])

    return ranges.mapInArrow(run, "path string, ch long, ti long, v double")


def write_dat(frame: SignalFrame, path: str) -> None:
    """A small frame as one DAT file, from the driver."""
    raw = np.round(frame.collect() / PHASE).astype("<i2")
    with open(path, "wb") as f:
        f.write(raw.tobytes())
