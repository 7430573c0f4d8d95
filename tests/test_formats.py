"""Formats whose packages are not at hand, through stand-ins, and what the index and streams make of files."""

import pickle
import struct
import sys
import time
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataline import api, queries_files
from strataline.frame import SignalFrame
from strataline.plans import chains, models
from strataline.sources import arrays, formats, spool
from strataline.streaming import stateful

RNG = np.random.default_rng(7)
STUB = '''
import pickle


class Node:
    def __init__(self, tree):
        self.tree, self.attrs = tree, tree.get("attrs", {})

    def _find(self, path):
        node = self.tree
        for part in path.split("/"):
            node = node["children"][part]
        return node

    def __contains__(self, path):
        try:
            self._find(path)
        except KeyError:
            return False
        return True

    def __getitem__(self, path):
        found = self._find(path)
        return Data(found) if "data" in found else Node(found)

    def __iter__(self):
        return iter(self.tree["children"])

    def visititems(self, f):
        for name in self.tree.get("children", {}):
            node = self[name]
            f(name, node)
            if isinstance(node, Node):
                node.visititems(f)


class Data:
    def __init__(self, tree):
        self.data, self.attrs, self.shape = tree["data"], tree.get("attrs", {}), tree["data"].shape

    def __getitem__(self, at):
        return self.data[at]


class File(Node):
    def __init__(self, f, mode):
        raw = f.read()
        if raw[:4] != b"\\x89HDF":
            raise OSError("no HDF5 file")
        super().__init__(pickle.loads(raw[4:]))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass
'''


@pytest.fixture(scope="module")
def h5py(spark, tmp_path_factory):
    """A stand-in for h5py, here and on the workers, that reads pickled trees."""
    path = tmp_path_factory.mktemp("stub") / "h5py.py"
    path.write_text(STUB)
    spark.sparkContext.addPyFile(str(path))
    module = types.ModuleType("h5py")
    exec(STUB, module.__dict__)
    sys.modules["h5py"] = module
    yield module
    del sys.modules["h5py"]


def tree(place, data, attrs=None, inner=None):
    """A file with one dataset at a place; attributes of the file, and of Acquisition."""
    node = {"data": data}
    for part in reversed(place.split("/")):
        node = {"children": {part: node}}
    node["attrs"] = attrs or {}
    if inner:
        node["children"].setdefault("Acquisition", {"children": {}})["attrs"] = inner
    return node


RAW = RNG.integers(-500, 500, (60, 5)).astype("<i2")
VENDORS = {
    "PRODML": tree("Acquisition/Raw[0]/RawData", RAW, {"SchemaVersion": "2.0", "ProjectName": "P"}, {"SamplingFrequency": 500.0, "SpatialSamplingInterval": 2.0, "GaugeLength": 10.0, "StartTime": "2024-03-01T00:00:00", "IUModel": b"M1", "DataUnit": "strain_rate"}),
    "SILIXA": tree("RawData", RAW, {"SystemInfomation": "Silixa iDAS", "SamplingFrequency[Hz]": 250.0, "SpatialResolution[m]": 1.5}),
    "FEBUS": tree("Source7/Zone2/Trace", RAW, {"sampling_rate": 200.0, "SpatialResolution": 4.0}),
    "APSENSING": tree("DAS/data", RAW, {"Manufacturer": "AP Sensing", "fs": 400.0}),
    "TERRA15": tree("data_product/data", RAW, {"sample_rate": 100.0, "dx": 0.5}),
    "H5": tree("Acquisition/Raw[0]", RAW, {}, {"fs": 1000.0, "GaugeLength": [3.0]}),
}
RATES = {"PRODML": (500.0, 2.0, 10.0), "SILIXA": (250.0, 1.5, None), "FEBUS": (200.0, 4.0, None), "APSENSING": (400.0, 1.0, None), "TERRA15": (100.0, 0.5, None), "H5": (1000.0, 1.0, 3.0)}


def put(path, node):
    path.write_bytes(b"\x89HDF" + pickle.dumps(node))
    return str(path)


@pytest.mark.parametrize("name", VENDORS)
def test_hdf5_vendors(spark, h5py, tmp_path, name):
    path = put(tmp_path / "a.h5", VENDORS[name])
    assert formats.FORMATS.detect(path) == name
    s = formats.FORMATS.scan(path)
    assert (s.n_samples, s.n_channels) == RAW.shape and (s.sampling_rate, s.channel_spacing, s.gauge_length) == RATES[name] and s.file_size > 0
    f = formats.read(spark, path)
    scale = np.pi / 2**13 / 4 if name == "H5" else 1.0
    assert np.allclose(f.collect(), RAW * scale)
    part = formats.read(spark, path, channels=(1, 3), time=(10, 20))
    assert np.allclose(part.collect(), RAW[10:20, 1:4] * scale) and [r.ch for r in part.df.select("ch").distinct().orderBy("ch").collect()] == [1, 2, 3]
    inv = f.inventory
    assert inv["acquisition"]["n_channels"] == 5 and inv["interrogator"]["sampling_rate"] == s.sampling_rate and inv["fiber"]["channel_spacing"] == s.channel_spacing
    if name == "PRODML":
        assert inv["project_name"] == "P" and inv["interrogator"]["model"] == "M1" and inv["acquisition"]["start_time"] == "2024-03-01T00:00:00" and f.unit == "strain_rate"


def test_netcdf4_and_the_first_dataset_of_an_unknown_file(spark, h5py, tmp_path):
    path = put(tmp_path / "a.nc", tree("strain", RAW, {"fs": 50.0}))
    assert formats.FORMATS.detect(path) == "NETCDF4" and np.allclose(formats.read(spark, path).collect(), RAW)
    other = put(tmp_path / "b.h5", tree("somewhere/else", RAW))
    assert formats.FORMATS.detect(other) == "H5" and np.allclose(formats.read(spark, other).collect(), RAW / 4 * np.pi / 2**13)


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def segment(objects, data, toc=0x0E, sign="<"):
    """A TDMS segment: objects are (path, type code, count or None, properties)."""
    meta = struct.pack(sign + "I", len(objects))
    for path, code, count, props in objects:
        meta += struct.pack(sign + "I", len(path)) + path.encode()
        meta += struct.pack(sign + "I", 0xFFFFFFFF) if count is None else struct.pack(sign + "IIIQ", 20, code, 1, count)
        meta += struct.pack(sign + "I", len(props))
        for key, value in props.items():
            meta += struct.pack(sign + "I", len(key)) + key.encode()
            meta += struct.pack(sign + "Id", 10, value) if isinstance(value, float) else struct.pack(sign + "II", 0x20, len(value)) + value.encode()
    return b"TDSm" + struct.pack("<I", toc) + struct.pack(sign + "IQQ", 4713, len(meta) + len(data), len(meta)) + meta + data


def test_tdms(spark, tmp_path):
    x, y = RNG.normal(size=(40, 3)), RNG.integers(-99, 99, (30, 3)).astype("<i2")
    names = [f"/'g'/'c{i}'" for i in range(3)]
    props = [("/", 0, None, {"title": "T"}), ("/'g'", 0, None, {})]
    head = segment([*props, *((n, 10, 10, {"wf_increment": 0.002} if i == 0 else {}) for i, n in enumerate(names))], b"".join(x[k : k + 10].T.astype("<f8").tobytes() for k in (0, 10)))
    more = b"TDSm" + struct.pack("<IIQQ", 0x08, 4713, 10 * 3 * 8 * 2, 0) + b"".join(x[k : k + 10].T.astype("<f8").tobytes() for k in (20, 30))
    (tmp_path / "a.tdms").write_bytes(head + more)
    s = formats.FORMATS.scan(str(tmp_path / "a.tdms"))
    assert s.format_name == "TDMS" and (s.n_samples, s.n_channels, s.sampling_rate) == (40, 3, 500.0) and s.attrs["title"] == "T"
    f = formats.read(spark, str(tmp_path / "a.tdms"))
    assert np.array_equal(f.collect(), x) and np.array_equal(f.df.filter("ch IN (0, 2) AND ti BETWEEN 7 AND 23").count(), 34)
    (tmp_path / "b.tdms").write_bytes(segment([*props, *((n, 2, 30, {}) for n in names)], y.tobytes(), 0x0E | 1 << 5))
    (tmp_path / "c.tdms").write_bytes(segment([(n, 2, 30, {}) for n in names], y.T.astype(">i2").tobytes(), 0x0E | 1 << 6, ">"))
    for p in ("b.tdms", "c.tdms"):
        assert np.array_equal(formats.read(spark, str(tmp_path / p), fs=10).collect(), y.astype(float)) and formats.FORMATS.scan(str(tmp_path / p), fs=10).sampling_rate == 10
    assert api.detect_format(str(tmp_path / "a.tdms")) == "TDMS"
    (tmp_path / "d.tdms").write_bytes(b"nothing")
    assert api.detect_format(str(tmp_path / "d.tdms")) is None


def test_filters_reach_the_files(spark, tmp_path):
    raw = RNG.integers(-100, 100, (80, 6)).astype("<i2")
    (tmp_path / "a.dat").write_bytes(raw.tobytes())
    df = formats.read(spark, str(tmp_path / "a.dat"), n_channels=6, fs=100).df
    x = raw * np.pi / 2**13
    for where, rows, cols in (
        ("ch IN (1, 4)", slice(0, 80), [1, 4]), ("ch > 1 AND ch <= 4 AND ti > 9 AND ti <= 30", slice(10, 31), [2, 3, 4]), ("ti = 5", slice(5, 6), range(6)), ("ch < 2 AND ti >= 78", slice(78, 80), [0, 1]), ("ti IN (3, 9)", [3, 9], range(6)), ("ch > 9", slice(0, 80), []),
    ):
        got = df.filter(where)
        assert got.count() == x[rows][:, list(cols)].size
        if len(list(cols)):
            assert np.allclose(SignalFrame(got).collect(), x[rows][:, list(cols)])
    reader = formats._Reader({"path": str(tmp_path / "a.dat"), "n_channels": "6"})
    from pyspark.sql.datasource import GreaterThan, In, LessThanOrEqual

    left = list(reader.pushFilters([In(("ch",), (1, 4)), GreaterThan(("ti",), 9), LessThanOrEqual(("ti",), 30)]))
    assert not left and reader.channels.tolist() == [1, 4] and (reader.low, reader.high) == (10, 31)


def test_spool_of_files(spark, h5py, tmp_path):
    for i, site in enumerate(("A", "B", "A")):
        put(tmp_path / f"{i}.h5", tree("Acquisition/Raw[0]/RawData", RAW + i, {"SchemaVersion": "2.0"}, {"SamplingFrequency": 100.0, "StartTime": f"2024-03-01T00:00:0{i}", "site": site, "IUModel": f"M{i}"}))
    (tmp_path / "bad.h5").write_bytes(b"no")
    index = api.open_spool(spark, str(tmp_path), str(tmp_path / "index"))
    assert index.count() == 3 and {r.attrs["site"] for r in index.collect()} == {"A", "B"}
    assert [r.path[-4:] for r in spool.having(index, site="A").orderBy("path").collect()] == ["0.h5", "2.h5"]
    assert [r.path[-4:] for r in spool.having(index, model="M1", n_channels=5).collect()] == ["1.h5"] and spool.having(index, nothing="x").count() == 0
    assert [r.path[-4:] for r in spool.overlap(index, "2024-03-01 00:00:01", "2024-03-01 00:00:02").collect()] == ["1.h5"]
    whole = spool.to_frame(spark, index)
    assert whole.fs == 100 and np.allclose(whole.collect(), np.vstack([RAW, RAW + 1, RAW + 2]))
    assert np.allclose(spool.to_frame(spark, spool.having(index, site="A"), channels=[0, 3]).collect(), np.vstack([RAW, RAW + 2])[:, [0, 3]])
    # any number of files is one plan
    plan = whole.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert spool.having(index.drop("attrs", "inventory"), site="A").count() == 0
    rows = spool.listing(spark, str(tmp_path / "*.h5"), 2).collect()
    assert [r.name for r in rows] == ["0.h5", "1.h5"] and all(r.size_mb >= 0 for r in rows)


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.dat").write_bytes(np.full((20, 3), i + 1, "<i2").tobytes())
    seen = []
    query = stateful.start(api.stream(spark, str(folder), fs=10, channels=3), lambda df, n: seen.extend(df.collect()), str(tmp_path / "c"), once=True)
    query.awaitTermination()
    assert len(seen) == 120 and {round(r.v / (np.pi / 2**13)) for r in seen} == {1, 2}
    times = sorted(r.timestamp for r in seen if r.path.endswith("0.dat") and r.ch == 0)
    assert (times[-1] - times[0]).total_seconds() == pytest.approx(1.9)
    rows = spark.createDataFrame([(0, i, 0.001 * i) for i in range(1000)] + [(1, 0, 9.0)], "ch long, ti long, v double").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    m = stateful.metrics(rows, threshold=0.9).first()
    assert m.peak == 9.0 and m.n == 1001 and m.n_over == 100 and m.channels_over == 2 and np.isclose(m.p99_5, np.percentile([*(0.001 * np.arange(1000)), 9.0], 99.5))


def test_miniseed_reads_the_records_in_range(tmp_path, monkeypatch):
    from tests.test_sources import record

    x = np.arange(500)
    raw = b"".join(record(b"HHZ", i, 50, 3, x[50 * i : 50 * i + 50].astype(">i4").tobytes(), 50) for i in range(10))
    (tmp_path / "a.mseed").write_bytes(raw)
    m, decoded = arrays.MiniSeed(), []
    plain = m._decode
    monkeypatch.setattr(m, "_decode", lambda *a: decoded.append(1) or plain(*a))
    assert np.array_equal(m.block(str(tmp_path / "a.mseed"), 120, 140)[:, 0], x[120:140]) and len(decoded) <= 2
    assert np.array_equal(m.block(str(tmp_path / "a.mseed"), 0, 500)[:, 0], x)


def test_steim2():
    # a word of seven 4-bit and one of three 10-bit differences
    d = [0, 1, -2, 3, -4, 5, -6, 300, -400, 511]
    w7 = 2 << 30 | sum((v & 15) << (4 * (6 - i)) for i, v in enumerate(d[:7]))
    w3 = 3 << 30 | sum((v & 1023) << (10 * (2 - i)) for i, v in enumerate(d[7:]))
    frame = np.zeros((1, 16), np.uint32)
    frame[0, 0] = 3 << (30 - 6) | 2 << (30 - 8)
    frame[0, 1], frame[0, 3], frame[0, 4] = 1000, w7, w3
    assert arrays._steim(frame, 10, 2).tolist() == np.cumsum([1000, *d[1:]]).tolist()


def test_zarr_is_none_before_it_is_whole(spark, tmp_path):
    f = SignalFrame.from_array(spark, RNG.normal(size=(10, 2)), 5.0)
    api.write_zarr(f, str(tmp_path / "a.zarr"))
    with pytest.raises(ValueError):
        api.write_zarr(f, str(tmp_path / "a.zarr"))
    (tmp_path / "a.zarr" / "data" / ".zarray").unlink()
    with pytest.raises(ValueError):
        formats.FORMATS.scan(str(tmp_path / "a.zarr"))
    assert sorted(p.name for p in (tmp_path / "a.zarr" / "data").iterdir()) == ["0.0"]


def test_other_packages(spark, monkeypatch):
    class Trace:
        def __init__(self, data, header):
            self.data, self.stats = data, types.SimpleNamespace(**header)

    monkeypatch.setitem(sys.modules, "obspy", types.SimpleNamespace(Stream=list, Trace=Trace))
    monkeypatch.setitem(sys.modules, "dascore", types.SimpleNamespace(Patch=lambda **k: types.SimpleNamespace(**k)))
    x = RNG.normal(size=(30, 3))
    f = SignalFrame.from_array(spark, x, 10.0, 2.0, units="strain")
    stream = f.to_obspy()
    assert len(stream) == 3 and np.array_equal(stream[1].data, x[:, 1]) and stream[0].stats.sampling_rate == 10.0
    stream[2].data = stream[2].data[:20]
    back = SignalFrame.from_obspy(spark, stream).collect()
    assert np.array_equal(back[:20], x[:20]) and np.isnan(back[20:, 2]).all()
    with pytest.raises(ValueError):
        SignalFrame.from_obspy(spark, [])
    patch = f.to_dascore()
    assert patch.dims == ("time", "distance") and patch.data.shape == (30, 3) and patch.coords["distance"].tolist() == [0, 2, 4] and (patch.coords["time"][1] - patch.coords["time"][0]) == np.timedelta64(100, "ms")


def test_seconds_and_schemas(spark):
    x = RNG.normal(size=(100, 8))
    f = SignalFrame.from_array(spark, x, 10.0)
    assert np.array_equal(f.seconds(1.0, 3.5, [5, 2]).collect(), x[10:35, 2:6]) and np.array_equal(f.seconds(9.0).collect(), x[90:])
    tools = {t["function"]["name"]: t["function"] for t in chains.schemas()}
    assert set(tools) == chains.OPERATIONS and tools["bandpass"]["parameters"]["required"] == ["low", "high"] and tools["bandpass"]["parameters"]["properties"]["order"] == {"type": "integer", "default": 4}
    assert {t["name"] for t in chains.schemas("tool")} == chains.OPERATIONS and all("input_schema" in t for t in chains.schemas("tool"))


def proto(field, value):
    """A protocol buffer field: numbers as varints, the rest as bytes."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(field << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(field << 3 | 2) + varint(len(value)) + value


def test_models_with_onnx_and_steps_around(spark, tmp_path):
    dims = proto(1, proto(2, "n")) + proto(1, proto(2, "m"))
    io = lambda name: proto(1, name) + proto(2, proto(1, proto(1, 1) + proto(2, dims)))
    graph = proto(1, proto(1, "x") + proto(2, "y") + proto(4, "Abs")) + proto(2, "g") + proto(11, io("x")) + proto(12, io("y"))
    model = proto(1, 8) + proto(7, graph) + proto(8, proto(2, 13))
    (tmp_path / "abs.onnx").write_bytes(model)
    x = RNG.normal(size=(20, 4))
    f = SignalFrame.from_array(spark, x, 10.0)
    rows = {r.ch: r.output for r in f.predict(str(tmp_path / "abs.onnx"), before=lambda a: a * 2, after=lambda y: y.max(1, keepdims=True)).collect()}
    assert np.allclose([rows[c][0] for c in range(4)], 2 * abs(x).max(0), atol=1e-5)
    assert models.summary(f.predict(str(tmp_path / "abs.onnx"))).agg(F.sum("n")).first()[0] == 4
    assert pa is not None


def vectors(spark, path, n, size):
    """A table of embeddings: n vectors of so many components."""
    spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.col("id") * size + i).cast("float")).alias("embedding")).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def test_miniseed_of_many_channels_and_records(spark, tmp_path):
    (tmp_path / "wide").mkdir(), (tmp_path / "long").mkdir()
    for folder, n, size in (("wide", 100_100, 2), ("long", 3, 250)):
        rows = queries_files.miniseed_read(spark, vectors(spark, tmp_path / folder, n, size))
        assert rows.filter(F.col("v") != F.col("ch") * size + F.col("ti")).isEmpty() and rows.select("ch", "ti").distinct().count() == n * size


def test_miniseed_records_of_several_kinds(tmp_path):
    from tests.test_sources import record

    raw = [record(b"HHZ", i, 50, 3, np.arange(50 * i, 50 * i + 50).astype(">i4").tobytes(), 50) for i in range(40)]
    raw[20:30] = [record(b"HHZ", i, 50, 5, np.arange(50 * i, 50 * i + 50).astype(">f8").tobytes(), 50) for i in range(20, 30)]
    (tmp_path / "a.mseed").write_bytes(b"".join(raw))
    assert np.array_equal(arrays.MiniSeed().block(str(tmp_path / "a.mseed"), 0, 2000)[:, 0], np.arange(2000))


def test_tdms_index_of_many_channels(tmp_path):
    n = 60_000
    x = RNG.normal(size=(n, 2))
    (tmp_path / "a.tdms").write_bytes(b"".join(queries_files._tdms_head(2, n)) + x.astype("<f8").tobytes())
    start = time.process_time()
    scan = formats.FORMATS.scan(str(tmp_path / "a.tdms"))
    got = np.concatenate([v.to_numpy() for _, _, v in formats._pieces("TDMS", str(tmp_path / "a.tdms"), 0, 2, np.arange(n), {})])
    assert scan.n_channels == n and np.array_equal(got, x.T.ravel())
    assert time.process_time() - start < 10  # a list of the objects took their square


def test_tdms_read_is_not_collected(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SignalFrame, "collect", None)
    rows = queries_files.tdms_read(spark, vectors(spark, tmp_path, 50, 3))
    assert rows.filter(F.col("v") != F.col("ch") * 3 + F.col("ti")).isEmpty() and rows.count() == 150


def test_large_arrays_go_by_files(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from strataline import frame
    from strataline.sources import parts

    x = RNG.normal(size=(40, 7))
    x[3, 2] = np.nan
    plain = SignalFrame.from_array(spark, x, 10.0)
    monkeypatch.setattr(frame, "IN_MEMORY", 100)
    monkeypatch.setattr(parts, "PART", 50)
    monkeypatch.setattr(DataFrame, "toArrow", None)
    assert np.array_equal(plain.collect(), x, equal_nan=True)
    back = SignalFrame.from_array(spark, plain.collect(), 10.0)
    assert np.array_equal(back.collect(), x, equal_nan=True) and back.df.filter("v IS NULL").count() == 1
    some = SignalFrame(plain.df.filter("ch NOT IN (0, 4) AND ti > 9").withColumn("ch", F.col("ch") * 1000), 10.0)  # numbers with gaps are ranks
    assert np.array_equal(some.collect(), x[10:][:, [1, 2, 3, 5, 6]], equal_nan=True)


@pytest.mark.parametrize("name", ["dat_read", "netcdf_write_read", "scan_index", "segy_read", "spool_inventory", "spool_files"])
def test_file_queries_collect_nothing(spark, sf, monkeypatch, name):
    monkeypatch.setattr(SignalFrame, "collect", None)
    assert getattr(queries_files, name)(spark, sf).count() > 0
