import struct
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.frame import SignalFrame
from strataline.functions import timeutil, units
from strataline.operators import detect
from strataline.sources import catalog, formats, spool, synthetic

RNG = np.random.default_rng(1)


@pytest.fixture
def dat(tmp_path):
    raw = RNG.integers(-1000, 1000, (100, 10)).astype("<i2")
    path = tmp_path / "a.dat"
    path.write_bytes(raw.tobytes())
    return str(path), raw


def test_dat(spark, dat, monkeypatch):
    path, raw = dat
    monkeypatch.setattr(formats, "CELLS", 250)
    f = formats.read(spark, path, n_channels=10, fs=1000)
    assert f.fs == 1000 and f.unit == "rad/s" and np.allclose(f.collect(), raw * np.pi / 2**13)
    part = f.df.filter("ch = 3 AND ti >= 20 AND ti < 31")
    assert np.allclose([r.v for r in part.orderBy("ti").collect()], raw[20:31, 3] * np.pi / 2**13)
    with pytest.raises(ValueError):
        formats.FORMATS.scan(path)
    assert formats.FORMATS.scan(path, n_channels=10).n_samples == 100


def test_big_endian_and_write(spark, dat, tmp_path):
    _, raw = dat
    (tmp_path / "b.bin").write_bytes(raw.astype(">i2").tobytes())
    f = formats.read(spark, str(tmp_path / "b.bin"), n_channels=10, byte_order="big")
    assert np.allclose(f.collect(), raw * np.pi / 2**13)
    formats.write_dat(f, str(tmp_path / "c.dat"))
    assert (tmp_path / "c.dat").read_bytes() == raw.tobytes()
    f.write(str(tmp_path / "p"), channels_per_part=4)
    back = formats.read(spark, str(tmp_path / "p"), fs=5.0)
    assert back.fs == 5.0 and np.allclose(back.collect(), f.collect())


def test_segy(spark, tmp_path):
    x = RNG.normal(size=(50, 3)).astype(">f4")
    for code, data in ((5, x), (3, (x * 1000).astype(">i2"))):
        head = bytearray(3600)
        struct.pack_into(">H", head, 3216, 2000)
        struct.pack_into(">H", head, 3220, 50)
        struct.pack_into(">h", head, 3224, code)
        body = b"".join(bytes(240) + data[:, c].tobytes() for c in range(3))
        path = tmp_path / f"{code}.sgy"
        path.write_bytes(bytes(head) + body)
        f = formats.read(spark, str(path))
        assert f.fs == 500 and np.allclose(f.collect(), data.astype(float))
    assert np.allclose(formats._ibm(np.array([0x42640000, 0xC276A000], ">u4")), [100.0, -118.625])


def test_registry(tmp_path, dat):
    r = formats.Registry()

    class Own(formats.Format):
        name, extensions, priority = "OWN", (".dat",), 1

    assert r.detect(dat[0]) == "DAT" and r.detect(str(tmp_path / "none.dat")) is None
    r.register(Own())
    assert r.detect(dat[0]) == "OWN" and "OWN" in r.names() and ".dat" in r.extensions()
    r.unregister("own")
    assert r.detect(dat[0]) == "DAT"
    with pytest.raises(ValueError):
        r.get("none")
    (tmp_path / "x.h5").write_bytes(b"no")
    assert r.detect(str(tmp_path / "x.h5")) is None


def test_spool(spark, dat, tmp_path):
    index = synthetic.spool_rows(spark)
    assert [r.path for r in spool.overlap(index, "2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5").orderBy("path").collect()] == ["file_0000", "file_0001"]
    assert [r.path for r in spool.overlap(index, "2024-01-01 00:00:01", "2024-01-01 00:00:02").collect()] == ["file_0001"]
    assert spool.having(index, project="p0").count() == 2 and spool.having(index, project="p0", other=1).count() == 0
    inv = index.withColumn("inventory", F.lit('{"interrogator": {"model": "X"}, "custom_attrs": {"site": "A"}}'))
    assert spool.having(inv, model="X", site="A", project="p1").count() == 1
    assert [r.offset for r in spool.offsets(index).orderBy("path").collect()] == [0, 1000, 2000]
    rows = index.select("path", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ti"), F.lit(0).alias("ch"), F.substring("path", -1, 1).cast("double").alias("v"))
    joined = spool.concat(rows, index.withColumn("n_samples", F.lit(5).cast("long")))
    assert [r.v for r in joined.orderBy("ti").collect()] == [0.0] * 5 + [1.0] * 5 + [2.0] * 5
    (tmp_path / "bad.dat").write_bytes(b"1")
    listing = spark.createDataFrame([(dat[0],), (str(tmp_path / "bad.dat"),), ("seen",)], "path string")
    old = index.withColumn("path", F.lit("seen")).limit(1)
    new = spool.update(listing, old, lambda p: formats.scans(p, n_channels=10, fs=100))
    assert sorted(r.path for r in new.collect()) == sorted([dat[0], "seen"])
    assert spool.chunks(rows.filter("path = 'file_0000'"), 3, 1).groupBy("chunk").count().orderBy("chunk").collect()[0]["count"] == 3
    assert spool.within(rows.withColumn("x", F.col("ti") * 1.0), 1.0, 3.0).count() == 6


def test_catalog(spark, tmp_path):
    x = np.zeros((300, 3))
    x[20:30] = 2
    x[100:110, 1] = 3
    events = SignalFrame.from_array(spark, x, 100.0).trigger_detection(1.0)
    assert events.schema.simpleString() == catalog.empty(spark).schema.simpleString()
    both = catalog.add(events, events.withColumn("attrs", F.create_map(F.lit("k"), F.lit("v"))))
    catalog.write_csv(both, str(tmp_path / "e"))
    back = catalog.read_csv(spark, str(tmp_path / "e"))
    assert sorted(map(str, back.collect())) == sorted(map(str, both.collect()))
    assert detect.overlapping(events, "1970-01-01 00:00:00.95", "1970-01-01 00:00:02").count() == 1


def test_inventory(tmp_path):
    inv = catalog.inventory("P", acquisition={"start_time": "2024-01-01", "n_channels": 3}, fiber={"gauge_length": 10, "channel_spacing": 1})
    step = catalog.with_step(inv, "detrend", axis="time")
    assert not inv["processing_history"] and step["processing_history"][0]["parameters"] == {"axis": "time"}
    path = str(tmp_path / "i.json")
    catalog.to_json(step, path)
    assert catalog.from_json(path) == catalog.from_json(catalog.to_json(step)) == step
    with pytest.raises(ValueError):
        catalog.inventory("P")
    with pytest.raises(ValueError):
        catalog.inventory("P", acquisition={"n_channels": 3})


def test_time(spark):
    assert timeutil.to_time("2024-01-01T00:00:00") == datetime(2024, 1, 1, tzinfo=UTC) and timeutil.to_time(1.5) == datetime(1970, 1, 1, 0, 0, 1, 500000, tzinfo=UTC)
    assert timeutil.to_time(None) is None
    with pytest.raises(TypeError):
        timeutil.to_time([1])
    for text, ns in (("10s", 10**10), ("1.5h", 5400 * 10**9), ("500ms", 5 * 10**8), ("1D", 86400 * 10**9), ("2 min", 120 * 10**9), ("3μs", 3000)):
        assert timeutil.to_nanos(text) == ns
        assert spark.range(1).select(timeutil.nanos_column(F.lit(text))).first()[0] == ns
    assert timeutil.to_nanos(timedelta(seconds=1)) == 10**9 and timeutil.to_nanos(2, "ms") == 2 * 10**6
    assert spark.range(1).select(timeutil.nanos_column(F.lit("x"))).first()[0] is None
    assert timeutil.to_float(timedelta(minutes=1), "s") == 60 and timeutil.to_float(datetime(2024, 1, 2, tzinfo=UTC), "h", datetime(2024, 1, 1, tzinfo=UTC)) == 24
    for bad in (lambda: timeutil.to_nanos("5 parsecs"), lambda: timeutil.to_float(1, "x")):
        with pytest.raises(ValueError):
            bad()


def test_units():
    assert units.factor("km", "m") == 1000 and units.to_base(2, "ms") == 0.002 and units.quantity(1, "Hz") == (1.0, "Hz")
    with pytest.raises(ValueError):
        units.factor("m", "s")
    with pytest.raises(ValueError):
        units.unit("parsec")


def test_api(spark, tmp_path):
    from strataline import api

    for i in range(3):
        (tmp_path / f"{i}.dat").write_bytes(np.full((50, 4), i, "<i2").tobytes())
    (tmp_path / "notes.txt").write_text("x")
    index = api.open_spool(spark, str(tmp_path), str(tmp_path / "index"), n_channels=4, fs=100)
    assert index.count() == 3 and api.open_spool(spark, str(tmp_path / "*.dat"), str(tmp_path / "index"), n_channels=4).count() == 3
    (tmp_path / "3.dat").write_bytes(np.full((50, 4), 3, "<i2").tobytes())
    index = api.open_spool(spark, str(tmp_path), str(tmp_path / "index"), n_channels=4, fs=100)
    assert index.count() == 4
    whole = spool.to_frame(spark, index.withColumn("start_time", F.timestamp_seconds(F.substring("path", -5, 1).cast("long"))), n_channels=4, fs=100)
    assert whole.shape == (200, 4) and np.allclose(whole.collect()[::50, 0], np.arange(4) * np.pi / 2**13)
    assert api.detect_format(str(tmp_path / "0.dat")) == "DAT" and "DAT" in api.list_formats() and api.scan(str(tmp_path / "0.dat"), n_channels=4).n_samples == 50
    assert api.from_array(spark, np.ones((3, 2)), 5.0).fs == 5.0 and api.stream(spark).isStreaming and api.read(spark, str(tmp_path / "1.dat"), n_channels=4).shape == (50, 4)


def test_zarr_and_netcdf(spark, tmp_path):
    from strataline import api

    x = RNG.normal(size=(53, 7))
    f = SignalFrame.from_array(spark, x, 250.0, 2.0)
    api.write_zarr(f, str(tmp_path / "a.zarr"), samples=20, channels=3)
    api.write_netcdf(f, str(tmp_path / "a.nc"))
    for name, kind in (("a.zarr", "ZARR"), ("a.nc", "NETCDF")):
        back = api.read(spark, str(tmp_path / name))
        assert api.detect_format(str(tmp_path / name)) == kind and (back.fs, back.dx) == (250.0, 2.0) and np.allclose(back.collect(), x)
        part = back.df.filter("ti >= 19 AND ti < 42 AND ch = 4").orderBy("ti").collect()
        assert np.allclose([r.v for r in part], x[19:42, 4])


def record(name, second, rate, coding, body, n):
    head = bytearray(64)
    head[0:8] = b"000001D "
    head[8:13], head[13:15], head[15:18], head[18:20] = b"STA  ", b"  ", name, b"XX"
    struct.pack_into(">HHBBBBH", head, 20, 2024, 1, 0, 0, second, 0, 0)
    struct.pack_into(">Hhh", head, 30, n, rate, 1)
    head[39] = 1
    struct.pack_into(">HH", head, 44, 64, 48)
    struct.pack_into(">HHBBBB", head, 48, 1000, 0, coding, 1, 9, 0)
    return bytes(head) + body.ljust(448, b"\0")


def steim1(x):
    """Frames of one-byte differences, four a word."""
    d = np.diff(x, prepend=x[0]).astype(np.int8)
    words = [int.from_bytes(d[i : i + 4].tobytes().ljust(4, b"\0"), "big") for i in range(0, len(d), 4)]
    out, first = b"", True
    while words:
        room = 13 if first else 15
        part, words = words[:room], words[room:]
        lead = [int(x[0]) & 0xFFFFFFFF, int(x[-1]) & 0xFFFFFFFF] if first else []
        codes = [0, *([0] * len(lead)), *([1] * len(part))]
        codes += [0] * (16 - len(codes))
        out += struct.pack(">16I", sum(c << (30 - 2 * i) for i, c in enumerate(codes)), *lead, *part, *([0] * (15 - len(lead) - len(part))))
        first = False
    return out


def test_miniseed(spark, tmp_path):
    from strataline import api

    x = np.cumsum(RNG.integers(-100, 100, (100, 2)), 0)
    raw = record(b"HHZ", 0, 50, 3, x[:50, 0].astype(">i4").tobytes(), 50) + record(b"HHZ", 1, 50, 3, x[50:, 0].astype(">i4").tobytes(), 50)
    raw += record(b"HHN", 0, 50, 10, steim1(x[:, 1]), 100)
    (tmp_path / "a.mseed").write_bytes(raw)
    back = api.read(spark, str(tmp_path / "a.mseed"))
    assert back.fs == 50 and np.array_equal(back.collect(), x[:, ::-1].astype(float))
    assert api.scan(str(tmp_path / "a.mseed")).start_time.startswith("2024-01-01 00:00:00")
    (tmp_path / "b.mseed").write_bytes(record(b"HHZ", 0, 50, 3, x[:50, 0].astype(">i4").tobytes(), 50) + record(b"HHZ", 2, 50, 3, x[50:, 0].astype(">i4").tobytes(), 50))
    gap = api.read(spark, str(tmp_path / "b.mseed")).collect()[:, 0]
    assert len(gap) == 150 and np.allclose(gap[49:101], np.linspace(x[49, 0], x[50, 0], 52))
