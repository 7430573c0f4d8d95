import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import dsp
from strataline.streaming import stateful

RNG = np.random.default_rng(7)


@pytest.fixture
def batches(spark, tmp_path):
    """Samples of three channels in four files, one file a batch."""
    x = RNG.normal(size=(80, 3))
    for b in range(4):
        rows = [(c, i, float(x[i, c])) for i in range(20 * b, 20 * b + 20) for c in range(3)]
        spark.createDataFrame(rows, "ch long, ti long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stateful.use_rocksdb(spark)
    stream = spark.readStream.schema("ch long, ti long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return x, stream, tmp_path


def run(df, tmp_path, mode="append"):
    rows = []
    q = stateful.start(df, lambda b, _: rows.extend(b.collect()), str(tmp_path / "cp"), once=True, mode=mode)
    q.awaitTermination(120)
    return rows


def test_sos_over_batches_is_one_pass(batches):
    x, stream, tmp = batches
    sos = dsp.butter_sos(2, 10.0, "lowpass", 100.0)
    rows = run(stateful.sos_stream(stream, sos), tmp)
    want, _ = dsp.sos_filter(sos, x, dsp.steady_state(sos)[:, :, None])
    got = np.full(x.shape, np.nan)
    for r in rows:
        got[r.ti, r.ch] = r.v
    assert np.allclose(got, want)


def test_ring(batches):
    x, stream, tmp = batches
    rows = run(stateful.ring_stream(stream, 30), tmp, "update")
    last = {r.ch: r for r in sorted(rows, key=lambda r: r.last_ti)}
    assert {r.n for r in rows} == {20, 30}
    for c, r in last.items():
        assert r.full and (r.first_ti, r.last_ti) == (50, 79) and np.allclose(r["values"], x[50:, c])


def test_table_and_view(spark, batches):
    x, stream, tmp = batches
    stateful.to_table(stateful.sequential(lambda d: d.withColumn("v", F.col("v") * 2), lambda d: d.filter("ch < 2"))(stream), str(tmp / "out"), str(tmp / "cp2")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp / "out"))
    assert rows.count() == 160
    last = stateful.view(rows, 5).collect()
    assert len(last) == 10 and all(np.isclose(r.v, 2 * x[r.ti, r.ch]) for r in last)
    a, b = stateful.parallel(lambda d: d.filter("ch = 0"), lambda d: d.filter("ch = 1"))(rows)
    assert a.count() == b.count() == 80


def test_sessions_and_metrics(spark, tmp_path):
    hits = [0, 1, 2, 3, 60, 61, 200]
    rows = [(i % 3, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", 5.0 if i in hits else 0.1) for i in range(240)]
    df = spark.createDataFrame(rows, "ch long, ts string, v double").select("ch", F.to_timestamp("ts").alias("timestamp"), "v")
    batch = stateful.trigger_sessions(df, 1.0, "5 seconds").orderBy("start_time").collect()
    assert [r.n for r in batch] == [4, 2, 1]
    df.coalesce(1).sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = run(stateful.trigger_sessions(stream, 1.0, "5 seconds", "1 second"), tmp_path)
    assert {(r.start_time, r.n) for r in seen} <= {(r.start_time, r.n) for r in batch}
    assert stateful.metrics(df, "60 seconds").agg(F.max("peak")).first()[0] == 5.0


def test_simulation_is_endless(spark):
    df = stateful.simulate(spark, 100, 4)
    assert df.isStreaming and df.columns == ["ch", "ti", "timestamp", "v"]


def test_ring_buffers_share_blocks_of_channels(spark, tmp_path, monkeypatch):
    """Channels that come and go keep their own buffers; a call serves a block of them."""
    for b in range(3):
        rows = [(c, i, float(100 * c + i)) for i in range(20 * b, 20 * b + 20) for c in range(0, 400, 2) if (c + b) % 3]
        spark.createDataFrame(rows, "ch long, ti long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stateful.use_rocksdb(spark)
    stream = spark.readStream.schema("ch long, ti long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.ring_stream(stream, 30)
    assert "block" in out._jdf.queryExecution().analyzed().toString()
    last = {}
    for r in sorted(run(out, tmp_path, "update"), key=lambda r: r.last_ti):
        last[r.ch] = r
    assert len(last) == 200
    for c, r in last.items():
        want = [i for b in range(3) for i in range(20 * b, 20 * b + 20) if (c + b) % 3][-30:]
        assert (r.n, r.full, r.first_ti, r.last_ti) == (len(want), len(want) == 30, want[0], want[-1]) and r["values"] == [100.0 * c + i for i in want]
