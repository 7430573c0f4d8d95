"""Model inference over traces, a batch of channels at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.layout import to_traces

_sessions: dict[bytes, object] = {}


def _onnx(model: bytes) -> Callable[[np.ndarray], np.ndarray]:
    import onnxruntime

    if model not in _sessions:
        _sessions.clear()
        _sessions[model] = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
    session = _sessions[model]
    name = session.get_inputs()[0].name
    return lambda x: session.run(None, {name: x.astype(np.float32)})[0]


Kernel = Callable[[np.ndarray], np.ndarray]


def predict(df: DataFrame, model: Kernel | str, before: Kernel | None = None, after: Kernel | None = None) -> DataFrame:
    """ch, output of each channel; an ONNX file is read on the driver and sent to each worker once.

    ``before`` prepares the (channels, samples) that the model gets, ``after`` takes what it gives.
    """
    raw: bytes | None = None
    if isinstance(model, str):
        with open(model, "rb") as f:
            raw = f.read()
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model if shared.value is None else _onnx(shared.value)
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                x = b.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
                y = f(x if before is None else before(x))
                out = np.asarray(y if after is None else after(y), float).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(list(out), pa.list_(pa.float64()))], names=["ch", "output"])

    return to_traces(df).select(F.col("ch").cast("long"), "v").mapInArrow(run, "ch long, output array<double>")


def summary(outputs: DataFrame) -> DataFrame:
    """Rows, least and greatest output, and how often each class (place of the greatest) comes first."""
    top = outputs.withColumn("class", F.array_position("output", F.array_max("output")) - 1)
    return top.groupBy("class").agg(F.count("*").alias("n"), F.min(F.array_min("output")).alias("least"), F.max(F.array_max("output")).alias("greatest"))
