"""Event catalogues as CSV, and inventories as nested JSON."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.detect import EVENT_SCHEMA

PARTS = {
    "fiber": ("gauge_length", "channel_spacing"),
    "interrogator": ("model", "sampling_rate"),
    "acquisition": ("start_time", "n_channels"),
}


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def add(events: DataFrame, more: DataFrame) -> DataFrame:
    return events.unionByName(more)


def write_csv(events: DataFrame, path: str) -> None:
    events.withColumn("attrs", F.to_json("attrs")).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = EVENT_SCHEMA.replace("map<string,string>", "string")
    return spark.read.option("header", True).schema(schema).csv(path).withColumn("attrs", F.from_json("attrs", "map<string,string>"))


def inventory(project_name: str, **parts) -> dict:
    """An inventory of the parts fiber, interrogator, acquisition, processing_history and custom_attrs, checked for what each needs."""
    for name, needs in PARTS.items():
        part = parts.get(name)
        if part is not None and (missing := [k for k in needs if part.get(k) is None]):
            raise ValueError(f"{name} lacks {', '.join(missing)}")
    if parts.get("acquisition") is None:
        raise ValueError("an inventory needs an acquisition")
    return {"project_name": project_name, "fiber": None, "interrogator": None, "processing_history": [], "custom_attrs": {}, **parts}


def with_step(inv: dict, operation: str, **parameters) -> dict:
    """A copy with a processing step added."""
    step = {"operation": operation, "parameters": parameters, "timestamp": datetime.now(UTC).isoformat()}
    return dict(inv, processing_history=[*inv["processing_history"], step])


def to_json(inv: dict, path: str | None = None) -> str:
    text = json.dumps(inv, default=str, indent=2)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def from_json(source: str) -> dict:
    """From JSON text, or from a file if the text is short and names one."""
    if len(source) < 256 and (source.endswith(".json") or os.path.exists(source)):
        with open(source, encoding="utf-8") as f:
            source = f.read()
    found = json.loads(source)
    return inventory(found.pop("project_name"), **found)
