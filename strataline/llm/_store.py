"""Intermediate tables in the folder that driver and executors share (``strataline.scratch``), and names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.scratch import Folder


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case, for helper columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers ``rows`` at a time, where the session still has Spark's own 10000.

    Texts are thousands of bytes: batches of 10000 would take much of a small worker's memory on both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


class Stored(Folder):
    """A table written to the shared folder."""

    def __init__(self, df: DataFrame, name: str, **options: str):
        super().__init__(df.sparkSession, name)
        df.write.options(**options).parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)
