"""Folders for data that a step leaves for later ones, where driver and executors both see them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, without a trailing slash.

    Where that is unset, a local folder is made and set if driver and executors are one machine (tests, a notebook);
    on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        if path.startswith("file:"):
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)


class Folder:
    """A path of its own in the shared folder; dropped by hand, or at the end of the process.

    What a lazy result still reads is never dropped by an operator.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.path = f"{shared_dir(spark)}/strataline/{name}-{uuid.uuid4().hex}"
        self._spark = spark
        atexit.register(remove, spark, self.path)

    def drop(self) -> None:
        remove(self._spark, self.path)
