"""Brings this package to Python workers that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def found_by_workers() -> bool:
    """Whether workers start where the package lies, or look there by PYTHONPATH."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and os.path.realpath(p) == os.path.realpath(ROOT) for p in places)


def ship(spark: SparkSession) -> None:
    """Send the package's source files along with the session's tasks, once, where workers need them."""
    sc = spark.sparkContext
    if getattr(sc, "_strataline_shipped", False) or found_by_workers():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="strataline-"), "strataline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "strataline")):
            for n in names:
                if n.endswith(".py"):
                    file = os.path.join(folder, n)
                    z.write(file, os.path.relpath(file, ROOT))
    sc.addPyFile(path)
    sc._strataline_shipped = True
