import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ENTRY", e.entry(spark).count())
print("LOWPASS", e.queries()["lowpass"](spark, "/root/testdata/sf0.001").count())
print("KEYS", set(e.oracle_sql()) <= set(e.queries()), "lowpass" in e.queries())
"""


def test_entry_works_from_any_folder(tmp_path):
    """Workers get the package even if they start elsewhere."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ENTRY " in out.stdout and "ENTRY 0" not in out.stdout and "LOWPASS 32000" in out.stdout and "KEYS True True" in out.stdout, out.stderr[-2000:]
