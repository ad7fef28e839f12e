from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_points

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", "{root}/__spark_entry__.py")
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
query = module.queries()["chunk_by_boundary_model"]
print("rows", query(spark, "/root/testdata/sf0.001").count())
"""


def test_names():
    queries, twins = entry_points.queries(), entry_points.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) >= 90


def test_runs_from_another_folder(tmp_path):
    """The workers get the code even if it is not on their path."""
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, capture_output=True, text=True, timeout=200
    )
    assert "rows " in done.stdout, done.stderr[-2000:]
