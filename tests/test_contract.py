"""The driver contract from a foreign folder and a plain session."""

import subprocess
import sys
from pathlib import Path

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("contract", {str(ENTRY)!r})
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert contract.entry(spark).count() == 17
for name in ("encode_texts", "nearest_in_cells"):
    assert contract.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_python_workers_find_the_package(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, check=True, timeout=300)
