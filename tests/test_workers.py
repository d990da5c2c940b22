import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from leaksieve import scan_files, stock_rules
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
files = spark.createDataFrame([("/a", "shpat_" + "a" * 32)], "path string, content string")
print("leaks:", scan_files(files, stock_rules(())).count())
"""


def test_workers_need_not_have_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=180,
    )
    assert "leaks: 1" in out.stdout, out.stderr[-2000:]
