"""Queries that run Python on workers find the package from any folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from postlake.plans import all_queries
for name in ("vector_topk", "stream_edits"):
    print(name, all_queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_runs_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["vector_topk", "True", "stream_edits", "True"], done.stderr[-2000:]
