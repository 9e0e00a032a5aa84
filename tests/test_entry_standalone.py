"""The driver loads ``__spark_entry__`` by path, from any directory, with
its own session: executors must not need the package on their path."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF001

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(ROOT, '__spark_entry__.py')!r})
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
q = E.queries()
print("chunk_all", q["chunk_all"](spark, {SF001!r}).count())
print("knn_top3", q["knn_top3"](spark, {SF001!r}).count())
spark.stop()
"""


def test_queries_run_outside_the_repo():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(prefix="lectern-cwd-"),
                         env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = dict(line.split() for line in out.stdout.splitlines() if line.count(" ") == 1)
    assert int(lines["chunk_all"]) > 0 and int(lines["knn_top3"]) > 0
