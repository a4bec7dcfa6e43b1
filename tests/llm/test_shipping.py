"""Every operator in a session whose workers cannot import this package."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"
JOB = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def absent(batches):
    import importlib.util
    assert importlib.util.find_spec("turnmill") is None
    yield from batches

assert spark.range(3).mapInArrow(absent, "id long").count() == 3
sys.path.insert(0, {root!r})
import __spark_entry__
queries = __spark_entry__.queries()
for name in {names!r}:
    try:
        rows = queries[name](spark, {data!r}).collect()
    except Exception as error:
        print("FAILED", name, str(error)[-1500:])
    else:
        print("done", name, len(rows))
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_workers_need_no_copy_of_the_package(tmp_path):
    import __spark_entry__

    core = ["limit_tasks_ties", "holdout_split", "batch_plan", "metric_curve_growing", "import_limit"]
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline" or n in core]
    assert len(names) >= 15
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSTARTUP")}
    job = JOB.format(root=ROOT, names=names, data=DATA)
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    said = [line for line in done.stdout.splitlines() if line.startswith(("done", "FAILED"))]
    assert not [line for line in said if line.startswith("FAILED")], done.stdout[-4000:]
    assert [line.split()[1] for line in said] == names, done.stderr[-2000:]
