"""Workers that do not have this folder still find the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,512]").config("spark.driver.memory", "600m").config("spark.executor.memory", "512m").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
print("rows", len(entry.queries()["greedy_matches"](spark, "/root/testdata/sf0.001").limit(3).collect()))
"""


def test_workers_import_the_package(tmp_path):
    (tmp_path / "run.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py", str(ROOT), str(tmp_path / "warehouse")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
