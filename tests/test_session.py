from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["route_files"](spark, {sf_dir!r}).count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path, sf_dir):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(entry=entry, sf_dir=sf_dir)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240,
    )
    assert "rows 200" in done.stdout, done.stderr[-2000:]
