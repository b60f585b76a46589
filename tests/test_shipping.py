"""The registry must work from any working directory: workers get the package from the driver."""

import os
import subprocess
import sys

CODE = """
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", entry.queries()["a15_signature"](spark, {sf!r}).count())
"""


def test_kernels_run_from_another_directory(tmp_path, sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = CODE.format(path=os.path.join(root, "__spark_entry__.py"), sf=sf_dir)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS 12000" in done.stdout, done.stderr[-2000:]
