"""Sessions whose cluster names no checkpoint folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from provaudit.llm.common import shared_dir as shared_folder, written
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = shared_folder(spark)
assert written(spark.range(3), "some").count() == 3 and shared_folder(spark) == first
"""


def test_tables_are_written_without_the_setting(tmp_path):
    root = Path(__file__).resolve().parent.parent.parent
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env=os.environ | {"PYTHONPATH": str(root), "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
