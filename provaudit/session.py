"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if not getattr(sc, "_provaudit_shipped", False):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent).as_posix())
        path = os.path.join(tempfile.mkdtemp(prefix="provaudit-"), "provaudit.zip")
        Path(path).write_bytes(buffer.getvalue())
        sc.addPyFile(path)
        sc._provaudit_shipped = True
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
