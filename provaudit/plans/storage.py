"""Cutting lineage by tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one, kept with the context, only where none is set on a local master."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_provaudit_folder", None):
        sc._provaudit_folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    return sc._provaudit_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
