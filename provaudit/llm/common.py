"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provaudit.session import read_table, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(ship_package(spark), sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (tests), kept with the context."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_provaudit_folder", None):  # the setting itself cannot be changed in a running session
        sc._provaudit_folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    return sc._provaudit_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder: computed once, readable after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STATE: list = [None, None]


def worker_state(key=None, make=None):
    """What this Python worker keeps between tasks under `key`: one thing at a time, so the last operator's is given back first."""
    if _STATE[0] != key:
        _STATE[:] = [None, None]
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)  # freed memory goes back to the machine
        except (OSError, AttributeError):  # another C library
            pass
        if key is not None:
            _STATE[:] = [key, make()]
    return _STATE[1]


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; NULL ids hash as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str, most: int = 8_000_000):
    """Slices of a record batch whose texts hold about `most` bytes (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so extra columns of any name cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_count(df: DataFrame) -> int:
    return int(df.agg(F.count(F.lit(1))).first()[0])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, train, most: dict[int, int]) -> DataFrame:
    """(text, y) of at most most[y] labelled ids of each label y, drawn by a hash of the id over all labelled rows.

    docs: (doc_id, text). The drawn ids are few, so they are broadcast; an id with several texts gives its smallest, so the
    rows are as many as the ids. Texts stay on the executors.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(train).where("doc_id is not null").distinct()
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    out = None
    for y, n in most.items():
        drawn = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        out = drawn if out is None else out.union(drawn)
    rows = docs.join(F.broadcast(out), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "y")
