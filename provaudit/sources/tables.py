"""Typed scans, partitioned and keyed sinks, fingerprints of inputs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provaudit.operators.relations import filter_target_present, lowcard_onehot


def src_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Typed CSV scan; without a schema the types come from one pass of casts over all rows."""
    if schema is not None:
        return spark.read.schema(schema).csv(path, header=True)
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in inferred_types(raw).items()])


#: Types tried for a text column, the narrowest first.
TYPES = ["bigint", "double", "timestamp", "boolean"]


def inferred_types(raw: DataFrame) -> dict[str, str]:
    """The narrowest type of each text column that every value of it can be cast to; string where none is, or all are missing.

    One aggregate counts failed casts of all columns and types; nothing is sampled.
    """
    failed = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull()).alias(f"f{i}_{j}") for i, c in enumerate(raw.columns) for j, kind in enumerate(TYPES)]
    r = raw.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(raw.columns)], *failed).first()
    return {c: next((kind for j, kind in enumerate(TYPES) if r[f"n{i}"] and not r[f"f{i}_{j}"]), "string") for i, c in enumerate(raw.columns)}


@dataclass
class Spec:
    """What a raw table is for: its target, the relation and proxy that tie rows together, and columns that must not be features.

    target LAST is the last column. proxy MIX ties rows that are equal in every column but the target.
    """

    path: str
    target: str
    relation: str | None = None
    proxy: str | None = None
    drop: list[str] = field(default_factory=list)
    most_levels: int = 12


LAST, MIX = "__last__", "__mix__"


def src_spec(spark: SparkSession, spec: Spec) -> DataFrame:
    """row_id, y, relation, proxy and the features of a raw CSV table, for rows whose target is a number.

    Features are all columns but target, relation, proxy and those to drop: numbers as they are, text of few values as 0/1 columns,
    other text left out. row_id numbers the rows in the order of the files; it is unique, not dense.
    """
    raw = spark.read.csv(spec.path, header=True)
    kinds = inferred_types(raw)
    target = raw.columns[-1] if spec.target == LAST else spec.target
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("nan"))
    ties = {"relation": text(spec.relation) if spec.relation else F.lit(None).cast("string")}
    if spec.proxy == MIX:
        ties["proxy"] = F.concat_ws("|", *[text(c) for c in raw.columns if c != target])
    else:
        ties["proxy"] = text(spec.proxy) if spec.proxy else F.lit(None).cast("string")
    features = [c for c in raw.columns if c not in {target, spec.relation, spec.proxy, *spec.drop}]
    numbers = [F.col(f"`{c}`").try_cast("double").alias(c) for c in features if kinds[c] in ("bigint", "double")]
    words = [c for c in features if kinds[c] not in ("bigint", "double")]
    rows = raw.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{target}`").try_cast("double").alias("y"), *[c.alias(k) for k, c in ties.items()], *numbers, *[F.col(f"`{c}`") for c in words])
    return filter_target_present(lowcard_onehot(rows, words, spec.most_levels), "y")


def src_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sink_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write a table, partitioned by the columns that later filters name."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def sink_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a result table as CSV with a header; arrays and structs become JSON text."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).csv(path, header=True)


def sink_summary(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows as (key, json): small keyed summaries."""
    rest = [c for c in df.columns if c not in key]
    return df.select(*key, F.to_json(F.struct(*rest)).alias("summary"))


#: Bytes of a file read at once.
CHUNK = 16_000_000


def input_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file under a path.

    Files are listed without their contents and read in chunks inside tasks, so a file may be of any size; Spark lists no empty
    ones. Where only Spark can open a path, files are read whole, at most 2 GB each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", "length")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                store, inside = opened(name)
                running = hashlib.sha256()
                with store.open_input_stream(inside) as stream:
                    while chunk := stream.read(CHUNK):
                        running.update(chunk)
                sums.append(running.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "length", "sha256"])

    first = listed.limit(1).first()
    if first is not None and opened(first.path) is None:
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return listed.repartition("path").mapInArrow(digest, "path string, length long, sha256 string")


def opened(name: str) -> tuple | None:
    """(file system, path in it) of a file that Spark lists, or None where only Spark can open it."""
    if name.startswith("file:"):
        return LocalFileSystem(), unquote("/" + name.removeprefix("file:").lstrip("/"))
    try:
        return FileSystem.from_uri(name)
    except (pa.ArrowException, OSError, ValueError):
        return None


def present_inputs(spark: SparkSession, path: str) -> DataFrame:
    """name of every Parquet table right in a folder, as a file or a folder of files of any names; lists files and reads none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/*.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string")
    return files.select(F.regexp_extract("path", r"([^/]+)\.parquet(?:/.*)?$", 1).alias("name")).distinct()


def skip_missing_input(registered: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Registered inputs with a note instead of a failure where one is absent."""
    here = present.select(on).distinct().withColumn("found", F.lit(True))
    return registered.join(here, on, "left").withColumn("note", F.when(F.col("found"), "read").otherwise("skipped: missing")).drop("found")
