"""A training-corpus pipeline over `documents`: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
Filtering stages keep the rows of documents with all their columns; the last returns pieces with their places.

Of every stage: an empty table gives no rows; columns beyond those of documents are left out, whatever their names; NULL ids and
repeated rows are judged like any other (each row on its own, but for the near-duplicate stage); a text is judged whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provaudit.llm import packing, quality, simhash, toxicity
from provaudit.llm.common import shared_dir, table, written
from provaudit.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality ranking rejects: those that score below KEEP_AT.

    NULL texts score as empty ones do. A score at the threshold is kept. Without labelled rows of both kinds nothing
    is learned and all rows stay.
    """
    docs = docs.select(*COLUMNS)
    score = quality.score_column(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) >= quality.KEEP_AT)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents flagged as toxic: those that score FLAG_AT or more.

    NULL and empty texts have no window to flag. Without labelled rows of both kinds nothing is learned and all rows stay.
    """
    docs = docs.select(*COLUMNS)
    score = toxicity.score_column(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) < toxicity.FLAG_AT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of copies and near copies (five words, 0.8): the one with the smallest id.

    Rows are told apart by hashes of all their columns, not by their ids: NULL ids come last, equal ids are ordered by
    that hash, and rows equal in every column are one.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    # NULLs leave a hash as it was, so which columns are NULL is hashed too.
    parts = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    rows = docs.withColumn("row", F.concat_ws("-", F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)))
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("id"), "text")
    first = simhash.near_duplicates(named, "id").where("id.row = component_id.row").select("id.row").distinct()
    return rows.join(first, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left into sequences.

    NULL and empty texts become the end mark alone; repeated rows are packed each; longer documents are cut into whole sequences.
    """
    ship_package(spark)
    return packing.packed(docs, "byte_bpe_50k.json")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: No stage can be stated in SQL. Tests hold the near-duplicate stage against all pairs of texts, and the scores and the packing
#: behind the other stages against plain recomputations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
