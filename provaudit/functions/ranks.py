"""Deterministic permutations: order rows by a hash of seed and id, ranked without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.plans.storage import written


def row_hash(seed: int | str, *cols: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def hash_rank(df: DataFrame, id_col: str, seed: int, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """0-based rank in hash order, within each `by` group.

    Rows fall into 4,096 buckets by the hash's first digits; ranks inside a bucket plus offsets of the buckets give
    the global rank, so no task sees more than a bucket.
    """
    by = by or []
    rows = df.withColumn("_h", row_hash(seed, id_col)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_col)) - 1
    ranked = rows.withColumn("_within", within).join(offsets, [*by, "_b"])
    return ranked.withColumn(out, F.col("_within") + F.col("_before")).drop("_h", "_b", "_within", "_before")


def ordered(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """df with place (0-based, in the order of `by`) and before (the sum of `size` over earlier rows), without a global window.

    Rows are dealt by ranges of `by` and written, so that a range keeps its rows; ranks and sums inside ranges plus offsets of
    ranges give the whole. The ranges themselves are few, so their window is in one task.
    """
    dealt = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_r", F.spark_partition_id()), "ordered")
    ranges = dealt.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"), F.sum(size).alias("_s"))
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_r", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_oc"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_os"))
    inside = Window.partitionBy("_r").orderBy(*by)
    out = dealt.withColumns({"_i": F.row_number().over(inside) - 1, "_u": F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return out.join(offsets, "_r").withColumns({"place": F.col("_oc") + F.col("_i"), "before": F.col("_os") + F.col("_u")}).drop("_r", "_oc", "_os", "_i", "_u")


def fold_of_rank(rank: Column, n: Column, k: int) -> Column:
    """Fold of a rank when n rows are cut into k folds and the first n mod k are one row larger."""
    q, m = F.floor(n / k), n % k
    big = m * (q + 1)
    small = m + F.floor((rank - big) / F.greatest(q, F.lit(1)))
    return F.when(rank < big, F.floor(rank / (q + 1))).otherwise(small).cast("long")
