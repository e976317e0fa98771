"""Registry, profiling, keys and feature design."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.functions.order_statistics import quantiles

#: Words that mark a split role, not a provenance group.
ROLE_WORDS = ["random_fold", "held_out_source", "held_out"]


def corpus_rollup(assets: DataFrame, records: str = "records", in_analysis: str = "in_analysis") -> DataFrame:
    """Assets and records overall, in analysis and inventory only."""
    return assets.rollup(in_analysis).agg(F.count(F.lit(1)).alias("assets"), F.sum(records).alias("records"), F.grouping(in_analysis).alias("g")).select(
        F.when(F.col("g") == 1, "all").when(F.col(in_analysis), "analysis").otherwise("inventory").alias("part"), "assets", "records"
    )


def relation_label(c: Column | str) -> Column:
    """A relation as text; a missing relation is one group of its own."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("nan"))


def composite_key(*cols: str) -> Column:
    return F.concat_ws("|", *[relation_label(c) for c in cols])


def combination_key(a: str, b: str) -> Column:
    return F.concat_ws(" || ", relation_label(a), relation_label(b))


def config_profile(df: DataFrame, by: list[str], target: str, relation: str, role_words: list[str] | None = None) -> DataFrame:
    """Rows before and after the target filter, groups, rows with a role word and rows without a relation."""
    has = F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))
    role = F.lower(F.col(relation).cast("string")).isin(role_words or ROLE_WORDS)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(has).alias("n_analytic"), F.count_if(~has).alias("n_dropped_missing_target"),
        F.countDistinct(F.when(has & ~F.coalesce(role, F.lit(False)), F.col(relation))).alias("groups_postfilter"), F.count_if(role).alias("role_value_rows"), F.count_if(F.col(relation).isNull()).alias("missing_relation_rows"),
    )


def role_value_guard(df: DataFrame, relation: str, role_words: list[str] | None = None) -> DataFrame:
    return df.agg(F.count_if(F.lower(F.col(relation).cast("string")).isin(role_words or ROLE_WORDS)).alias("role_rows"), F.count(F.lit(1)).alias("n_rows"))


def registry_enrich(registry: DataFrame, metadata: DataFrame, on: str) -> DataFrame:
    """Attach asset metadata, one row per key, by a left join that Spark may broadcast by size."""
    return registry.join(metadata.dropDuplicates([on]), on, "left")


def registry_admissible_ratio(registry: DataFrame, verdicts: DataFrame, on: str = "dataset") -> DataFrame:
    """How many of a dataset's splits are admissible, as numbers and as "a/t"."""
    got = verdicts.groupBy(on).agg(F.count_if("admissible").alias("a"), F.count(F.lit(1)).alias("t"))
    out = registry.join(got, on, "left").fillna(0, ["a", "t"])
    return out.withColumn("admissible_splits", F.concat_ws("/", F.col("a").cast("string"), F.col("t").cast("string"))).drop("a", "t")


def alias_assets(studies: DataFrame, study: str, asset: str) -> DataFrame:
    """Studies, distinct assets, and studies whose asset another one uses as well."""
    n = studies.select(study, asset).distinct().groupBy(asset).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("studies"), F.count(F.lit(1)).alias("assets"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("sharing"))


def dup_key_profile(df: DataFrame, key: Column) -> DataFrame:
    """Records, duplicate groups and singletons of a key, as shares of groups and of records."""
    n = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = n.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_records"))
    least = F.greatest(F.lit(0), 2 * F.col("groups") - F.col("records"))
    return s.select("records", "groups", "singletons", least.alias("singletons_at_least"), (1 - F.try_divide("singletons", "groups")).alias("group_share"), F.try_divide("repeated_records", "records").alias("record_share"))


def target_label_table(df: DataFrame, label: str, designated=None) -> DataFrame:
    """Records of each label code, and whether it is the designated one (the smallest unless given)."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("records"))
    chosen = F.lit(designated) if designated is not None else None
    if chosen is None:
        return n.crossJoin(n.agg(F.min(label).alias("_d"))).select(label, "records", (F.col(label) == F.col("_d")).alias("designated"))
    return n.select(label, "records", (F.col(label) == chosen).alias("designated"))


def drop_leak_columns(df: DataFrame, *names: str) -> DataFrame:
    """Features only: drop target, relations, proxies and declared leaks."""
    return df.drop(*names)


def coerce_numeric(*cols: str) -> dict[str, Column]:
    """Text to double, NULL where it is no number; for withColumns."""
    return {c: F.col(c).try_cast("double") for c in cols}


def filter_target_present(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target).cast("double")
    return df.where(y.isNotNull() & ~F.isnan(y))


def few_values(df: DataFrame, columns: list[str], most: int = 12) -> dict[str, list[str] | None]:
    """The distinct non-NULL values of each string column, sorted, or None where there are more than `most`.

    Sets grow to most + 1 values within partitions and are then only known to be large, so one pass sends at most that many
    values of each column from each partition, whatever the number of columns.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set] = {c: set() for c in columns}
        for batch in batches:
            for c, column in zip(columns, batch.columns):
                if len(held[c]) <= most:
                    held[c].update(x for x in pc.unique(column).to_pylist() if x is not None)
        pairs = [(c, v) for c in columns for v in sorted(held[c])[: most + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["column", "value"])

    seen = df.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(local, "column string, value string").distinct()
    first = seen.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("r") <= most + 1)
    found: dict[str, list] = {c: [] for c in columns}
    for r in first.collect():  # most + 1 values a column
        found[r["column"]].append(r["value"])
    return {c: sorted(v) if len(v) <= most else None for c, v in found.items()}


def lowcard_onehot(df: DataFrame, columns: list[str], most: int = 12) -> DataFrame:
    """String columns of at most `most` values become 0/1 columns, one for NULL as well; others are dropped."""
    new = {}
    for c, levels in few_values(df, columns, most).items() if columns else ():
        if levels is not None:
            for v in levels:
                new[f"{c}={v}"] = F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
            new[f"{c}=NA"] = F.col(c).isNull().cast("double")
    return df.withColumns(new).drop(*columns)


def log_exp_rule(demand: Column, margin: Column) -> Column:
    """The threshold on the log scale that a margin over a physical demand stands for."""
    return F.log(demand) + F.log1p(margin)


def round_display(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.bround(c, p) for c, p in places.items()})


def train_median(rows: DataFrame, feature: str, by: list[str], fold: str = "fold") -> DataFrame:
    """Median of a feature over the training rows of each fold. rows has each row once with its test fold, which trains in all others."""
    return quantiles(rows, feature, [0.5], by, fold).select(*by, fold, F.col("value").alias("median"))


def train_moments(rows: DataFrame, feature: str, by: list[str], fold: str = "fold") -> DataFrame:
    """Mean and population deviation over the training rows of each fold, as totals less the fold: one pass over the rows.

    Sums of squares are taken about a rough centre of all rows, so that little is lost in the differences.
    """
    centre = F.coalesce(F.lit(rows.agg(F.avg(feature)).first()[0]), F.lit(0.0))
    x = F.col(feature) - centre
    sums = [F.count(feature).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q")]
    own = rows.groupBy(*by, fold).agg(*sums)
    total = own.groupBy(*by).agg(*[F.sum(c).alias(f"_t{c}") for c in ("_n", "_s", "_q")])
    both = own.join(total, by) if by else own.crossJoin(F.broadcast(total))
    n, s, q = (F.col(f"_t{c}") - F.coalesce(F.col(c), F.lit(0)) for c in ("_n", "_s", "_q"))
    mean = F.try_divide(s, n)
    return both.select(*by, fold, (mean + centre).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q, n) - mean * mean)).alias("sd"))


def train_median_impute(rows: DataFrame, feature: str, by: list[str], fold: str = "fold") -> DataFrame:
    """Test rows of each fold with missing values replaced by the training median."""
    stats = train_median(rows, feature, by, fold)
    return rows.join(stats, [*by, fold]).withColumn(feature, F.coalesce(F.col(feature), F.col("median"))).drop("median")


def train_standardise(rows: DataFrame, feature: str, by: list[str], fold: str = "fold") -> DataFrame:
    """Test rows of each fold in units of the training mean and population deviation."""
    stats = train_moments(rows, feature, by, fold)
    return rows.join(stats, [*by, fold]).withColumn(feature, F.try_divide(F.col(feature) - F.col("mean"), F.col("sd"))).drop("mean", "sd")
