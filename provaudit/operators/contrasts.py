"""Contrasts of honoured splits with their controls, from control metrics (variant, model, pooled_r2, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contrast_pairs(metrics: DataFrame, controls: DataFrame, random: str = "random5") -> DataFrame:
    """Honoured R2 beside random and size-matched R2. controls: (variant, sizematch), a small map of honoured variants."""
    r = metrics.where(F.col("variant") == random).select("model", F.col("pooled_r2").alias("r2_random5"))
    s = metrics.select(F.col("variant").alias("sizematch"), "model", F.col("pooled_r2").alias("r2_sizematch"))
    rows = metrics.join(controls, "variant").join(r, "model", "left").join(s, ["sizematch", "model"], "left")
    h = F.col("pooled_r2")
    return rows.select("variant", "model", "r2_random5", "r2_sizematch", h.alias("r2_honoured"), "fold_mean_r2", "fold_sd_r2", F.col("n_folds").alias("K"), (h - F.col("r2_random5")).alias("delta_vs_random"), (h - F.col("r2_sizematch")).alias("delta_vs_sizematch"))


def contrast_admissible(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    return pairs.join(verdicts.select("variant", F.col("admissible").alias("split_admissible")), "variant", "left")


def contrast_summary(pairs: DataFrame) -> DataFrame:
    """Degradations among admissible contrasts with a size match."""
    rows = pairs.where(F.col("split_admissible") & F.col("delta_vs_sizematch").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta_vs_sizematch") < 0).alias("degrades"), F.median("delta_vs_sizematch").alias("median_delta"), F.count_if(F.col("r2_honoured") < 0).alias("below_zero"))


def contrast_dummy_ref(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Attach the training mean's R2 of the same split."""
    d = metrics.where("model = 'dummy'").select("variant", F.col("pooled_r2").alias("r2_dummy"))
    return pairs.join(d, "variant", "left").withColumn("below_dummy", F.col("r2_honoured") < F.col("r2_dummy"))


def contrast_stratum(pairs: DataFrame, strata: DataFrame, dataset: str) -> DataFrame:
    """Stratum by (variant, dataset), else by (variant, "*"). strata: (variant, dataset, stratum), a small map."""
    own = strata.where(F.col("dataset") == dataset).select("variant", F.col("stratum").alias("own"))
    wild = strata.where("dataset = '*'").select("variant", F.col("stratum").alias("wild"))
    return pairs.join(own, "variant", "left").join(wild, "variant", "left").withColumn("stratum", F.coalesce("own", "wild")).drop("own", "wild")


def contrast_dealias(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Drop evaluations of a split that another name already has. aliases: (variant, alias)."""
    return pairs.join(aliases.select(F.col("alias").alias("variant")).distinct(), "variant", "left_anti")


def contrast_stratum_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("stratum").agg(F.count("delta_vs_sizematch").alias("n"), F.count_if(F.col("delta_vs_sizematch") < 0).alias("degrading"), F.median("delta_vs_sizematch").alias("median_delta"))


def contrast_worst(pairs: DataFrame) -> DataFrame:
    """The lowest honoured R2 of each variant and the model that has it."""
    return pairs.groupBy("variant").agg(F.min("r2_honoured").alias("worst_r2"), F.min_by("model", F.struct("r2_honoured", "model")).alias("model"))


def contrast_not_evaluated(pairs: DataFrame, places: int = 4) -> DataFrame:
    """Comparisons as text, with a label where there is none."""
    return pairs.select("variant", "model", F.coalesce(F.format_number(F.col("delta_vs_sizematch"), places), F.lit("not evaluated")).alias("comparison"))
