"""Errors of out-of-fold predictions (variant, model, fold, row_id, y, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r2() -> Column:
    """1 - SSE / SST of a group; NULL where the target does not vary or has one row."""
    sst = F.var_pop("y") * F.count("y")
    return F.when(F.count("y") > 1, F.when(sst > 1e-12, 1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / sst))


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2)))


def mae() -> Column:
    return F.avg(F.abs(F.col("y") - F.col("p")))


def metric_pooled(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Pooled R2, RMSE and MAE over all out-of-fold rows."""
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r2().alias("pooled_r2"), rmse().alias("rmse"), mae().alias("mae"))


def metric_fold_r2(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of the folds' own R2."""
    folds = predictions.groupBy(*by, "fold").agg(r2().alias("r2"))
    return folds.groupBy(*by).agg(F.avg("r2").alias("fold_mean_r2"), F.stddev_pop("r2").alias("fold_sd_r2"), F.count(F.lit(1)).alias("n_folds"))


def control_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["variant", "model"]
    return metric_pooled(predictions, by).join(metric_fold_r2(predictions, by), by)


def metric_by_family(predictions: DataFrame, families: DataFrame, by: list[str]) -> DataFrame:
    """R2 of each family and over all, in one pass. families: (row_id, family)."""
    rows = predictions.join(families, "row_id")
    sets = rows.groupingSets([[*by, "family"], by], *by, "family").agg(F.count(F.lit(1)).alias("n"), r2().alias("r2"), F.grouping("family").alias("g"))
    return sets.select(*by, F.when(F.col("g") == 1, "all").otherwise(F.col("family")).alias("family"), "n", "r2")


def metric_same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two protocols on the rows that the first one tests, and the difference. a, b: (model, row_id, y, p)."""
    restricted = b.join(a.select("model", "row_id"), ["model", "row_id"], "left_semi")
    x = a.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r2().alias("r2_a"))
    y = restricted.groupBy("model").agg(r2().alias("r2_b"))
    return x.join(y, "model").withColumn("delta", F.col("r2_a") - F.col("r2_b"))


def weight_source_equal(predictions: DataFrame, sources: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every record equal against every source equal. sources: (row_id, source)."""
    by = by or ["variant", "model"]
    per = predictions.join(sources, "row_id").groupBy(*by, "source").agg(F.count(F.lit(1)).alias("k"), F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("sse"))
    out = per.groupBy(*by).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_sources"), (F.sum("sse") / F.sum("k")).alias("mse_record_weighted"), F.avg(F.col("sse") / F.col("k")).alias("mse_source_equal"))
    return out.withColumns({"rmse_record_weighted": F.sqrt("mse_record_weighted"), "rmse_source_equal": F.sqrt("mse_source_equal"), "ratio": F.try_divide("mse_source_equal", "mse_record_weighted")})


def metric_accuracy(classified: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and balanced accuracy over folds. classified: (by, fold, y, label)."""
    hit = (F.col("y") == F.col("label")).cast("double")
    folds = classified.groupBy(*by, "fold").agg(F.avg(hit).alias("a"))
    recalls = classified.groupBy(*by, "fold", "y").agg(F.avg(hit).alias("r")).groupBy(*by, "fold").agg(F.avg("r").alias("b"))
    return folds.join(recalls, [*by, "fold"]).groupBy(*by).agg(F.avg("a").alias("accuracy_mean"), F.stddev_pop("a").alias("accuracy_sd"), F.avg("b").alias("balanced_accuracy_mean"), F.stddev_pop("b").alias("balanced_accuracy_sd"), F.count(F.lit(1)).alias("K"))


def class_support(labels: DataFrame, assignment: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Classes in test and training rows of each fold, and the smallest test class. labels: (row_id, y)."""
    by = by or ["variant"]
    total = labels.groupBy("y").agg(F.count(F.lit(1)).alias("total"))
    cells = labels.join(assignment, "row_id").groupBy(*by, "fold", "y").agg(F.count(F.lit(1)).alias("test"))
    folds = cells.select(*by, "fold").distinct().crossJoin(F.broadcast(total))
    full = folds.join(cells, [*by, "fold", "y"], "left").withColumn("test", F.coalesce("test", F.lit(0)))
    return full.groupBy(*by, "fold").agg(F.count_if(F.col("test") > 0).alias("classes_test"), F.count_if(F.col("total") > F.col("test")).alias("classes_train"), F.min(F.when(F.col("test") > 0, F.col("test"))).alias("min_support"))
