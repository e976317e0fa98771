"""Out-of-fold prediction: each fold's test rows predicted by a model of all other rows.

rows: (row_id, y, x...); assignment: (variant, row_id, fold). Training rows of a fold include rows that no fold tests.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provaudit.operators.boosting import learn_boosted


def by_row(rows: DataFrame, assignment: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Rows with their folds. Neither side is broadcast, however small its files are: both grow with the table."""
    return rows.join(assignment.hint("merge"), [*(scope or []), "row_id"])


def complement(rows: DataFrame, assignment: DataFrame, sums: dict[str, Column], by: list[str], scope: list[str] | None = None) -> DataFrame:
    """Sums over each fold's training rows, as totals less the fold's own: one pass, whatever the number of folds.

    scope: columns of rows and assignment within which folds complement each other (nested designs).
    """
    scope = scope or []
    tested = by_row(rows, assignment, scope).where("fold is not null")
    fold = tested.groupBy(*by, "fold").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    total = rows.groupBy(*scope).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    both = fold.join(total, scope) if scope else fold.crossJoin(F.broadcast(total))
    return both.select(*by, "fold", *[(F.col(k) - F.col(f"_{k}")).alias(k) for k in sums])


def learn_dummy_mean(rows: DataFrame, assignment: DataFrame, by: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Predict each fold by its training mean."""
    by = by or ["variant"]
    fit = complement(rows, assignment, {"n": F.lit(1), "sy": F.col("y")}, by, scope).select(*by, "fold", F.try_divide("sy", "n").alias("p"))
    on = [*(scope or []), "row_id"]
    return by_row(rows.select(*on, "y"), assignment, scope).join(fit, [*by, "fold"]).select(*by, F.lit("dummy").alias("model"), "fold", "row_id", "y", "p")


def learn_ridge1(rows: DataFrame, assignment: DataFrame, x: str = "x", alpha: float = 1.0, by: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Ridge on one standardised feature, in closed form from fold-wise sums."""
    by = by or ["variant"]
    v = F.col(x)
    s = complement(rows, assignment, {"n": F.lit(1), "sx": v, "sxx": v * v, "sy": F.col("y"), "sxy": v * F.col("y")}, by, scope)
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("sxx") / F.col("n") - mx * mx)
    sd = F.when(var > 1e-12, F.sqrt(var)).otherwise(F.lit(1.0))
    slope = (F.col("sxy") - F.col("n") * mx * my) / sd / (F.col("n") + alpha)
    fit = s.select(*by, "fold", mx.alias("mx"), my.alias("my"), sd.alias("sd"), slope.alias("slope"))
    on = [*(scope or []), "row_id"]
    joined = by_row(rows.select(*on, "y", x), assignment, scope).join(fit, [*by, "fold"])
    return joined.select(*by, F.lit("ridge").alias("model"), "fold", "row_id", "y", (F.col("my") + (F.col(x) - F.col("mx")) / F.col("sd") * F.col("slope")).alias("p"))


def learn_ridge(rows: DataFrame, assignment: DataFrame, features: list[str], alpha: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Ridge on standardised features: Gram sums per fold in Spark, one small solve per fold.

    A fold's sums are a few numbers for each pair of features; missing values must have been imputed.
    """
    by = by or ["variant"]
    d = len(features)
    sums = {"n": F.lit(1.0), "sy": F.col("y")} | {f"s{i}": F.col(a) for i, a in enumerate(features)} | {f"t{i}": F.col(a) * F.col("y") for i, a in enumerate(features)}
    sums |= {f"g{i}_{j}": F.col(features[i]) * F.col(features[j]) for i in range(d) for j in range(i, d)}
    names = list(sums)
    stats = complement(rows, assignment, sums, by)

    @F.udf("array<double>")  # one call a fold
    def solve(values):
        s = dict(zip(names, values))
        n = s["n"]
        mx, my = np.array([s[f"s{i}"] for i in range(d)]) / n, s["sy"] / n
        g = np.array([[s[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) - n * np.outer(mx, mx)
        sd = np.sqrt(np.maximum(np.diag(g) / n, 0))
        sd[sd < 1e-12] = 1.0
        b = (np.array([s[f"t{i}"] for i in range(d)]) - n * mx * my) / sd
        w = np.linalg.solve(g / np.outer(sd, sd) + alpha * np.eye(d), b) / sd
        return [float(my - w @ mx), *w.tolist()]

    fit = stats.select(*by, "fold", solve(F.array(*names)).alias("w"))
    joined = by_row(rows.select("row_id", "y", *features), assignment).join(fit, [*by, "fold"])
    p = F.col("w")[0] + sum(((F.col(a) * F.col("w")[i + 1]) for i, a in enumerate(features)), F.lit(0.0))
    return joined.select(*by, F.lit("ridge").alias("model"), "fold", "row_id", "y", p.alias("p"))


def class_log_scores(rows: DataFrame, assignment: DataFrame, features: list[str], classes: list, by: list[str], scope: list[str]) -> DataFrame:
    """Each tested row with (n, mean, variance) of its fold's training rows by class; classes in falling order of preference."""
    own = lambda c, v: F.when(F.col("y") == F.lit(c), v).otherwise(F.lit(0.0))
    sums = {}
    for i, c in enumerate(classes):
        sums[f"n{i}"] = F.when(F.col("y") == F.lit(c), 1).otherwise(0)
        for j, x in enumerate(features):
            sums |= {f"s{i}_{j}": own(c, F.col(x)), f"q{i}_{j}": own(c, F.col(x) * F.col(x))}
    on = [*scope, "row_id"]
    fit = complement(rows, assignment, sums, by, scope)
    return by_row(rows.select(*on, "y", *features), assignment, scope).join(fit, [*by, "fold"])


#: Added to every variance, so that a constant feature has one.
LEAST_VARIANCE = 1e-6


def learn_class_probabilities(rows: DataFrame, assignment: DataFrame, features: list[str], classes: list, by: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Out-of-fold label and confidence of two classifiers: Gaussian naive Bayes ("bayes") and the training shares ("prior").

    rows: (row_id, y, features...), y one of `classes`, a short list. Training moments of each class are totals less the
    fold's own, one pass for all folds. A class without training rows is never predicted; ties go to the class listed
    first; confidence, the largest probability, is rounded to six places, so that thresholds see the same number everywhere.
    """
    by, scope = by or ["variant"], scope or []
    joined = class_log_scores(rows, assignment, features, classes, by, scope)
    total = sum([F.col(f"n{i}") for i in range(1, len(classes))], F.col("n0"))

    def log_score(i: int, used: list[str]) -> Column:
        n, out = F.col(f"n{i}"), F.log(F.col(f"n{i}") / total)
        for j, x in enumerate(used):
            mean = F.col(f"s{i}_{j}") / n
            var = F.greatest(F.lit(0.0), F.col(f"q{i}_{j}") / n - mean * mean) + F.lit(LEAST_VARIANCE)
            out = out - (F.log(var) + (F.col(x) - mean) * (F.col(x) - mean) / var) / 2
        return F.when(n > 0, out)

    def predicted(model: str, used: list[str]) -> DataFrame:
        scored = joined.withColumn("_l", F.array(*[log_score(i, used) for i in range(len(classes))])).withColumn("_m", F.array_max("_l"))
        odds = F.aggregate(F.filter("_l", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m")))
        label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("_l", F.col("_m")).cast("int"))
        return scored.where("_m is not null").select(*by, F.lit(model).alias("model"), "fold", "row_id", "y", label.alias("label"), F.round(1 / odds, 6).alias("confidence"))

    return predicted("bayes", features).unionByName(predicted("prior", []))


def oof_predict(rows: DataFrame, assignment: DataFrame, features: list[str], make, name: str, read) -> DataFrame:
    """Fit a Spark ML learner for every (variant, fold) and predict its test rows.

    make() gives an unfitted learner on column `features`; read(transformed) the prediction columns. Folds are few; each is a job.
    """
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("row_id", "y", "features").repartition("row_id").sortWithinPartitions("row_id")
    out = []
    for r in assignment.where("fold is not null").select("variant", "fold").distinct().orderBy("variant", "fold").collect():
        own = assignment.where((F.col("variant") == r.variant) & (F.col("fold") == r.fold)).select("row_id")
        fitted = make().fit(data.join(own, "row_id", "left_anti"))
        got = read(fitted.transform(data.join(own, "row_id", "left_semi")))
        out.append(got.select(F.lit(r.variant).alias("variant"), F.lit(name).alias("model"), F.lit(r.fold).alias("fold"), "row_id", "y", *[c for c in got.columns if c not in ("row_id", "y")]))
    return reduce(DataFrame.unionByName, out)


def learn_rf_reg(rows: DataFrame, assignment: DataFrame, features: list[str], trees: int = 300, seed: int = 0) -> DataFrame:
    make = lambda: RandomForestRegressor(labelCol="y", numTrees=trees, seed=seed, maxDepth=5)
    return oof_predict(rows, assignment, features, make, "rf", lambda t: t.select("row_id", "y", F.col("prediction").alias("p")))


def learn_gbt_reg(rows: DataFrame, assignment: DataFrame, features: list[str], rounds: int = 20) -> DataFrame:
    """Boosted trees for every fold of every variant, grown together in one fit."""
    return learn_boosted(rows, assignment, features, rounds)


def learn_rf_clf(rows: DataFrame, assignment: DataFrame, features: list[str], trees: int = 300, seed: int = 0) -> DataFrame:
    """Predicted label and its probability."""
    make = lambda: RandomForestClassifier(labelCol="y", numTrees=trees, seed=seed, maxDepth=5)
    read = lambda t: t.select("row_id", "y", F.col("prediction").alias("label"), F.array_max(vector_to_array("probability")).alias("confidence"))
    return oof_predict(rows, assignment, features, make, "rf", read)


def score_refit(rows: DataFrame, outer: DataFrame, features: list[str], trees: int = 50) -> DataFrame:
    """Refit once per outer fold on all its training rows and score its test rows; thresholds come later."""
    return learn_rf_reg(rows, outer.withColumn("variant", F.lit("outer")), features, trees).drop("variant")
