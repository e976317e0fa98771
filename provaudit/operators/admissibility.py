"""Fold bounds, feasibility and ledgers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.functions.dealing import least_largest

#: A fold must hold from 5 % to 50 % of the rows.
LOWER_PCT, UPPER_PCT = 5, 50


def fold_bounds(n):
    """(L, U) in whole rows, by integer arithmetic."""
    return F.floor((n * LOWER_PCT + 99) / 100).cast("long"), F.floor(n * UPPER_PCT / 100).cast("long")


def fold_admissibility(structure: DataFrame, by: list[str]) -> DataFrame:
    """Verdict of each split from its fold structure (by, fold, n_train, n_test)."""
    n = F.col("n_train") + F.col("n_test")
    low, high = fold_bounds(n)
    rows = structure.withColumns({"n": n, "L": low, "U": high})
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("K"), F.max("n").alias("n"), F.max("L").alias("L"), F.max("U").alias("U"), F.sort_array(F.collect_list("n_test")).alias("test_sizes"),
        F.min(F.col("n_train") / F.col("n")).alias("train_fraction_min"), F.max(F.col("n_train") / F.col("n")).alias("train_fraction_max"),
        F.count_if(F.col("n_test") < F.col("L")).alias("folds_below_L"), F.count_if(F.col("n_test") > F.col("U")).alias("folds_above_U"),
    )
    return out.withColumn("admissible", (F.col("folds_below_L") == 0) & (F.col("folds_above_U") == 0))


def feasibility_map(groups: DataFrame, grid: DataFrame) -> DataFrame:
    """Can m groups of sizes n be dealt into K folds of [L, U] rows? One row per (k, num, den), U = n * num div den.

    groups: (label, n); grid: (k, num, den), a small parameter table. Blockers are necessary conditions.
    """
    s = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("m"), F.coalesce(F.max("n"), F.lit(0)).alias("w"))
    low, _ = fold_bounds(F.col("n"))
    rows = grid.crossJoin(F.broadcast(s)).withColumns({"L": low, "U": F.floor(F.col("n") * F.col("num") / F.col("den")).cast("long")})
    blocks = F.array(F.when(F.col("m") < F.col("k"), "m<K"), F.when(F.col("w") > F.col("U"), "max_w>U"), F.when(F.col("k") * F.col("U") < F.col("n"), "K*U<n"), F.when(F.col("k") * F.col("L") > F.col("n"), "K*L>n"))
    rows = rows.withColumn("blockers", F.array_compact(blocks))
    return rows.select("k", "num", "den", "U", "L", (F.size("blockers") == 0).alias("feasible"), F.array_join("blockers", "; ").alias("blocked_by"))


def feasibility_state(fmap: DataFrame) -> DataFrame:
    """feasible, blocked only by the bound, or impossible whatever the bound."""
    structural = F.col("blocked_by").contains("m<K") | F.col("blocked_by").contains("K*L>n")
    return fmap.withColumn("state", F.when(F.col("feasible"), "feasible").when(structural, "impossible").otherwise("bound"))


def min_feasible_bound(groups: DataFrame, ks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The smallest upper bound, as an exact ratio of rows, at which the groups can be dealt into K folds of L rows at least.

    groups: (by, label, n); ks: (k), a small parameter table. num is NULL where no such folds exist. certificate lists how many groups
    of which size each fold holds; proven is false where the search was given up and num is the best found. Sizes are counted
    first: no more distinct sizes than the root of twice the rows reach a task, whatever the number of groups.
    """
    by = by or []
    counts = groups.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.collect_list(F.struct("n", "c")).alias("sizes"))
    deal = F.udf(lambda k, sizes: dealt_folds(k, sizes), "num long, den long, proven boolean, certificate array<struct<fold:int,size:long,groups:long>>")  # one call a K
    out = counts.crossJoin(F.broadcast(ks.select(F.col("k").cast("long").alias("k")))).repartition(*by, "k").withColumn("x", deal("k", "sizes"))
    return out.select(*by, "k", "x.*")


def dealt_folds(k: int, sizes: list) -> tuple:
    flat = [r["n"] for r in sizes for _ in range(r["c"])]
    total = sum(flat)
    folds, proven = least_largest(flat, k, (total * LOWER_PCT + 99) // 100)
    if folds is None:
        return None, total, proven, None
    held = [(f, n, c) for f, own in enumerate(folds) for n, c in sorted(Counter(own).items())]
    return max(map(sum, folds)), total, proven, held


def inner_admissibility(inner: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounds and group certificate of every inner split (outer_fold, protocol, row_id, fold). labels: (row_id, label)."""
    by = ["outer_fold", "protocol"]
    n = inner.groupBy(*by).agg(F.count(F.lit(1)).alias("n_train"))
    folds = inner.join(labels, "row_id").groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n_test"), F.countDistinct("label").alias("g"))
    groups = inner.join(labels, "row_id").groupBy(*by).agg(F.countDistinct("label").alias("groups"))
    low, high = fold_bounds(F.col("n_train"))
    f = folds.join(n, by).withColumns({"L": low, "U": high}).groupBy(*by).agg(
        F.max("n_train").alias("n_train"), F.max("L").alias("L"), F.max("U").alias("U"), F.count(F.lit(1)).alias("K"), F.sort_array(F.collect_list("n_test")).alias("fold_sizes"),
        F.sort_array(F.collect_list("g")).alias("groups_per_fold"), F.bool_and(F.col("n_test").between(F.col("L"), F.col("U"))).alias("within_bounds"),
    )
    out = f.join(groups, by).withColumn("enough_groups", F.col("groups") >= F.col("K"))
    return out.withColumn("admissible", F.col("within_bounds") & F.col("enough_groups"))


def slack_summary(verdicts: DataFrame) -> DataFrame:
    """How close folds come to the bounds."""
    return verdicts.agg(F.min(F.array_min("test_sizes") - F.col("L")).alias("least_above_L"), F.max(F.array_max("test_sizes")).alias("largest_fold"), F.min("U").alias("U_min"), F.max("U").alias("U_max"))


def split_ledger(verdicts: DataFrame) -> DataFrame:
    """Executed, admissible and inadmissible splits, and the list of the latter."""
    bad = F.when(~F.col("admissible"), F.concat_ws("/", "dataset", "variant"))
    return verdicts.agg(F.count(F.lit(1)).alias("executed"), F.count_if("admissible").alias("admissible"), F.count_if(~F.col("admissible")).alias("inadmissible"), F.array_join(F.sort_array(F.collect_list(bad)), ",").alias("list"))


def inadmissible_structures(verdicts: DataFrame, structures: DataFrame) -> DataFrame:
    """Inadmissible splits and the distinct structures behind them. structures: (variant, structure)."""
    bad = verdicts.where(~F.col("admissible")).join(structures, "variant", "left").withColumn("structure", F.coalesce("structure", "variant"))
    return bad.agg(F.count(F.lit(1)).alias("splits"), F.countDistinct("dataset", "structure").alias("structures"))


def admissibility_ledger(contrasts: DataFrame, aliases: DataFrame) -> DataFrame:
    """From executed evaluations to distinct admissible ones. contrasts: (dataset, variant, model, split_admissible)."""
    per = contrasts.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("split_admissible").alias("a"))
    left = contrasts.where("split_admissible").join(aliases.select(F.col("alias").alias("variant")), "variant", "left_anti")
    counts = contrasts.agg(F.count(F.lit(1)).alias("executed"), F.count_if(~F.col("split_admissible")).alias("inadmissible"), F.count_if("split_admissible").alias("admissible"))
    distinct = left.agg(F.countDistinct("dataset", "variant", "model").alias("distinct_evaluations"))
    whole = per.agg(F.count_if(F.col("a") == 0).alias("variants_inadmissible"), F.count_if((F.col("a") > 0) & (F.col("a") < F.col("n"))).alias("variants_partly"))
    return counts.crossJoin(distinct).crossJoin(whole).withColumn("alias_evaluations", F.col("admissible") - F.col("distinct_evaluations"))
