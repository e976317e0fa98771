"""Selection policies side by side, cost sensitivity and influence of folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.operators.decisions import SETTING

BY = [*SETTING, "alpha"]


def pick(candidates: DataFrame) -> DataFrame:
    """Of feasible rules the one of most coverage, then least risk, then knob and model; else the least unsafe."""
    rule = F.struct("model", "knob", "n_released", "n_unsafe")
    order = F.struct((~F.col("feasible")).alias("f"), F.when(F.col("feasible"), -F.col("n_released")).otherwise(F.col("n_unsafe")).alias("a"), F.col("n_unsafe").alias("b"), F.col("knob").alias("k"), F.col("model").alias("m"))
    return candidates.groupBy(*BY).agg(F.min_by(rule, order).alias("rule"), F.count_if("feasible").alias("n_feasible"), F.count(F.lit(1)).alias("n_candidates"))


def as_policy(picked: DataFrame, prefix: str, mode) -> DataFrame:
    out = picked.withColumn(f"{prefix}_mode", mode)
    live = F.col(f"{prefix}_mode") != "refuse"
    return out.select(*BY, f"{prefix}_mode", F.when(live, F.col("rule.model")).alias(f"{prefix}_model"), F.when(live, F.col("rule.knob")).alias(f"{prefix}_knob"), F.when(live, F.col("rule.n_released")).otherwise(0).alias(f"{prefix}_released"), F.when(live, F.col("rule.n_unsafe")).otherwise(0).alias(f"{prefix}_unsafe"))


def policy_grouped(candidates: DataFrame) -> DataFrame:
    """G: always picks; a fallback where nothing is feasible."""
    return as_policy(pick(candidates), "G", F.when(F.col("n_feasible") > 0, "select").otherwise("fallback"))


def policy_grouped_refuse(candidates: DataFrame) -> DataFrame:
    """R: refuses where nothing is feasible."""
    return as_policy(pick(candidates), "R", F.when(F.col("n_feasible") > 0, "select").otherwise("refuse"))


def policy_audit(candidates: DataFrame, inner: DataFrame) -> DataFrame:
    """A: refuses unless the inner split is admissible and something is feasible; picks for itself."""
    design = [c for c in SETTING if c != "action_set"]  # both action sets stand on the same inner splits
    ok = inner.select(*design, F.col("admissible").alias("ok"))
    picked = pick(candidates).join(ok, design, "left")
    return as_policy(picked, "A", F.when(F.coalesce(F.col("ok"), F.lit(False)) & (F.col("n_feasible") > 0), "select").otherwise("refuse"))


def policy_compare(candidates: DataFrame, inner: DataFrame) -> DataFrame:
    """Both policies in every setting, and whether they agree."""
    counts = candidates.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("feasible").alias("n_feasible"))
    out = counts.join(policy_grouped(candidates), BY, "full").join(policy_audit(candidates, inner), BY, "full")
    same = F.col("G_model").eqNullSafe(F.col("A_model")) & F.col("G_knob").eqNullSafe(F.col("A_knob"))
    return out.withColumn("same_choice", same)


def policy_summary(compared: DataFrame) -> DataFrame:
    """Settings, disagreements and pooled counts by scenario, action set and protocol, and overall."""
    keys = ["scenario", "action_set", "protocol"]
    sets = compared.groupingSets([keys, []], *keys).agg(
        F.count(F.lit(1)).alias("settings"), F.count_if(~F.col("same_choice")).alias("differing"), F.count_if(F.col("n_feasible") == 0).alias("empty_feasible"), F.count_if(F.col("A_mode") == "refuse").alias("refused"),
        F.sum("G_released").alias("G_released"), F.sum("G_unsafe").alias("G_unsafe"), F.sum("A_released").alias("A_released"), F.sum("A_unsafe").alias("A_unsafe"), F.grouping("protocol").alias("g"),
    )
    return sets.withColumns({c: F.when(F.col("g") == 1, "all").otherwise(F.col(c)) for c in keys}).drop("g")


def utility_sensitivity(outer: DataFrame) -> DataFrame:
    """U = (A - E - lambda E) / N for both protocols: source minus random is base + coeff * lambda, in rows."""
    by = lambda p, c: F.sum(F.when(F.col("protocol") == p, F.col(c)).otherwise(0))
    out = outer.groupBy("scenario", "action_set", "alpha").agg(by("random", "n_test").alias("N"), by("random", "n_released").alias("A_rand"), by("random", "n_unsafe").alias("E_rand"), by("source", "n_released").alias("A_src"), by("source", "n_unsafe").alias("E_src"))
    out = out.withColumns({"dA": F.col("A_src") - F.col("A_rand"), "dE": F.col("E_src") - F.col("E_rand")})
    return out.withColumns({"base": F.col("dA") - F.col("dE"), "coeff": -F.col("dE")})


def utility_break_even(sensitivity: DataFrame) -> DataFrame:
    """The cost ratio at which protocols are even, where it is positive."""
    value = F.when(F.col("coeff") != 0, -F.col("base") / F.col("coeff"))
    return sensitivity.select("scenario", "action_set", "alpha", F.when(value > 0, value).alias("break_even"))


def fold_concentration(outer: DataFrame, alpha: int) -> DataFrame:
    """Unsafe and released rows by fold and protocol, and those avoided."""
    rows = outer.where(F.col("alpha") == alpha).groupBy("scenario", "action_set", "outer_fold").pivot("protocol", ["random", "source"]).agg(F.sum("n_unsafe").alias("u"), F.sum("n_released").alias("r"))
    return rows.select("scenario", "action_set", "outer_fold", F.col("random_u").alias("random"), F.col("source_u").alias("source"), (F.col("random_u") - F.col("source_u")).alias("avoided"), F.col("random_r").alias("released_random"), F.col("source_r").alias("released_source"))


def largest_fold_share(concentration: DataFrame) -> DataFrame:
    """The fold that avoids most, and its share of all avoided rows."""
    total, keys = F.sum(F.greatest("avoided", F.lit(0))), ["scenario", "action_set"]
    return concentration.groupBy(*keys).agg(F.min(F.struct((-F.col("avoided")).alias("m"), "outer_fold")).alias("b"), total.alias("t")).select(*keys, F.col("b.outer_fold").alias("outer_fold"), F.try_divide(-F.col("b.m"), F.col("t")).alias("share"))


def fold_influence(concentration: DataFrame) -> DataFrame:
    """Avoided unsafe rows of each fold and the released rows they cost."""
    return concentration.select("scenario", "action_set", "outer_fold", "avoided", (F.col("released_random") - F.col("released_source")).alias("coverage_cost"))
