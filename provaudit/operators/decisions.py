"""Release decisions: rules chosen on inner folds, realised on outer folds.

Every table has the dimensions (scenario, action_set). A regression scenario acts by a margin on (outer_fold, protocol, model, row_id,
y, p), y and p on the log scale; a category scenario acts by confidence on (..., y, label, confidence), with an action set that
releases whatever is confident and one that never releases what is predicted to be designated. Counts stay integers, so
targets and ties are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.functions.order_statistics import quantiles

SETTING = ["scenario", "action_set", "outer_fold", "protocol"]
#: Keys of pooled tables: all of a setting but the fold, and the target.
POOLED = ["scenario", "action_set", "protocol", "alpha"]
#: Names of the action sets.
MARGIN, CONFIDENT, NOT_DESIGNATED = "act_on_margin", "act_on_confidence", "release_when_not_designated"
ALPHAS = [5, 10, 20]


def demand_quantile(train: DataFrame, by: list[str], q: float | list[float] = 0.5) -> DataFrame:
    """The physical demand: a quantile of exp(y) over each training set; an array of them for a list of quantiles."""
    qs = q if isinstance(q, list) else [q]
    found = quantiles(train, F.exp("y"), qs, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("_v"))
    values = F.transform("_v", lambda v: v["value"])  # in the order of the quantiles
    return found.select(*by, F.array(*[values[sorted(set(qs)).index(x)] for x in qs]).alias("demand") if isinstance(q, list) else values[0].alias("demand"))


def demand_of_complement(rows: DataFrame, outer: DataFrame, q: float = 0.5) -> DataFrame:
    """outer_fold, demand: the quantile of exp(y) over the rows of all other outer folds, which are counted once."""
    own = rows.select("row_id", "y").join(outer.select("row_id", F.col("fold").alias("outer_fold")).hint("merge"), "row_id", "left")
    return quantiles(own, F.exp("y"), [q], fold="outer_fold").select("outer_fold", F.col("value").alias("demand"))


def rule_grid(spark, kind: str = "margin") -> DataFrame:
    """knob (in hundredths): margins 0 to 100 by 5, or confidences 0 to 100 by 20."""
    step = 5 if kind == "margin" else 20
    return spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step))).alias("knob"))


def act_regression(knob: Column) -> Column:
    return F.col("p") >= F.log("demand") + F.log1p(knob / 100)


def unsafe_regression() -> Column:
    return F.exp("y") < F.col("demand")


def act_confidence(knob: Column) -> Column:
    return F.col("confidence") * 100 >= knob


def act_not_designated(knob: Column, designated: Column) -> Column:
    return act_confidence(knob) & (F.col("label") != designated)


def unsafe_category(designated: Column) -> Column:
    return F.col("y") == designated


def act_category(knob: Column, designated: Column) -> Column:
    """The condition of the row's own action set."""
    return F.when(F.col("action_set") == CONFIDENT, act_confidence(knob)).otherwise(act_not_designated(knob, designated))


def with_action_sets(rows: DataFrame) -> DataFrame:
    """Rows of a category scenario once for either action set."""
    return rows.withColumn("action_set", F.explode(F.array(F.lit(CONFIDENT), F.lit(NOT_DESIGNATED))))


def by_rule(rows: DataFrame, by: list[str], knobs: list[int], counts: dict) -> DataFrame:
    """by, knob and counts of every rule: one aggregation with a few columns a rule, so rows times rules never exist.

    counts: name -> function from a knob (a column) to the condition that is counted.
    """
    cells = rows.groupBy(*by).agg(*[F.count_if(f(F.lit(k))).alias(f"{c}_{k}") for k in knobs for c, f in counts.items()])
    rule = F.explode(F.array(*[F.struct(F.lit(k).alias("knob"), *[F.col(f"{c}_{k}").alias(c) for c in counts]) for k in knobs])).alias("rule")
    return cells.select(*by, rule).select(*by, "rule.*")


def unit_check(rows: DataFrame, knobs: list[int]) -> DataFrame:
    """Rows on which the rule on the log scale and on the physical scale disagree, by margin."""
    physical = lambda knob: F.exp("p") >= F.col("demand") * (1 + knob / 100)
    return by_rule(rows, [], knobs, {"n": lambda knob: F.lit(True), "mismatches": lambda knob: act_regression(knob) != physical(knob)})


def risk_block(rows: DataFrame, by: list[str]) -> DataFrame:
    """Tested, released and unsafe rows, risk over all and over released, coverage. rows: (by, act, unsafe)."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.count_if("act").alias("n_released"), F.count_if(F.col("act") & F.col("unsafe")).alias("n_unsafe"))
    return with_rates(out)


def with_rates(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"r_all": F.try_divide("n_unsafe", "n_test"), "r_released": F.try_divide("n_unsafe", "n_released"), "coverage": F.try_divide("n_released", "n_test")})


def risk_curve(rows: DataFrame, by: list[str], knobs: list[int], act) -> DataFrame:
    """The block of every rule of the grid, without rows times rules.

    A row is released by the first so many knobs (thresholds rise with the knob): rows are counted by that number, and
    running sums from the strictest rule down give every block. act(knob) is the release condition.
    """
    passes = sum((act(F.lit(k)).cast("int") for k in knobs), F.lit(0))
    cells = rows.withColumn("passes", passes).groupBy(*by, "passes").agg(F.count(F.lit(1)).alias("n"), F.count_if("unsafe").alias("u"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n_test"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("knob")) for i, k in enumerate(knobs)])).alias("_rule")
    rules = total.select(*by, "n_test", grid).select(*by, "n_test", "_rule.i", "_rule.knob")
    got = rules.join(cells, by).groupBy(*by, "knob", "n_test").agg(F.sum(F.when(F.col("passes") > F.col("i"), F.col("n")).otherwise(0)).alias("n_released"), F.sum(F.when(F.col("passes") > F.col("i"), F.col("u")).otherwise(0)).alias("n_unsafe"))
    return with_rates(got)


def rule_candidates(curve: DataFrame, alphas: list[int] = ALPHAS) -> DataFrame:
    """Every rule under every target (in per cent), feasible where unsafe rows stay within it."""
    targets = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    rows = curve.select("*", targets)
    return rows.withColumn("feasible", F.col("n_unsafe") * 100 <= F.col("alpha") * F.col("n_test"))


def rule_select(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of feasible rules the one that releases most, then the smaller knob, then the model's name."""
    by = by or [*SETTING, "alpha"]
    rule = F.struct("model", "knob", "n_test", "n_released", "n_unsafe", "r_all", "coverage")
    order = F.struct((-F.col("n_released")).alias("o"), F.col("knob").alias("k"), F.col("model").alias("m"))
    return candidates.where("feasible").groupBy(*by).agg(F.min_by(rule, order).alias("rule"), F.count(F.lit(1)).alias("n_feasible"))


def rule_fallback(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of all rules the one with least unsafe rows, then model and knob."""
    by = by or [*SETTING, "alpha"]
    rule = F.struct("model", "knob", "n_test", "n_released", "n_unsafe", "r_all", "coverage")
    order = F.struct(F.col("n_unsafe").alias("o"), F.col("model").alias("m"), F.col("knob").alias("k"))
    return candidates.groupBy(*by).agg(F.min_by(rule, order).alias("rule"))


def rule_choose(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The selected rule, or the fallback marked as not released."""
    by = by or [*SETTING, "alpha"]
    best = rule_select(candidates, by).withColumnRenamed("rule", "best")
    out = rule_fallback(candidates, by).join(best, by, "left").withColumn("released", F.col("best").isNotNull()).withColumn("r", F.coalesce("best", "rule"))
    return out.select(*by, "released", F.coalesce("n_feasible", F.lit(0)).alias("n_feasible"), F.col("r.model").alias("model"), F.col("r.knob").alias("knob"), F.col("r.r_all").alias("inner_r_all"), F.col("r.coverage").alias("inner_coverage"))


def decision_outer(chosen: DataFrame, outer: DataFrame, also: list[str] | None = None, act=act_regression, unsafe: Column | None = None) -> DataFrame:
    """What each chosen rule does on the outer test rows. outer: (outer_fold, model, ...) with what act(knob) and unsafe read; also: further keys of both."""
    also = also or []
    rows = chosen.join(outer, [*also, "outer_fold", "model"])
    acted = rows.withColumns({"act": F.col("released") & act(F.col("knob")), "unsafe": unsafe_regression() if unsafe is None else unsafe})
    blocks = risk_block(acted, [*also, *SETTING, "alpha", "released", "n_feasible", "model", "knob", "inner_r_all", "inner_coverage"])
    return blocks.withColumns({"gap_r_all": F.col("r_all") - F.col("inner_r_all"), "target_met": F.col("n_unsafe") * 100 <= F.col("alpha") * F.col("n_test")})


def decision_fold_means(outer: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or POOLED
    return outer.groupBy(*by).agg(
        F.avg("inner_r_all").alias("estimate"), F.avg("r_all").alias("realised"), F.avg("gap_r_all").alias("gap"), F.count_if(F.col("gap_r_all") > 0).alias("folds_above_estimate"), F.count_if("target_met").alias("folds_meeting"), F.avg("coverage").alias("mean_coverage"), F.avg("r_released").alias("mean_r_released")
    )


def decision_pooled(outer: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or POOLED
    sums = outer.groupBy(*by).agg(F.sum("n_test").alias("n_test"), F.sum("n_released").alias("n_released"), F.sum("n_unsafe").alias("n_unsafe"))
    return with_rates(sums)


def identity_check(outer: DataFrame, by: list[str] | None = None) -> DataFrame:
    """r_all = coverage * r_released: what is left of it pooled, and over means of folds."""
    by = by or POOLED
    pooled = decision_pooled(outer, by).select(*by, (F.col("r_all") - F.col("coverage") * F.col("r_released")).alias("pooled_gap"))
    means = outer.groupBy(*by).agg((F.avg("r_all") - F.avg("coverage") * F.avg("r_released")).alias("mean_gap"))
    return pooled.join(means, by)


def protocol_compare(outer: DataFrame) -> DataFrame:
    """Pooled realised risk by protocol for each target, in rows and as a difference."""
    p = decision_pooled(outer).groupBy("scenario", "action_set", "alpha").pivot("protocol", ["random", "source"]).agg(F.first("r_all"))
    return p.withColumn("difference", F.col("source") - F.col("random")).withColumn("better", F.col("source") < F.col("random"))


def constraint_active(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or [*SETTING, "alpha"]
    return candidates.groupBy(*by).agg(F.count_if("feasible").alias("n_feasible"), F.count(F.lit(1)).alias("n_rules"), F.bool_or(~F.col("feasible")).alias("active"))


def rule_stability(chosen: DataFrame) -> DataFrame:
    """Distinct rules over targets, for each fold and protocol."""
    return chosen.groupBy(*SETTING).agg(F.countDistinct("model", "knob").alias("rules"))


def coverage_monotone(chosen: DataFrame) -> DataFrame:
    """Settings in which the chosen rule's inner coverage falls as the target loosens."""
    w = Window.partitionBy(*SETTING).orderBy("alpha")
    rows = chosen.where("released").withColumn("before", F.lag("inner_coverage").over(w))
    return rows.groupBy("scenario", "action_set", "protocol").agg(F.count("before").alias("steps"), F.count_if(F.col("inner_coverage") < F.col("before")).alias("decreases"))


def gap_extreme(outer: DataFrame) -> DataFrame:
    """The largest optimistic gap of each protocol and where it is."""
    at = F.struct("gap_r_all", (-F.col("outer_fold")).alias("f"), (-F.col("alpha")).alias("a"))
    out = outer.groupBy("scenario", "action_set", "protocol").agg(F.max(at).alias("m"))
    return out.select("scenario", "action_set", "protocol", F.col("m.gap_r_all").alias("gap"), (-F.col("m.f")).alias("outer_fold"), (-F.col("m.a")).alias("alpha"))


def demand_sweep_gap(outers: DataFrame) -> DataFrame:
    """Settings above their own estimate for each demand quantile. outers: decision_outer rows with q."""
    return outers.groupBy("q", "protocol").agg(F.count(F.lit(1)).alias("settings"), F.count_if(F.col("gap_r_all") > 0).alias("above"))
