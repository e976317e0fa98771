"""The driver's tables as audited records, in Spark and in SQL.

`rec`: part as records (row_id, y, src, fam, sz, x): retail price above 800, brand as source, type as family, and one feature. The SQL
prelude names the same relations, so a query's SQL is the prelude and one SELECT.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provaudit.operators import decisions as D
from provaudit.operators import learners as L
from provaudit.operators import relations as R
from provaudit.operators import splits as S
from provaudit.operators.admissibility import inner_admissibility
from provaudit.plans.storage import written
from provaudit.session import read_table

K = 5
INNER_K = 4
KNOBS = list(range(0, 101, 5))
HONOURED = [("source5", "source5_sm"), ("combo5", "combo5_sm"), ("dup5", "dup5_sm"), ("holdout", "holdout_sm")]


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    x = F.floor(F.col("p_retailprice") / 20) * 20.0 + F.col("p_size") * 0.5
    return p.select(F.col("p_partkey").alias("row_id"), (F.col("p_retailprice") - 800).alias("y"), F.col("p_brand").alias("src"), F.col("p_type").alias("fam"), F.col("p_size").alias("sz"), x.alias("x"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums cannot show."""
    return df.withColumns({f.name: F.round(f.name, places) for f in df.schema if f.dataType.typeName() == "double"})


VARIANTS = ["random5", "source5", "source5_sm", "combo5", "combo5_sm", "dup5", "dup5_sm", "shuffled5", "holdout", "holdout_sm"]


#: Splits that keep a label whole: each label's columns.
LABELS = {"source5": ("src",), "combo5": ("src", "fam"), "dup5": ("src", "fam", "sz"), "shuffled5": ("src",)}


def label_of(v: str) -> F.Column:
    """The label that a variant keeps whole."""
    cols = LABELS[v]
    return F.col(cols[0]) if len(cols) == 1 else (R.combination_key if v == "combo5" else R.composite_key)(*cols)


def variants(spark: SparkSession, sf_dir: str, only: list[str]) -> DataFrame:
    """variant, row_id, fold of the named variants.

    All splits by labels are packed in one set of jobs, with the variant as a key; what size-matched splits are cut after is written
    once, and one permutation is cut for all of them.
    """
    rows = rec(spark, sf_dir)
    honoured = {v.removesuffix("_sm") for v in only} - {"random5"}
    labelled = [S.dealt_labels(rows, "src") if v == "shuffled5" else rows.select("row_id", label_of(v).alias("label")) for v in LABELS if v in honoured]
    named = [df.select(F.lit(v).alias("variant"), "row_id", "label") for v, df in zip([v for v in LABELS if v in honoured], labelled)]
    parts = []
    if named:
        parts.append(S.split_group_k(reduce(DataFrame.unionByName, named), "label", K, ["variant"]))
    if "holdout" in honoured:
        parts.append(S.split_family_holdout(rows, "fam").select(F.lit("holdout").alias("variant"), "row_id", F.col("fold").cast("long").alias("fold")))
    if any(v.endswith("_sm") for v in only):
        parts = [written(reduce(DataFrame.unionByName, parts), "honoured")]

    def matched(seed: int, wanted: list[str]) -> DataFrame:
        own = parts[0].where(F.col("variant").isin(wanted))
        return S.split_size_matched(rows, own, seed, ["variant"]).withColumn("variant", F.concat("variant", F.lit("_sm")))

    wanted = [(seed, [v for v in some if f"{v}_sm" in only]) for seed, some in ((1, ["source5", "combo5", "dup5"]), (3, ["holdout"]))]
    makers = [lambda seed=seed, some=some: matched(seed, some) for seed, some in wanted if some]
    made = [*parts, *(together(*makers) if makers else [])]
    if "random5" in only:
        made.append(S.split_random_k(rows, K).select(F.lit("random5").alias("variant"), "row_id", "fold"))
    out = reduce(DataFrame.unionByName, [df.select("variant", "row_id", F.col("fold").cast("long").alias("fold")) for df in made])
    return out.where(F.col("variant").isin(only))


def assignments(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """variant, row_id, fold; written once, as later steps read it several times."""
    return written(variants(spark, sf_dir, only or VARIANTS), "assignments")


def structure(spark: SparkSession, sf_dir: str, only: list[str] | None = None, a: DataFrame | None = None) -> DataFrame:
    n = rec(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    a = assignments(spark, sf_dir, only) if a is None else a
    return S.fold_structure(a, a.select("variant").distinct().crossJoin(F.broadcast(n)), ["variant"])


def predictions(spark: SparkSession, sf_dir: str, only: list[str] | None = None, a: DataFrame | None = None) -> DataFrame:
    """variant, model, fold, row_id, y, p for the training mean and ridge. a: assignments already written, if any."""
    rows, a = rec(spark, sf_dir), assignments(spark, sf_dir, only) if a is None else a
    return written(L.learn_dummy_mean(rows, a).unionByName(L.learn_ridge1(rows, a)), "predictions")


def log_rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec(spark, sf_dir).withColumn("y", F.log("y"))


def nested(spark: SparkSession, sf_dir: str, outer: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outer assignment, inner assignment, outer training rows)."""
    rows = log_rec(spark, sf_dir)
    outer = outer or written(S.split_group_k(rows, "src", K), "outer")
    inner = written(S.split_nested(rows, outer, "src", INNER_K), "inner")
    train = inner.where("protocol = 'random'").select("outer_fold", "row_id").join(rows.hint("merge"), "row_id")
    return outer, inner, train


def inner_predictions(train: DataFrame, inner: DataFrame) -> DataFrame:
    by, scope = ["outer_fold", "protocol"], ["outer_fold"]
    return L.learn_dummy_mean(train, inner, by, scope).unionByName(L.learn_ridge1(train, inner, by=by, scope=scope))


def outer_predictions(rows: DataFrame, outer: DataFrame) -> DataFrame:
    a = outer.withColumn("variant", F.lit("outer"))
    return L.learn_dummy_mean(rows, a).unionByName(L.learn_ridge1(rows, a)).withColumnRenamed("fold", "outer_fold").drop("variant")


#: Scenarios: a release by a margin on parts, and screening of labelled documents by category.
RELEASE, CATEGORY = "release", "category"
#: Categories of documents (toxic, poor, good), of which the first is the designated one; confidences in hundredths; features.
CATEGORIES, DESIGNATED = [0, 1, 2], 0
CONFIDENCES = list(range(0, 101, 20))
MARKS = ["upper", "marks", "size"]


def category_rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as records: row_id, y (category), src, and three features of the whole text."""
    labels = read_table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    size = F.greatest(F.lit(1), F.length("text"))
    y = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / size
    # Features come before the join, which is by sorting: labels grow with the table, however small their files are, and texts stay where they are.
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("src"), share("[A-Z]").alias("upper"), share("[!#$%&*|]").alias("marks"), F.log(size).alias("size"))
    return docs.join(labels.hint("merge"), "doc_id").select(F.col("doc_id").alias("row_id"), y.alias("y"), "src", "upper", "marks", "size")


def category_design(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outer assignment, inner assignment, outer training rows) of the category scenario."""
    rows = written(category_rec(spark, sf_dir), "category-records")
    outer = written(S.split_group_k(rows, "src", K), "category-outer")
    inner = written(S.split_nested(rows, outer, "src", INNER_K), "category-inner")
    train = inner.where("protocol = 'random'").select("outer_fold", "row_id").join(rows.hint("merge"), "row_id")
    return outer, inner, train


def category_inner(design: tuple) -> DataFrame:
    """outer_fold, protocol, model, fold, row_id, y, label, confidence out of the inner folds."""
    _, inner, train = design
    return L.learn_class_probabilities(train, inner, MARKS, CATEGORIES, ["outer_fold", "protocol"], ["outer_fold"])


def category_outer(spark: SparkSession, sf_dir: str, design: tuple) -> DataFrame:
    """outer_fold, model, row_id, y, label, confidence of the outer folds."""
    a = design[0].withColumn("variant", F.lit("outer"))
    return L.learn_class_probabilities(category_rec(spark, sf_dir), a, MARKS, CATEGORIES).withColumnRenamed("fold", "outer_fold").drop("variant")


def category_acts(knob: F.Column) -> F.Column:
    return D.act_category(knob, F.lit(DESIGNATED))


def category_curve(design: tuple) -> DataFrame:
    rows = D.with_action_sets(category_inner(design)).withColumns({"scenario": F.lit(CATEGORY), "unsafe": D.unsafe_category(F.lit(DESIGNATED))})
    return D.risk_curve(rows, [*D.SETTING, "model"], CONFIDENCES, category_acts)


def as_release(df: DataFrame) -> DataFrame:
    return df.withColumns({"scenario": F.lit(RELEASE), "action_set": F.lit(D.MARGIN)})


def together(*makers: Callable) -> list:
    """What makers give, their jobs running side by side: many are too small to fill a cluster."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(m) for m in makers]]


def designs(spark: SparkSession, sf_dir: str) -> dict[str, tuple]:
    """The nested design of each scenario, and the demands of the release."""

    def outer_first() -> tuple:
        rows = log_rec(spark, sf_dir)
        outer = written(S.split_group_k(rows, "src", K), "outer")
        return together(lambda: nested(spark, sf_dir, outer), lambda: demands(spark, sf_dir, outer))

    (release, demand), category = together(outer_first, lambda: category_design(spark, sf_dir))
    return {RELEASE: release, CATEGORY: category, "demand": demand}


def demands(spark: SparkSession, sf_dir: str, outer: DataFrame) -> DataFrame:
    return written(D.demand_of_complement(log_rec(spark, sf_dir), outer), "demands")


def inner_rows(spark: SparkSession, sf_dir: str, design: tuple | None = None, demand: DataFrame | None = None) -> DataFrame:
    """outer_fold, protocol, model, row_id, y, p, demand, unsafe for the inner folds. design: what `nested` gives, demand: what `demands` gives, if at hand."""
    outer, inner, train = design or nested(spark, sf_dir)
    return inner_predictions(train, inner).join(demand or demands(spark, sf_dir, outer), "outer_fold").withColumn("unsafe", D.unsafe_regression())


def outer_rows(spark: SparkSession, sf_dir: str, design: tuple | None = None, demand: DataFrame | None = None) -> DataFrame:
    """outer_fold, model, row_id, y, p, demand for the outer folds."""
    outer = design[0] if design else nested(spark, sf_dir)[0]
    return outer_predictions(log_rec(spark, sf_dir), outer).join(demand or demands(spark, sf_dir, outer), "outer_fold")


def demand_sweep(spark: SparkSession, sf_dir: str, quantiles: list[float]) -> DataFrame:
    """decision_outer rows with q: demand, curve, selection and realised risk anew for every demand quantile."""
    outer, inner, train = nested(spark, sf_dir)
    demand = D.demand_quantile(train, ["outer_fold"], quantiles)
    demand = written(demand.select("outer_fold", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in quantiles]).alias("q"), F.col("demand").alias("demand"))).alias("x")).select("outer_fold", "x.q", "x.demand"), "demands")
    rows = inner_predictions(train, inner).join(demand, "outer_fold").withColumn("unsafe", D.unsafe_regression())
    rules = D.rule_candidates(D.risk_curve(as_release(rows), ["q", *D.SETTING, "model"], KNOBS, D.act_regression))
    chosen = D.rule_choose(written(rules, "candidates"), ["q", *D.SETTING, "alpha"])
    realised_rows = outer_predictions(log_rec(spark, sf_dir), outer).join(demand, "outer_fold")
    return D.decision_outer(chosen, realised_rows, ["q"])


def curve(spark: SparkSession, sf_dir: str, made: dict[str, tuple] | None = None) -> DataFrame:
    """The risk curve of every setting of both scenarios. made: what `designs` gives, if at hand."""
    made = made or designs(spark, sf_dir)
    release = D.risk_curve(as_release(inner_rows(spark, sf_dir, made[RELEASE], made["demand"])), [*D.SETTING, "model"], KNOBS, D.act_regression)
    return release.unionByName(category_curve(made[CATEGORY]))


def candidates(spark: SparkSession, sf_dir: str, made: dict[str, tuple] | None = None) -> DataFrame:
    return written(D.rule_candidates(curve(spark, sf_dir, made)), "candidates")


def realise(spark: SparkSession, sf_dir: str, chosen: DataFrame, made: dict[str, tuple]) -> DataFrame:
    """What chosen rules of both scenarios do on the outer folds."""
    release = D.decision_outer(chosen.where(F.col("scenario") == RELEASE), outer_rows(spark, sf_dir, made[RELEASE], made["demand"]))
    category = D.decision_outer(chosen.where(F.col("scenario") == CATEGORY), category_outer(spark, sf_dir, made[CATEGORY]), act=category_acts, unsafe=D.unsafe_category(F.lit(DESIGNATED)))
    return release.unionByName(category)


def realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = designs(spark, sf_dir)
    return written(realise(spark, sf_dir, written(D.rule_choose(candidates(spark, sf_dir, made)), "chosen"), made), "decisions")


def inner_verdicts(spark: SparkSession, sf_dir: str, made: dict[str, tuple] | None = None) -> DataFrame:
    """Verdicts on the inner splits of both scenarios."""
    made = made or designs(spark, sf_dir)
    out = []
    for scenario in (RELEASE, CATEGORY):
        _, inner, train = made[scenario]
        labels = train.select("row_id", F.col("src").alias("label")).distinct()
        out.append(inner_admissibility(inner, labels).withColumn("scenario", F.lit(scenario)))
    return reduce(DataFrame.unionByName, out)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """campaign, types, n: suppliers by nation."""
    from provaudit.operators.graph import type_signature

    return type_signature(campaign_rows(spark, sf_dir), "campaign", "kind")


def campaign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, campaign, kind: suppliers by nation, typed by account class."""
    s = read_table(spark, sf_dir, "supplier")
    kind = F.element_at(F.array(*[F.lit(c) for c in "ABCDE"]), (F.pmod(F.col("s_nationkey") * 7 + F.when(F.pmod("s_suppkey", F.lit(11)) == 0, 1).otherwise(0), F.lit(5)) + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("row_id"), F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("campaign"), kind.alias("kind"))


def ranks(seed: int, name: str) -> str:
    return f"{name} AS (SELECT row_id, row_number() OVER (ORDER BY md5('{seed}|' || row_id), row_id) - 1 AS r FROM rec)"


def pack(name: str, rows: str, label: str, k: int, key: str = "0") -> str:
    """Packing in SQL: large groups by falling size, each to the lightest fold; the others in hash order into what room is left."""
    light = "list_position(p.loads, list_min(p.loads))"
    room = [f"greatest(0, t - {k} * l{f})" for f in range(k)]
    loads = ", ".join(f"coalesce(sum(g.n) FILTER (h.fold = {f}), 0) AS l{f}" for f in range(k))
    cuts = ", ".join(f"{' + '.join(room[: f + 1])} AS c{f}" for f in range(k))
    fold = " + ".join(f"(place * c{k - 1} >= tail * c{f})::BIGINT" for f in range(k - 1))
    return f"""
{name}_n AS (SELECT key, label, count(*) AS n FROM (SELECT {key} AS key, {label} AS label FROM {rows}) GROUP BY key, label),
{name}_t AS (SELECT key, sum(n) AS t FROM {name}_n GROUP BY key),
{name}_g AS (SELECT key, label, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS i FROM {name}_n JOIN {name}_t USING (key) WHERE n * {k} * 20 > t),
{name}_p AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::VARCHAR AS label, 0::BIGINT AS fold, {[0] * k}::BIGINT[] AS loads FROM {name}_g
  UNION ALL SELECT g.key, g.i, g.label, ({light} - 1)::BIGINT, list_transform(p.loads, lambda v, j: CASE WHEN j = {light} THEN v + g.n ELSE v END)
  FROM {name}_p p JOIN {name}_g g ON g.key = p.key AND g.i = p.i + 1),
{name}_h AS (SELECT key, label, fold FROM {name}_p WHERE i > 0),
{name}_l AS (SELECT t.key, t.t, {loads} FROM {name}_t t LEFT JOIN {name}_h h ON h.key = t.key LEFT JOIN {name}_g g ON g.key = h.key AND g.label = h.label GROUP BY t.key, t.t),
{name}_c AS (SELECT key, t - ({" + ".join(f"l{f}" for f in range(k))}) AS tail, {cuts} FROM {name}_l),
{name}_w AS (SELECT key, label, sum(n) OVER (PARTITION BY key ORDER BY md5('0|' || label), label) - n AS place FROM {name}_n JOIN {name}_t USING (key) WHERE n * {k} * 20 <= t),
{name} AS (SELECT key, label, fold FROM {name}_h UNION ALL SELECT key, label, {fold} FROM {name}_w JOIN {name}_c USING (key))"""


def cut(name: str, honoured: str, rank: str) -> str:
    """Size-matched folds: a permutation cut at cumulative fold sizes."""
    return f"""
{name}_s AS (SELECT fold, sum(count(*)) OVER (ORDER BY fold) AS hi, count(*) AS c FROM {honoured} GROUP BY fold),
{name} AS (SELECT row_id, fold FROM {rank} JOIN {name}_s ON r >= hi - c AND r < hi)"""


def fold_of(r: str, n: str, k: int) -> str:
    big = f"({n} % {k}) * ({n} // {k} + 1)"
    return f"CASE WHEN {r} < {big} THEN {r} // ({n} // {k} + 1) ELSE {n} % {k} + ({r} - {big}) // greatest({n} // {k}, 1) END"


MODELS = """
{p}_fs AS (SELECT {by}, a.fold, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(x * x) AS sxx, sum(x * y) AS sxy FROM {a} a JOIN {rows} r ON {on} GROUP BY {by}, a.fold),
{p}_ts AS (SELECT scope, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(x * x) AS sxx, sum(x * y) AS sxy FROM (SELECT {scope} AS scope, r.* FROM {rows} r) GROUP BY scope),
{p}_tr AS (SELECT f.* EXCLUDE (n, sy, sx, sxx, sxy), t.n - f.n AS n, (t.sy - f.sy) / (t.n - f.n) AS my, (t.sx - f.sx) / (t.n - f.n) AS mx, t.sxx - f.sxx AS sxx, t.sxy - f.sxy AS sxy FROM {p}_fs f JOIN {p}_ts t ON t.scope = {fscope}),
{p}_ft AS (SELECT *, CASE WHEN sxx / n - mx * mx > 1e-12 THEN sqrt(sxx / n - mx * mx) ELSE 1 END AS sd FROM {p}_tr),
{p} AS (SELECT {by}, m.model, a.fold, r.row_id, r.y, CASE WHEN m.model = 'dummy' THEN f.my ELSE f.my + (r.x - f.mx) / f.sd * ((f.sxy - f.n * f.mx * f.my) / f.sd / (f.n + 1)) END AS p
  FROM {a} a JOIN {rows} r ON {on} JOIN {p}_ft f ON f.fold = a.fold AND {match}, (VALUES ('dummy'), ('ridge')) m(model))"""

#: Classifiers from moments of the training rows by class; `bare` names the columns of `by` without their table.
BAYES = """
{p}_fs AS (SELECT {by}, a.fold, y AS c, count(*) AS n, sum(f0) AS s0, sum(f1) AS s1, sum(f2) AS s2, sum(f0 * f0) AS q0, sum(f1 * f1) AS q1, sum(f2 * f2) AS q2 FROM {a} a JOIN {rows} r ON {on} GROUP BY {by}, a.fold, y),
{p}_ts AS (SELECT {scope} AS scope, y AS c, count(*) AS n, sum(f0) AS s0, sum(f1) AS s1, sum(f2) AS s2, sum(f0 * f0) AS q0, sum(f1 * f1) AS q1, sum(f2 * f2) AS q2 FROM {rows} r GROUP BY ALL),
{p}_fc AS (SELECT DISTINCT {bare}, fold FROM {p}_fs),
{p}_tr AS (SELECT f.*, t.c, t.n - coalesce(x.n, 0) AS n, t.s0 - coalesce(x.s0, 0) AS s0, t.s1 - coalesce(x.s1, 0) AS s1, t.s2 - coalesce(x.s2, 0) AS s2, t.q0 - coalesce(x.q0, 0) AS q0, t.q1 - coalesce(x.q1, 0) AS q1, t.q2 - coalesce(x.q2, 0) AS q2
  FROM {p}_fc f JOIN {p}_ts t ON t.scope = {fscope} LEFT JOIN {p}_fs x ON (x.fold, x.c) = (f.fold, t.c) AND {same}),
{p}_ft AS (SELECT {bare}, fold, c, ln(n / sum(n) OVER (PARTITION BY {bare}, fold)) AS prior, s0 / n AS m0, s1 / n AS m1, s2 / n AS m2, greatest(0, q0 / n - (s0 / n) ** 2) + 1e-6 AS v0, greatest(0, q1 / n - (s1 / n) ** 2) + 1e-6 AS v1, greatest(0, q2 / n - (s2 / n) ** 2) + 1e-6 AS v2 FROM {p}_tr WHERE n > 0),
{p}_ls AS (SELECT {by}, a.fold, r.row_id, r.y, c, model, CASE WHEN model = 'prior' THEN prior ELSE prior - (ln(v0) + (f0 - m0) ** 2 / v0) / 2 - (ln(v1) + (f1 - m1) ** 2 / v1) / 2 - (ln(v2) + (f2 - m2) ** 2 / v2) / 2 END AS l
  FROM {a} a JOIN {rows} r ON {on} JOIN {p}_ft t ON {match} AND t.fold = a.fold, (VALUES ('bayes'), ('prior')) m(model)),
{p} AS (SELECT {bare}, fold, model, row_id, any_value(y) AS y, arg_min(c, (m - l, c)) AS label, round(1 / sum(exp(l - m)), 6) AS confidence FROM (SELECT *, max(l) OVER (PARTITION BY {bare}, fold, model, row_id) AS m FROM {p}_ls) GROUP BY {bare}, fold, model, row_id)"""

R2 = "CASE WHEN count(*) > 1 AND var_pop(y) * count(*) > 1e-12 THEN 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) END"

PRELUDE = ",\n".join(
    [
        "WITH RECURSIVE rec AS (SELECT p_partkey AS row_id, p_retailprice - 800 AS y, p_brand AS src, p_type AS fam, p_size AS sz, floor(p_retailprice / 20) * 20.0 + p_size * 0.5 AS x FROM part)",
        "tot AS (SELECT count(*) AS n FROM rec)",
        ranks(0, "r0"), ranks(1, "r1"), ranks(2, "r2"), ranks(3, "r3"),
        f"a_random5 AS (SELECT row_id, {fold_of('r', 'n', K)} AS fold FROM r0, tot)",
        pack("k_src", "rec", "src", K), "a_source5 AS (SELECT row_id, fold FROM rec JOIN k_src ON label = src)",
        "rec_c AS (SELECT *, src || ' || ' || fam AS c FROM rec)", pack("k_com", "rec_c", "c", K), "a_combo5 AS (SELECT row_id, fold FROM rec_c JOIN k_com ON label = c)",
        "rec_d AS (SELECT *, src || '|' || fam || '|' || sz AS c FROM rec)", pack("k_dup", "rec_d", "c", K), "a_dup5 AS (SELECT row_id, fold FROM rec_d JOIN k_dup ON label = c)",
        "fams AS (SELECT fam, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, fam) - 2 AS fold FROM rec GROUP BY fam)", "a_holdout AS (SELECT row_id, fold FROM rec JOIN fams USING (fam) WHERE fold >= 0)",
        cut("a_source5_sm", "a_source5", "r1"), cut("a_combo5_sm", "a_combo5", "r1"), cut("a_dup5_sm", "a_dup5", "r1"), cut("a_holdout_sm", "a_holdout", "r3"),
        "a_shuffled5 AS (SELECT p.row_id, k.fold FROM r3 p JOIN r2 l ON p.r = l.r JOIN rec s ON s.row_id = l.row_id JOIN k_src k ON k.label = s.src)",
        "asg AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, row_id, fold FROM a_{v}" for v in ("random5", "source5", "source5_sm", "combo5", "combo5_sm", "dup5", "dup5_sm", "shuffled5", "holdout", "holdout_sm")) + ")",
        "fst AS (SELECT variant, fold, n - count(*) AS n_train, count(*) AS n_test, (n - count(*)) / n::DOUBLE AS train_fraction FROM asg, tot GROUP BY variant, fold, n)",
        "adm AS (SELECT variant, count(*) AS K, n, (n * 5 + 99) // 100 AS L, n * 50 // 100 AS U, list_sort(list(n_test)) AS sizes, min(n_train / n::DOUBLE) AS fmin, max(n_train / n::DOUBLE) AS fmax, count(*) FILTER (n_test < (n * 5 + 99) // 100) AS below, count(*) FILTER (n_test > n * 50 // 100) AS above FROM fst, tot GROUP BY variant, n)",
        MODELS.format(p="pred", by="a.variant", a="asg", rows="rec", on="a.row_id = r.row_id", scope="0", fscope="0", match="f.variant = a.variant").strip(),
        f"fr2 AS (SELECT variant, model, fold, {R2} AS r2 FROM pred GROUP BY ALL)",
        f"met AS (SELECT * FROM (SELECT variant, model, count(*) AS n, {R2} AS pooled_r2, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae FROM pred GROUP BY variant, model) JOIN (SELECT variant, model, avg(r2) AS fold_mean_r2, stddev_pop(r2) AS fold_sd_r2, count(*) AS n_folds FROM fr2 GROUP BY variant, model) USING (variant, model))",
        "ctl AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in HONOURED) + ") t(variant, sizematch))",
        "pairs AS (SELECT m.variant, m.model, r.pooled_r2 AS r2_random5, s.pooled_r2 AS r2_sizematch, m.pooled_r2 AS r2_honoured, m.fold_mean_r2, m.fold_sd_r2, m.n_folds AS K, m.pooled_r2 - r.pooled_r2 AS delta_vs_random, m.pooled_r2 - s.pooled_r2 AS delta_vs_sizematch, (below = 0 AND above = 0) AS split_admissible FROM met m JOIN ctl USING (variant) LEFT JOIN met r ON r.variant = 'random5' AND r.model = m.model LEFT JOIN met s ON s.variant = sizematch AND s.model = m.model LEFT JOIN adm ON adm.variant = m.variant)",
        "lrec AS (SELECT row_id, ln(y) AS y, src, x FROM rec)",
        f"trn AS (SELECT o.fold AS outer_fold, r.row_id, r.y, r.x, r.src FROM lrec r JOIN a_source5 s USING (row_id), (SELECT DISTINCT fold FROM a_source5) o WHERE s.fold <> o.fold)",
        f"inr AS (SELECT outer_fold, row_id, {fold_of('r', 'n', INNER_K)} AS fold FROM (SELECT outer_fold, row_id, row_number() OVER (PARTITION BY outer_fold ORDER BY md5('4|' || row_id), row_id) - 1 AS r, count(*) OVER (PARTITION BY outer_fold) AS n FROM trn))",
        pack("k_in", "trn", "src", INNER_K, "outer_fold"),
        "inner_ AS (SELECT outer_fold, 'random' AS protocol, row_id, fold FROM inr UNION ALL SELECT outer_fold, 'source', row_id, k.fold FROM trn JOIN k_in k ON k.key = outer_fold AND k.label = src)",
        "dem AS (SELECT outer_fold, quantile_cont(exp(y), 0.5) AS demand FROM trn GROUP BY outer_fold)",
        MODELS.format(p="ipred", by="a.outer_fold, a.protocol", a="inner_", rows="trn", on="a.row_id = r.row_id AND a.outer_fold = r.outer_fold", scope="r.outer_fold", fscope="f.outer_fold", match="f.outer_fold = a.outer_fold AND f.protocol = a.protocol").strip(),
        "out_ AS (SELECT 'outer' AS variant, row_id, fold FROM a_source5)",
        MODELS.format(p="opred", by="a.variant", a="out_", rows="lrec", on="a.row_id = r.row_id", scope="0", fscope="0", match="f.variant = a.variant").strip(),
        "irow AS (SELECT i.*, demand, exp(y) < demand AS unsafe FROM ipred i JOIN dem USING (outer_fold))",
        "orow AS (SELECT o.fold AS outer_fold, model, row_id, y, p, demand FROM opred o JOIN dem ON dem.outer_fold = o.fold)",
        "knobs AS (SELECT unnest(range(0, 101, 5)) AS knob)",
        # Screening by category
        "doc AS (SELECT doc_id AS row_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS y, source AS src, greatest(1, length(text)) AS len, text FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL)",
        "drec AS (SELECT row_id, y, src, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) / len AS f0, (length(text) - length(regexp_replace(text, '[!#$%&*|]', '', 'g'))) / len AS f1, ln(len) AS f2 FROM doc)",
        pack("k_doc", "drec", "src", K), "dout_a AS (SELECT row_id, fold FROM drec JOIN k_doc ON label = src)",
        "dtrn AS (SELECT o.fold AS outer_fold, r.* FROM drec r JOIN dout_a s USING (row_id), (SELECT DISTINCT fold FROM dout_a) o WHERE s.fold <> o.fold)",
        f"dinr AS (SELECT outer_fold, row_id, {fold_of('r', 'n', INNER_K)} AS fold FROM (SELECT outer_fold, row_id, row_number() OVER (PARTITION BY outer_fold ORDER BY md5('4|' || row_id), row_id) - 1 AS r, count(*) OVER (PARTITION BY outer_fold) AS n FROM dtrn))",
        pack("k_din", "dtrn", "src", INNER_K, "outer_fold"),
        "dinner AS (SELECT outer_fold, 'random' AS protocol, row_id, fold FROM dinr UNION ALL SELECT outer_fold, 'source', row_id, k.fold FROM dtrn JOIN k_din k ON k.key = outer_fold AND k.label = src)",
        BAYES.format(p="cin", by="a.outer_fold, a.protocol", bare="outer_fold, protocol", a="dinner", rows="dtrn", on="a.row_id = r.row_id AND a.outer_fold = r.outer_fold", scope="r.outer_fold", fscope="f.outer_fold", same="x.outer_fold = f.outer_fold AND x.protocol = f.protocol", match="t.outer_fold = a.outer_fold AND t.protocol = a.protocol").strip(),
        "dout_v AS (SELECT 'outer' AS variant, row_id, fold FROM dout_a)",
        BAYES.format(p="cout", by="a.variant", bare="variant", a="dout_v", rows="drec", on="a.row_id = r.row_id", scope="0", fscope="0", same="x.variant = f.variant", match="t.variant = a.variant").strip(),
        "aset AS (SELECT unnest(['act_on_confidence', 'release_when_not_designated']) AS action_set)",
        "crv AS (SELECT 'release' AS scenario, 'act_on_margin' AS action_set, outer_fold, protocol, model, knob, count(*) AS n_test, count(*) FILTER (p >= ln(demand) + ln(1 + knob / 100.0)) AS n_released, count(*) FILTER (unsafe AND p >= ln(demand) + ln(1 + knob / 100.0)) AS n_unsafe FROM irow, knobs GROUP BY ALL UNION ALL SELECT 'category', action_set, outer_fold, protocol, model, knob, count(*), count(*) FILTER (confidence * 100 >= knob AND (action_set = 'act_on_confidence' OR label <> 0)), count(*) FILTER (y = 0 AND confidence * 100 >= knob AND (action_set = 'act_on_confidence' OR label <> 0)) FROM cin, aset, (SELECT unnest(range(0, 101, 20)) AS knob) GROUP BY ALL)",
        "cand AS (SELECT *, n_unsafe / n_test::DOUBLE AS r_all, n_released / n_test::DOUBLE AS coverage, n_unsafe * 100 <= alpha * n_test AS feasible FROM crv, (VALUES (5), (10), (20)) t(alpha))",
        "sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, action_set, outer_fold, protocol, alpha ORDER BY n_released DESC, knob, model) AS r, count(*) OVER (PARTITION BY scenario, action_set, outer_fold, protocol, alpha) AS n_feasible FROM cand WHERE feasible) WHERE r = 1)",
        "fal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, action_set, outer_fold, protocol, alpha ORDER BY n_unsafe, model, knob) AS r FROM cand) WHERE r = 1)",
        "cho AS (SELECT f.scenario, f.action_set, f.outer_fold, f.protocol, f.alpha, s.model IS NOT NULL AS released, coalesce(s.n_feasible, 0) AS n_feasible, coalesce(s.model, f.model) AS model, coalesce(s.knob, f.knob) AS knob, coalesce(s.r_all, f.r_all) AS inner_r_all, coalesce(s.coverage, f.coverage) AS inner_coverage FROM fal f LEFT JOIN sel s USING (scenario, action_set, outer_fold, protocol, alpha))",
        "dout AS (SELECT c.*, count(*) AS n_test, count(*) FILTER (released AND p >= ln(demand) + ln(1 + knob / 100.0)) AS n_released, count(*) FILTER (released AND p >= ln(demand) + ln(1 + knob / 100.0) AND exp(y) < demand) AS n_unsafe FROM cho c JOIN orow o ON o.outer_fold = c.outer_fold AND o.model = c.model WHERE scenario = 'release' GROUP BY ALL UNION ALL SELECT c.*, count(*), count(*) FILTER (released AND confidence * 100 >= knob AND (action_set = 'act_on_confidence' OR label <> 0)), count(*) FILTER (released AND y = 0 AND confidence * 100 >= knob AND (action_set = 'act_on_confidence' OR label <> 0)) FROM cho c JOIN cout o ON o.fold = c.outer_fold AND o.model = c.model WHERE scenario = 'category' GROUP BY ALL)",
        "dec AS (SELECT *, n_unsafe / n_test::DOUBLE AS r_all, CASE WHEN n_released > 0 THEN n_unsafe / n_released::DOUBLE END AS r_released, n_released / n_test::DOUBLE AS coverage, n_unsafe / n_test::DOUBLE - inner_r_all AS gap_r_all, n_unsafe * 100 <= alpha * n_test AS target_met FROM dout)",
        "isrc AS (SELECT 'release' AS scenario, i.*, src FROM inner_ i JOIN rec USING (row_id) UNION ALL SELECT 'category', i.*, src FROM dinner i JOIN drec USING (row_id))",
        "ifold AS (SELECT scenario, outer_fold, protocol, fold, count(*) AS n_test, count(DISTINCT src) AS g FROM isrc GROUP BY ALL)",
        "iadm AS (SELECT scenario, outer_fold, protocol, sum(n_test) AS n_train, (sum(n_test) * 5 + 99) // 100 AS L, sum(n_test) * 50 // 100 AS U, count(*) AS K, list_sort(list(n_test)) AS fold_sizes, list_sort(list(g)) AS groups_per_fold, min(n_test) >= (sum(n_test) * 5 + 99) // 100 AND max(n_test) <= sum(n_test) * 50 // 100 AS within_bounds, any_value(groups) AS groups FROM ifold JOIN (SELECT scenario, outer_fold, protocol, count(DISTINCT src) AS groups FROM isrc GROUP BY ALL) USING (scenario, outer_fold, protocol) GROUP BY scenario, outer_fold, protocol)",
        "pck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, action_set, outer_fold, protocol, alpha ORDER BY NOT feasible, CASE WHEN feasible THEN -n_released ELSE n_unsafe END, n_unsafe, knob, model) AS r, count(*) FILTER (feasible) OVER (PARTITION BY scenario, action_set, outer_fold, protocol, alpha) AS n_feasible, count(*) OVER (PARTITION BY scenario, action_set, outer_fold, protocol, alpha) AS n_candidates FROM cand) WHERE r = 1)",
        "pol AS (SELECT scenario, p.action_set, p.outer_fold, p.protocol, p.alpha, n_candidates, n_feasible, CASE WHEN n_feasible > 0 THEN 'select' ELSE 'fallback' END AS G_mode, model AS G_model, knob AS G_knob, n_released AS G_released, n_unsafe AS G_unsafe, (within_bounds AND groups >= i.K AND n_feasible > 0) AS live FROM pck p JOIN iadm i USING (scenario, outer_fold, protocol))",
        "camp AS (SELECT s_suppkey AS row_id, 'n' || lpad(s_nationkey::VARCHAR, 2, '0') AS campaign, substr('ABCDE', ((s_nationkey * 7 + CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END) % 5 + 1)::INT, 1) AS kind FROM supplier)",
        "sig AS (SELECT campaign, list_sort(list(DISTINCT kind)) AS types, count(*) AS n FROM camp GROUP BY campaign)",
    ]
)
