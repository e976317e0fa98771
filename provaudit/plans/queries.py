"""One registered query per operator, with the SQL that states the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provaudit.functions.order_statistics import quantiles
from provaudit.operators import admissibility as A
from provaudit.operators import contrasts as C
from provaudit.operators import decisions as D
from provaudit.operators import expect as E
from provaudit.operators import graph as G
from provaudit.operators import learners as L
from provaudit.operators import metrics as M
from provaudit.operators import policy as P
from provaudit.operators import relations as R
from provaudit.operators import splits as S
from provaudit.plans import base as B
from provaudit.plans.storage import shared_folder, written
from provaudit.session import read_table
from provaudit.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Register a function under its own name; sql follows the prelude unless it stands alone."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"{B.PRELUDE}\n{sql}" if prelude else sql
        return f

    return add


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Sources and sinks


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type", False)
def src_parquet(spark, d):
    return T.src_parquet(spark, f"{d}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("SELECT p_brand AS brand, '{\"parts\":' || count(*) || ',\"largest\":' || max(p_size) || '}' AS summary FROM part GROUP BY p_brand", False)
def sink_summary(spark, d):
    n = read_table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("parts"), F.max("p_size").alias("largest"))
    return T.sink_summary(n, ["brand"])


#: Where the SQL of queries about files, not tables, looks.
FILES = "/root/testdata/sf0.01"


@query(f"SELECT size AS length, sha256(content) AS sha256 FROM read_blob('{FILES}/part.parquet')", False)
def input_fingerprint(spark, d):
    return T.input_fingerprint(spark, f"{d}/part.parquet").select("length", "sha256")


@query("SELECT o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_orderpriority", False)
def src_csv(spark, d):
    """Orders written as CSV and read again with the types that all its values allow."""
    path = shared_path(spark, "orders-csv")
    T.sink_table(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path)
    return T.src_csv(spark, path).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT src AS label, any_value(fold)::BIGINT AS fold, count(*) AS n, round(sum(y), 4) AS y, (count(*) FILTER (sz % 3 = 0))::DOUBLE AS small, round(sum(x), 4) AS x FROM rec JOIN k_src ON label = src GROUP BY src")
def src_spec(spark, d):
    """Parts as a raw CSV table whose last column is the target, loaded by a spec and dealt to folds by their relation."""
    path = shared_path(spark, "parts-csv")
    third = F.concat(F.lit("k"), (F.col("sz") % 3).cast("string"))
    T.sink_table(B.rec(spark, d).select("row_id", F.col("src").alias("maker"), "fam", third.alias("third"), "x", (F.col("y") * 2).alias("leak"), F.when(F.col("row_id") >= 0, F.col("y")).alias("strength")), path)
    rows = written(T.src_spec(spark, T.Spec(path, T.LAST, relation="maker", drop=["row_id", "leak", "fam"])), "spec")
    folds = S.split_group_k(rows, "relation", B.K)
    out = rows.join(folds, "row_id").groupBy(F.col("relation").alias("label")).agg(F.first("fold").alias("fold"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("`third=k0`").alias("small"), F.sum("x").alias("x"))
    return B.rounded(out, 4)


@query("SELECT variant, fold, count(*) AS n, round(sum(p), 4) AS total FROM pred WHERE model = 'ridge' GROUP BY variant, fold")
def sink_parquet(spark, d):
    """Out-of-fold predictions written as Parquet by variant and read again by a filter on the partition."""
    path = shared_path(spark, "predictions-parquet")
    T.sink_parquet(B.predictions(spark, d), path, ["model", "variant"])
    return B.rounded(T.src_parquet(spark, path).where("model = 'ridge'").groupBy("variant", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")), 4)


@query("SELECT variant, to_json(sizes)::VARCHAR AS sizes, L, U FROM adm")
def sink_table(spark, d):
    """Verdicts on all splits, arrays as JSON, written as CSV and read again."""
    path = shared_path(spark, "verdicts-csv")
    T.sink_table(verdicts(spark, d).select("variant", F.col("test_sizes").alias("sizes"), "L", "U"), path)
    return T.src_csv(spark, path, "variant string, sizes string, L long, U long")


INPUTS = ["customer", "documents", "absent_survey", "labels", "part", "absent_controls"]


@query("SELECT name, CASE WHEN EXISTS (SELECT 1 FROM glob('" + FILES + "/*.parquet') g WHERE g.file LIKE '%/' || name || '.parquet') THEN 'read' ELSE 'skipped: missing' END AS note FROM (VALUES " + ", ".join(f"('{n}')" for n in INPUTS) + ") t(name)", False)
def skip_missing_input(spark, d):
    """Registered inputs against the files that are there."""
    registered = spark.createDataFrame([(n,) for n in INPUTS], "name string")
    return T.skip_missing_input(registered, T.present_inputs(spark, d), "name")


# Registry and profiling


def assets(spark, d):
    """Brands as assets, the odd ones in analysis."""
    n = read_table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("records"))
    return n.withColumn("in_analysis", F.substring("p_brand", -1, 1).cast("int") % 2 == 1)


ASSETS = "WITH a AS (SELECT p_brand, count(*) AS records, right(p_brand, 1)::INT % 2 = 1 AS in_analysis FROM part GROUP BY p_brand) "


@query(ASSETS + "SELECT CASE WHEN grouping(in_analysis) = 1 THEN 'all' WHEN in_analysis THEN 'analysis' ELSE 'inventory' END AS part, count(*) AS assets, sum(records)::BIGINT AS records FROM a GROUP BY ROLLUP (in_analysis)", False)
def corpus_rollup(spark, d):
    return R.corpus_rollup(assets(spark, d))


def gaps(spark, d):
    """Events with missing targets and relations and some role words, injected by id."""
    e = read_table(spark, d, "events")
    i = F.col("event_id")
    user = F.when(i % 23 == 0, F.lit(None)).when(i % 29 == 0, "held_out").otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", "event_type", F.when(i % 17 != 0, F.col("value")).alias("value"), user.alias("grp"))


GAPS = "WITH g AS (SELECT event_id, event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS value, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'held_out' ELSE user_id::VARCHAR END AS grp FROM events) "


@query(GAPS + "SELECT event_type, count(*) AS n_raw, count(value) AS n_analytic, count(*) - count(value) AS n_dropped_missing_target, count(DISTINCT CASE WHEN value IS NOT NULL AND coalesce(grp, '') <> 'held_out' THEN grp END) AS groups_postfilter, count(*) FILTER (grp = 'held_out') AS role_value_rows, count(*) FILTER (grp IS NULL) AS missing_relation_rows FROM g GROUP BY event_type", False)
def config_profile(spark, d):
    return R.config_profile(gaps(spark, d), ["event_type"], "value", "grp")


@query(GAPS + "SELECT count(*) FILTER (grp = 'held_out') AS role_rows, count(*) AS n_rows FROM g", False)
def role_value_guard(spark, d):
    return R.role_value_guard(gaps(spark, d), "grp")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", False)
def registry_enrich(spark, d):
    meta = read_table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return R.registry_enrich(read_table(spark, d, "nation"), meta, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT variant, CASE WHEN below = 0 AND above = 0 THEN '1/1' ELSE '0/1' END AS admissible_splits FROM adm UNION ALL SELECT 'none', '0/0'")
def registry_admissible_ratio(spark, d):
    v = A.fold_admissibility(B.structure(spark, d), ["variant"])
    registry = v.select("variant").union(v.sparkSession.range(1).select(F.lit("none")))
    return R.registry_admissible_ratio(registry, v, "variant")


@query("WITH n AS (SELECT ps, count(*) AS n FROM (SELECT DISTINCT s_suppkey, s_nationkey AS ps FROM supplier) GROUP BY ps) SELECT sum(n)::BIGINT AS studies, count(*) AS assets, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS sharing FROM n", False)
def alias_assets(spark, d):
    return R.alias_assets(read_table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@query("WITH n AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT sum(n)::BIGINT AS records, count(*) AS groups, count(*) FILTER (n = 1) AS singletons, greatest(0, 2 * count(*) - sum(n))::BIGINT AS singletons_at_least, round(1 - count(*) FILTER (n = 1) / count(*)::DOUBLE, 6) AS group_share, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE, 6) AS record_share FROM n", False)
def dup_key_profile(spark, d):
    return B.rounded(R.dup_key_profile(read_table(spark, d, "documents"), R.composite_key("text")))


@query("SELECT quality, count(*) AS records, quality = (SELECT min(quality) FROM labels) AS designated FROM labels GROUP BY quality", False)
def target_label_table(spark, d):
    return R.target_label_table(read_table(spark, d, "labels"), "quality")


# Projection, filters, features


@query("SELECT p_partkey, p_size FROM part", False)
def drop_leak_columns(spark, d):
    return R.drop_leak_columns(read_table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice"), "p_brand", "p_type", "p_retailprice")


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS DOUBLE) AS size FROM part", False)
def coerce_numeric(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"))
    return p.withColumns(R.coerce_numeric("size"))


@query(GAPS + "SELECT event_id, value FROM g WHERE value IS NOT NULL", False)
def filter_target_present(spark, d):
    return R.filter_target_present(gaps(spark, d), "value").select("event_id", "value")


@query("SELECT o_orderkey, (coalesce(o_orderstatus = 'F', false))::INT::DOUBLE AS f, (coalesce(o_orderstatus = 'O', false))::INT::DOUBLE AS o, (o_orderstatus IS NULL)::INT::DOUBLE AS missing FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders)", False)
def lowcard_onehot(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_custkey").cast("string").alias("many"))
    wide = R.lowcard_onehot(o, ["s", "many"])
    return wide.select("o_orderkey", F.col("`s=F`").alias("f"), F.col("`s=O`").alias("o"), F.col("`s=NA`").alias("missing"))


@query(GAPS + "SELECT coalesce(grp, 'nan') AS label, count(*) AS n FROM g GROUP BY 1", False)
def relation_label(spark, d):
    return gaps(spark, d).groupBy(R.relation_label("grp").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(GAPS + "SELECT coalesce(grp, 'nan') || '|' || event_type AS key, count(*) AS n FROM g GROUP BY 1", False)
def composite_key(spark, d):
    return gaps(spark, d).groupBy(R.composite_key("grp", "event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(GAPS + "SELECT coalesce(grp, 'nan') || ' || ' || event_type AS key, count(*) AS n FROM g GROUP BY 1", False)
def combination_key(spark, d):
    return gaps(spark, d).groupBy(R.combination_key("grp", "event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round(ln(p_retailprice) + ln(1 + (p_size % 5) / 10.0), 6) AS threshold, round(exp(ln(p_retailprice)), 6) AS back FROM part", False)
def log_exp_rule(spark, d):
    p = read_table(spark, d, "part")
    rule = R.log_exp_rule(F.col("p_retailprice"), (F.col("p_size") % 5) / 10.0)
    return B.rounded(p.select("p_partkey", rule.alias("threshold"), F.exp(F.log("p_retailprice")).alias("back")))


@query("SELECT p_type, round(avg(p_retailprice), 3) AS price FROM part GROUP BY p_type", False)
def round_display(spark, d):
    return R.round_display(read_table(spark, d, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("price")), {"price": 3})


MISSING = "gap AS (SELECT row_id, fold, CASE WHEN row_id % 9 <> 0 THEN x END AS x FROM a_random5 JOIN rec USING (row_id)), st AS (SELECT f.fold, quantile_cont(g.x, 0.5) AS med, avg(g.x) AS mean, stddev_pop(g.x) AS sd FROM gap g, (SELECT DISTINCT fold FROM gap) f WHERE g.fold <> f.fold GROUP BY f.fold)"


def gap_rows(spark, d):
    rows = B.rec(spark, d).select("row_id", F.when(F.col("row_id") % 9 != 0, F.col("x")).alias("x"))
    return rows.join(B.variants(spark, d, ["random5"]).drop("variant"), "row_id")


@query(", " + MISSING + " SELECT row_id, fold, round(coalesce(x, med), 6) AS x FROM gap JOIN st USING (fold)")
def train_median_impute(spark, d):
    return B.rounded(R.train_median_impute(gap_rows(spark, d), "x", []).select("row_id", "fold", "x"))


@query(", " + MISSING + " SELECT row_id, fold, round((x - mean) / sd, 6) AS x FROM gap JOIN st USING (fold)")
def train_standardise(spark, d):
    return B.rounded(R.train_standardise(gap_rows(spark, d), "x", []).select("row_id", "fold", "x"))


# Splits

for _name, _variant in [("split_random_k", "random5"), ("split_group_k", "source5"), ("split_size_matched", "source5_sm"), ("split_combination", "combo5"), ("split_duplication_key", "dup5"), ("split_shuffled_labels", "shuffled5"), ("split_family_holdout", "holdout"), ("split_family_holdout_sizematch", "holdout_sm")]:

    def _split(spark, d, v=_variant):
        return B.variants(spark, d, [v]).select("row_id", "fold")

    _split.__name__ = _name
    query(f"SELECT row_id, fold::BIGINT AS fold FROM a_{_variant}")(_split)


@query("SELECT relation, n AS groups, n >= 3 AS usable FROM (SELECT 'r_name' AS relation, count(DISTINCT n_regionkey) AS n FROM nation UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM nation UNION ALL SELECT 'one', 1)", False)
def min_groups_guard(spark, d):
    n = read_table(spark, d, "nation").select(F.col("n_regionkey").alias("r_name"), "n_name", F.lit(1).alias("one"))
    return S.min_groups_guard(n, ["r_name", "n_name", "one"])


@query("SELECT outer_fold, protocol, row_id, fold::BIGINT AS fold FROM inner_")
def split_nested(spark, d):
    return B.nested(spark, d)[1]


@query("SELECT variant, fold, n_train, n_test, round(train_fraction, 6) AS train_fraction FROM fst")
def fold_structure(spark, d):
    return B.rounded(B.structure(spark, d))


@query("SELECT variant, count(*) AS covered, n, round(count(*) / n::DOUBLE, 6) AS coverage FROM asg, tot GROUP BY variant, n")
def split_coverage(spark, d):
    a = B.assignments(spark, d)
    n = a.select("variant").distinct().crossJoin(B.rec(spark, d).agg(F.count(F.lit(1)).alias("n")))
    return B.rounded(S.split_coverage(a, n, ["variant"]))


@query("SELECT variant, count(*) AS labels, count(*) FILTER (k > 1) AS straddling FROM (SELECT variant, src, count(DISTINCT fold) AS k FROM asg JOIN rec USING (row_id) GROUP BY ALL) GROUP BY variant")
def split_leak_check(spark, d):
    return S.split_leak_check(B.assignments(spark, d), B.rec(spark, d).select("row_id", F.col("src").alias("label")), ["variant"])


@query("SELECT variant, fold, count(DISTINCT src) AS groups FROM asg JOIN rec USING (row_id) GROUP BY ALL")
def groups_per_fold(spark, d):
    return S.groups_per_fold(B.assignments(spark, d), B.rec(spark, d).select("row_id", F.col("src").alias("label")), ["variant"])


@query(", nm AS (SELECT a.*, min(row_id) OVER (PARTITION BY variant, fold) AS name FROM (SELECT * FROM asg UNION ALL SELECT 'copy', row_id, 4 - fold FROM a_source5) a), mk AS (SELECT variant, list(row_id || ':' || name ORDER BY row_id) AS m FROM nm GROUP BY variant) SELECT a.variant, b.variant AS alias FROM mk a JOIN mk b ON a.m = b.m AND a.variant < b.variant")
def split_alias(spark, d):
    return S.split_alias(with_copy(spark, d))


def with_copy(spark, d):
    """All variants, and one that only renames the folds of source5."""
    a = B.assignments(spark, d)
    return a.unionByName(a.where("variant = 'source5'").select(F.lit("copy").alias("variant"), "row_id", (4 - F.col("fold")).alias("fold")))


# Admissibility


@query("SELECT variant, K, n, L, U, array_to_string(sizes, ',') AS test_sizes, round(fmin, 6) AS train_fraction_min, round(fmax, 6) AS train_fraction_max, below AS folds_below_L, above AS folds_above_U, below = 0 AND above = 0 AS admissible FROM adm")
def fold_admissibility(spark, d):
    return B.rounded(A.fold_admissibility(B.structure(spark, d), ["variant"])).withColumn("test_sizes", F.array_join(F.col("test_sizes").cast("array<string>"), ","))


def verdicts(spark, d, a=None):
    return written(A.fold_admissibility(B.structure(spark, d, a=a), ["variant"]), "verdicts")


FEASIBLE = """, s AS (SELECT count(*) AS n, count(DISTINCT fam) AS m FROM rec), w AS (SELECT max(c) AS w FROM (SELECT count(*) AS c FROM rec GROUP BY fam)),
fm AS (SELECT k, num, den, n * num // den AS U, (n * 5 + 99) // 100 AS L, n, m, w FROM s, w, (VALUES (2), (3), (5), (7)) t(k), (VALUES (15, 100), (1, 4), (1, 2)) b(num, den)),
fb AS (SELECT k, num, den, U, L, concat_ws('; ', CASE WHEN m < k THEN 'm<K' END, CASE WHEN w > U THEN 'max_w>U' END, CASE WHEN k * U < n THEN 'K*U<n' END, CASE WHEN k * L > n THEN 'K*L>n' END) AS blocked_by FROM fm)
"""


def feasibility(spark, d):
    groups = B.rec(spark, d).groupBy(F.col("fam").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(k, a, b) for k in (2, 3, 5, 7) for a, b in ((15, 100), (1, 4), (1, 2))], "k long, num long, den long")
    return A.feasibility_map(groups, grid)


@query(FEASIBLE + "SELECT k::BIGINT AS k, num::BIGINT AS num, den::BIGINT AS den, U, L, blocked_by = '' AS feasible, blocked_by FROM fb")
def feasibility_map(spark, d):
    return feasibility(spark, d)


@query(FEASIBLE + "SELECT k::BIGINT AS k, num::BIGINT AS num, den::BIGINT AS den, CASE WHEN blocked_by = '' THEN 'feasible' WHEN blocked_by LIKE '%m<K%' OR blocked_by LIKE '%K*L>n%' THEN 'impossible' ELSE 'bound' END AS state FROM fb")
def feasibility_state(spark, d):
    return A.feasibility_state(feasibility(spark, d)).select("k", "num", "den", "state")


#: Every vector of fold loads that groups can reach, one group after another, for two to four folds.
REACHED = """WITH RECURSIVE g AS (SELECT 'nation' AS relation, s_nationkey % 25 AS label, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT 'block', s_nationkey % 7, count(*) FROM supplier GROUP BY ALL UNION ALL SELECT 'pair', s_nationkey % 3, count(*) FROM supplier GROUP BY ALL),
o AS (SELECT relation, n, row_number() OVER (PARTITION BY relation ORDER BY label) AS i FROM g), t AS (SELECT relation, sum(n) AS n, count(*) AS m FROM g GROUP BY relation),
v AS (SELECT DISTINCT relation, k, 0::BIGINT AS i, list_resize([]::BIGINT[], k, 0) AS loads FROM o, (VALUES (2), (3), (4)) x(k)
  UNION SELECT v.relation, k, o.i, list_sort(list_transform(loads, lambda x, j: CASE WHEN j = f THEN x + n ELSE x END)) FROM v JOIN o ON o.relation = v.relation AND o.i = v.i + 1, unnest(range(1, k + 1)) u(f)),
b AS (SELECT v.relation, k, min(list_max(loads)) FILTER (list_min(loads) > 0 AND list_min(loads) >= (n * 5 + 99) // 100) AS num, any_value(n) AS den FROM v JOIN t ON t.relation = v.relation AND v.i = m GROUP BY v.relation, k) """


@query(REACHED + "SELECT relation, k::BIGINT AS k, num::BIGINT AS num, den::BIGINT AS den, true AS proven, true AS certified FROM b", False)
def min_feasible_bound(spark, d):
    """Suppliers by nation and by two coarser relations; the certificate is held against the sizes of groups and the bound."""
    key = F.col("s_nationkey")
    s = read_table(spark, d, "supplier").select(F.explode(F.array(*[F.struct(F.lit(name).alias("relation"), (key % m).alias("label")) for name, m in (("nation", 25), ("block", 7), ("pair", 3))])).alias("x")).select("x.*")
    groups = written(s.groupBy("relation", "label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    found = written(A.min_feasible_bound(groups, spark.createDataFrame([(2,), (3,), (4,)], "k long"), ["relation"]), "bounds")
    held = found.select("relation", "k", "num", F.explode("certificate").alias("x")).select("relation", "k", "num", "x.*")
    folds = held.groupBy("relation", "k", "num", "fold").agg(F.sum(F.col("size") * F.col("groups")).alias("load")).groupBy("relation", "k", "num").agg((F.max("load") == F.col("num")).alias("met"), F.count(F.lit(1)).alias("folds"))
    used = held.groupBy("relation", "k", F.col("size").alias("n")).agg(F.sum("groups").alias("c"))
    sizes = groups.groupBy("relation", "n").agg(F.count(F.lit(1)).alias("g")).join(found.where("num is not null").select("relation", "k"), "relation")
    same = sizes.join(used, ["relation", "k", "n"], "left").groupBy("relation", "k").agg(F.bool_and(F.coalesce("c", F.lit(0)) == F.col("g")).alias("whole"))
    ok = folds.join(same, ["relation", "k"]).select("relation", "k", (F.col("met") & F.col("whole") & (F.col("folds") == F.col("k"))).alias("ok"))
    return found.join(ok, ["relation", "k"], "left").select("relation", "k", "num", "den", "proven", F.coalesce("ok", F.col("num").isNull()).alias("certified"))


@query("SELECT scenario, outer_fold, protocol, n_train::BIGINT AS n_train, L::BIGINT AS L, U::BIGINT AS U, K, array_to_string(fold_sizes, ',') AS fold_sizes, array_to_string(groups_per_fold, ',') AS groups_per_fold, within_bounds, groups, groups >= K AS enough_groups, within_bounds AND groups >= K AS admissible FROM iadm")
def inner_admissibility(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return B.inner_verdicts(spark, d).withColumns({"fold_sizes": text("fold_sizes"), "groups_per_fold": text("groups_per_fold")})


@query('SELECT min(list_min(sizes) - L)::BIGINT AS "least_above_L", max(list_max(sizes)) AS largest_fold, min(U) AS "U_min", max(U) AS "U_max" FROM adm')
def slack_summary(spark, d):
    return A.slack_summary(verdicts(spark, d))


@query("SELECT count(*) AS executed, count(*) FILTER (below = 0 AND above = 0) AS admissible, count(*) FILTER (below + above > 0) AS inadmissible, coalesce(string_agg('part/' || variant, ',' ORDER BY variant) FILTER (below + above > 0), '') AS list FROM (SELECT variant, below, above FROM adm UNION ALL SELECT 'family5', 0, count(*) FILTER (c < 200 OR c > 300) FROM (SELECT count(*) AS c FROM rec GROUP BY fam))")
def split_ledger(spark, d):
    return A.split_ledger(ledger_rows(spark, d))


def ledger_rows(spark, d):
    """All verdicts, and one by family sizes against fixed bounds."""
    v = verdicts(spark, d).select(F.lit("part").alias("dataset"), "variant", "admissible")
    fam = B.rec(spark, d).groupBy("fam").agg(F.count(F.lit(1)).alias("c")).agg(F.bool_and(F.col("c").between(200, 300)).alias("admissible"))
    return v.unionByName(fam.select(F.lit("part").alias("dataset"), F.lit("family5").alias("variant"), "admissible"))


@query("SELECT count(*) AS splits, count(DISTINCT CASE WHEN variant IN ('family5', 'holdout') THEN 'family' ELSE variant END) AS structures FROM (SELECT variant FROM adm WHERE below + above > 0 UNION ALL SELECT 'family5' FROM (SELECT count(*) AS c FROM rec GROUP BY fam) HAVING count(*) FILTER (c < 200 OR c > 300) > 0)")
def inadmissible_structures(spark, d):
    return A.inadmissible_structures(ledger_rows(spark, d), spark.createDataFrame([("family5", "family"), ("holdout", "family")], "variant string, structure string"))


ALIASED = ", cp AS (SELECT * FROM pairs UNION ALL SELECT 'copy', * EXCLUDE (variant) FROM pairs WHERE variant = 'source5') "


@query(ALIASED + "SELECT count(*) AS executed, count(*) FILTER (NOT split_admissible) AS inadmissible, count(*) FILTER (split_admissible) AS admissible, count(*) FILTER (split_admissible AND variant <> 'source5') AS distinct_evaluations, (SELECT count(*) FROM (SELECT variant FROM cp GROUP BY variant HAVING count(*) FILTER (split_admissible) = 0)) AS variants_inadmissible, (SELECT count(*) FROM (SELECT variant FROM cp GROUP BY variant HAVING count(*) FILTER (split_admissible) BETWEEN 1 AND count(*) - 1)) AS variants_partly, count(*) FILTER (split_admissible AND variant = 'source5') AS alias_evaluations FROM cp")
def admissibility_ledger(spark, d):
    return A.admissibility_ledger(copied_pairs(spark, d).withColumn("dataset", F.lit("part")), S.split_alias(with_copy(spark, d)))


def pairs(spark, d):
    a = B.assignments(spark, d)
    m, v = B.together(lambda: written(M.control_metrics(B.predictions(spark, d, a=a)), "metrics"), lambda: verdicts(spark, d, a))
    p = C.contrast_pairs(m, spark.createDataFrame(B.HONOURED, "variant string, sizematch string"))
    return C.contrast_admissible(p, v)


def copied_pairs(spark, d):
    p = pairs(spark, d)
    return p.unionByName(p.where("variant = 'source5'").withColumn("variant", F.lit("copy")))


# Graph


def chained_rows(spark, d):
    """Suppliers in overlapping runs of three, by either relation: long chains, broken where one or both are NULL."""
    k = F.col("s_suppkey")
    a = F.when(k % 7 != 0, F.concat(F.lit("a"), F.floor(k / 3).cast("string")))
    b = F.when(k % 5 != 0, F.concat(F.lit("b"), F.floor((k + 1) / 3).cast("string")))
    return read_table(spark, d, "supplier").select(k.alias("row_id"), a.alias("a"), b.alias("b"))


COMPONENT = """WITH RECURSIVE r AS (SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 7 <> 0 THEN 'a' || (s_suppkey // 3) END AS a, CASE WHEN s_suppkey % 5 <> 0 THEN 'b' || ((s_suppkey + 1) // 3) END AS b FROM supplier),
hop AS (SELECT DISTINCT x.a AS p, y.a AS q FROM r x JOIN r y ON x.b = y.b WHERE x.a IS NOT NULL AND y.a IS NOT NULL),
reach AS (SELECT DISTINCT a AS p, a AS q FROM r WHERE a IS NOT NULL UNION SELECT reach.p, hop.q FROM reach JOIN hop ON reach.q = hop.p),
la AS (SELECT p AS a, min(q) AS label FROM reach GROUP BY p), lb AS (SELECT b, min(label) AS label FROM r JOIN la USING (a) WHERE b IS NOT NULL GROUP BY b),
c AS (SELECT row_id, coalesce(la.label, lb.label, 'b:' || r.b, 'row:' || row_id) AS component FROM r LEFT JOIN la ON r.a = la.a LEFT JOIN lb ON r.b = lb.b) """


@query(COMPONENT + "SELECT row_id, component FROM c", False)
def union_components(spark, d):
    return G.union_components(chained_rows(spark, d), "a", "b").select("row_id", "component")


@query(COMPONENT + "SELECT count(*) AS components, max(n) AS largest, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS share FROM (SELECT component, count(*) AS n FROM c GROUP BY component)", False)
def component_concentration(spark, d):
    return B.rounded(G.component_concentration(G.union_components(chained_rows(spark, d), "a", "b")))


@query("SELECT campaign, " + ", ".join(f'count(*) FILTER (kind = \'{k}\') AS "{k}"' for k in "ABCDE") + ", count(*) AS total FROM camp GROUP BY campaign")
def incidence_matrix(spark, d):
    return G.incidence_matrix(B.campaign_rows(spark, d), "campaign", "kind", list("ABCDE"))


@query("SELECT array_to_string(types, '+') AS types, count(*) AS campaigns, sum(n)::BIGINT AS records FROM sig GROUP BY types")
def type_signature(spark, d):
    return G.signature_counts(B.signatures(spark, d)).withColumn("types", F.array_join("types", "+"))


@query("SELECT t AS type, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS bridging FROM (SELECT unnest(types) AS t, len(types) AS k FROM sig) GROUP BY t")
def single_vs_bridging(spark, d):
    return G.single_vs_bridging(B.signatures(spark, d))


@query(", u AS (SELECT DISTINCT unnest(types) AS u FROM sig), t AS (SELECT unnest(types) AS t, types FROM sig) SELECT t, u, count(*) AS support, count(*) FILTER (NOT list_contains(types, u)) AS violations FROM t, u WHERE t <> u GROUP BY t, u")
def type_implication(spark, d):
    return G.type_implication(B.signatures(spark, d), absent=True)


def structures(spark, d):
    kinds = [r.k for r in B.campaign_rows(spark, d).select(F.col("kind").alias("k")).distinct().orderBy("k").limit(G.MOST_LEVELS + 1).collect()]
    return G.structure_candidates(spark, kinds)


STRUCTURES = """, kk AS (SELECT list_sort(list(DISTINCT kind)) AS kinds FROM camp),
grow AS (SELECT 0 AS i, []::BIGINT[] AS a, 0::BIGINT AS mx UNION ALL SELECT i + 1, list_append(a, c), greatest(mx, c) FROM grow, kk, unnest(range(0, mx + 2)) u(c) WHERE i < len(kinds)),
sts AS (SELECT array_to_string(list_transform(range(1, mx + 1), lambda c: array_to_string(list_filter(kinds, lambda k, j: a[j] = c), '+')), '/') AS structure, a, mx, kinds FROM grow, kk WHERE i = len(kinds) AND mx > 0),
sgs AS (SELECT types, count(*) AS c, sum(n)::BIGINT AS n FROM sig GROUP BY types),
hel AS (SELECT structure, types, c, n, list_distinct(list_filter(list_transform(types, lambda t: a[list_position(kinds, t)]), lambda x: x > 0)) AS cl, a, kinds FROM sgs, sts),
sev AS (SELECT structure, types, c, n, CASE WHEN len(cl) = 1 THEN array_to_string(list_filter(kinds, lambda k, j: a[j] = cl[1]), '+') END AS cluster FROM hel)
"""


@query(STRUCTURES + "SELECT structure, mx::INT AS clusters FROM sts")
def structure_candidates(spark, d):
    return structures(spark, d).select("structure", F.size("clusters").alias("clusters"))


@query(STRUCTURES + "SELECT structure, array_to_string(types, '+') AS types, c, n, cluster FROM sev")
def structure_eval(spark, d):
    return G.structure_eval(B.signatures(spark, d), structures(spark, d)).select("structure", F.array_join("types", "+").alias("types"), "c", "n", "cluster")


@query(STRUCTURES + ", cnt AS (SELECT structure, count(DISTINCT cluster) AS folds FROM sev GROUP BY structure) SELECT folds, structure FROM cnt ORDER BY folds DESC, structure LIMIT 1")
def fold_ceiling(spark, d):
    return G.fold_ceiling(G.structure_eval(B.signatures(spark, d), structures(spark, d)))


def selection(spark, d):
    return written(G.discard_select(B.signatures(spark, d), structures(spark, d), [2, 3, 4, 5]), "selection")


#: The selection again: removals in order, every state of the clusters, every way to deal them, the first that fits.
SELECTED = STRUCTURES + """, mem AS (SELECT e.structure, e.cluster, s.campaign, count(*) AS n FROM sev e JOIN sig s ON s.types = e.types JOIN camp p ON p.campaign = s.campaign AND list_contains(string_split(e.cluster, '+'), p.kind) WHERE e.cluster IS NOT NULL GROUP BY ALL),
rm0 AS (SELECT *, row_number() OVER (PARTITION BY structure, cluster ORDER BY n, campaign) AS i, sum(n) OVER (PARTITION BY structure, cluster ORDER BY n, campaign ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS size, count(*) OVER (PARTITION BY structure, cluster) AS m FROM mem),
rms AS (SELECT structure, cluster, campaign, n, row_number() OVER (PARTITION BY structure ORDER BY size DESC, cluster, i) AS step FROM rm0 WHERE i < m),
whl AS (SELECT structure, cluster, sum(n) AS whole FROM mem GROUP BY ALL), grd AS (SELECT structure, step FROM rms UNION SELECT structure, 0 FROM whl),
gne AS (SELECT g.structure, g.step, r.cluster, sum(r.n) AS gone FROM grd g JOIN rms r ON r.structure = g.structure AND r.step <= g.step GROUP BY ALL),
sta AS (SELECT g.structure, g.step, w.cluster, whole - coalesce(gone, 0) AS size FROM grd g JOIN whl w USING (structure) LEFT JOIN gne x ON x.structure = g.structure AND x.step = g.step AND x.cluster = w.cluster),
clu AS (SELECT structure, step, count(*) AS m, sum(size)::BIGINT AS retained, list(size::BIGINT ORDER BY cluster) AS parts, list(cluster ORDER BY cluster) AS clusters FROM sta GROUP BY structure, step),
rgs AS (SELECT 0 AS i, []::BIGINT[] AS places, 0::BIGINT AS k UNION ALL SELECT i + 1, list_append(places, f), greatest(k, f + 1) FROM rgs, unnest(range(0, k + 1)) u(f) WHERE i < 5),
fld AS (SELECT clu.*, k, places, list_reverse_sort(list_transform(range(0, k), lambda f: list_sum(list_transform(parts, lambda n, j: CASE WHEN places[j] = f THEN n ELSE 0 END)))) AS sizes FROM clu JOIN rgs ON i = m AND k BETWEEN 2 AND 5),
fst1 AS (SELECT * FROM fld WHERE list_min(sizes) >= (retained * 5 + 99) // 100 AND list_max(sizes) <= retained * 50 // 100 QUALIFY row_number() OVER (PARTITION BY structure, k ORDER BY step, places) = 1),
best AS (SELECT * FROM fst1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY retained DESC, structure) = 1),
kep AS (SELECT b.k, m.campaign, m.cluster, b.places[list_position(b.clusters, m.cluster)] AS fold FROM best b JOIN mem m USING (structure) LEFT JOIN rms r ON r.structure = m.structure AND r.campaign = m.campaign WHERE r.step IS NULL OR r.step > b.step)
"""


@query(SELECTED + "SELECT k::INT AS k, structure, step::INT AS step, retained, array_to_string(list_transform(sizes, lambda x: x::BIGINT), ',') AS sizes FROM best")
def discard_select(spark, d):
    return selection(spark, d).select("k", "structure", "step", "retained", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


def kept(spark, d):
    return G.kept_campaigns(B.signatures(spark, d), structures(spark, d), selection(spark, d))


@query(SELECTED + "SELECT b.k::INT AS k, s.campaign, s.n AS records, array_to_string(s.types, '+') AS types FROM best b, sig s WHERE NOT EXISTS (SELECT 1 FROM kep WHERE kep.k = b.k AND kep.campaign = s.campaign) AND EXISTS (SELECT 1 FROM kep WHERE kep.k = b.k)")
def quarantine_selected(spark, d):
    """Campaigns that the selection for each K leaves out."""
    s, k = B.signatures(spark, d), written(kept(spark, d), "kept")
    wanted = k.select("k").distinct().join(s, how="cross")  # a few K
    return wanted.join(k.select("k", "campaign"), ["k", "campaign"], "left_anti").select("k", "campaign", F.col("n").alias("records"), F.array_join("types", "+").alias("types"))


@query(SELECTED + ", w AS (SELECT k, fold, campaign, kind FROM camp JOIN kep USING (campaign) WHERE list_contains(string_split(cluster, '+'), kind)), v AS (SELECT k, 'campaign' AS relation, campaign AS v, count(DISTINCT fold) AS c FROM w GROUP BY ALL UNION ALL SELECT k, 'kind', kind, count(DISTINCT fold) FROM w GROUP BY ALL) SELECT k::INT AS k, relation, count(*) AS values, count(*) FILTER (c > 1) AS straddling FROM v GROUP BY k, relation")
def closure_selected(spark, d):
    """Values of either relation that straddle the folds of the selection for each K."""
    k = written(kept(spark, d), "kept")
    rows = B.campaign_rows(spark, d).join(k, "campaign").where(F.array_contains(F.split("cluster", r"\+"), F.col("kind")))
    return G.closure_verify(rows.select("k", "row_id", "campaign", "kind"), rows.select("k", "row_id", "fold"), ["campaign", "kind"], ["k"])


@query("SELECT campaign, n AS records, array_to_string(types, '+') AS types FROM sig WHERE len(types) > 1")
def quarantine_list(spark, d):
    s = B.signatures(spark, d)
    return G.quarantine_list(s, s.where(F.size("types") == 1)).withColumn("types", F.array_join("types", "+"))


@query(", f AS (SELECT row_id, campaign, kind, ascii(kind) % 3 AS fold FROM camp), v AS (SELECT 'campaign' AS relation, campaign AS v, count(DISTINCT fold) AS k FROM f GROUP BY campaign UNION ALL SELECT 'kind', kind, count(DISTINCT fold) FROM f GROUP BY kind) SELECT relation, count(*) AS values, count(*) FILTER (k > 1) AS straddling FROM v GROUP BY relation")
def closure_verify(spark, d):
    rows = B.campaign_rows(spark, d)
    return G.closure_verify(rows, rows.select("row_id", (F.ascii("kind") % 3).alias("fold")), ["campaign", "kind"])


# Learners


@query("SELECT variant, model, fold::BIGINT AS fold, row_id, y, round(p, 6) AS p FROM pred WHERE model = 'dummy'")
def learn_dummy_mean(spark, d):
    return B.rounded(L.learn_dummy_mean(B.rec(spark, d), B.assignments(spark, d)))


@query("SELECT variant, model, fold::BIGINT AS fold, row_id, y, round(p, 6) AS p FROM pred WHERE model = 'ridge'")
def learn_ridge(spark, d):
    return B.rounded(L.learn_ridge1(B.rec(spark, d), B.assignments(spark, d)))


TWO = """, gs AS (SELECT variant, fold, count(*) AS n, sum(y) AS y, sum(x) AS x, sum(sz) AS z, sum(x * x) AS xx, sum(sz * sz) AS zz, sum(x * sz) AS xz, sum(x * y) AS xy, sum(sz * y) AS zy FROM asg JOIN rec USING (row_id) GROUP BY variant, fold),
gt AS (SELECT count(*) AS n, sum(y) AS y, sum(x) AS x, sum(sz) AS z, sum(x * x) AS xx, sum(sz * sz) AS zz, sum(x * sz) AS xz, sum(x * y) AS xy, sum(sz * y) AS zy FROM rec),
tm AS (SELECT variant, fold, t.n - g.n AS n, (t.y - g.y) / (t.n - g.n) AS my, (t.x - g.x) / (t.n - g.n) AS mx, (t.z - g.z) / (t.n - g.n) AS mz, t.xx - g.xx AS xx, t.zz - g.zz AS zz, t.xz - g.xz AS xz, t.xy - g.xy AS xy, t.zy - g.zy AS zy FROM gs g, gt t),
td AS (SELECT *, sqrt(xx / n - mx * mx) AS dx, sqrt(zz / n - mz * mz) AS dz FROM tm),
tz AS (SELECT *, (xz - n * mx * mz) / dx / dz AS c, (xy - n * mx * my) / dx AS b1, (zy - n * mz * my) / dz AS b2 FROM td)
"""


@query(TWO + "SELECT a.variant, 'ridge' AS model, a.fold::BIGINT AS fold, row_id, y, round(my + (x - mx) / dx * (((n + 1) * b1 - c * b2) / ((n + 1) * (n + 1) - c * c)) + (sz - mz) / dz * (((n + 1) * b2 - c * b1) / ((n + 1) * (n + 1) - c * c)), 6) AS p FROM asg a JOIN rec USING (row_id) JOIN tz ON tz.variant = a.variant AND tz.fold = a.fold")
def learn_ridge_multi(spark, d):
    rows = B.rec(spark, d).withColumn("sz", F.col("sz").cast("double"))
    return B.rounded(L.learn_ridge(rows, B.assignments(spark, d), ["x", "sz"]))


@query("SELECT variant, model, fold::BIGINT AS fold, row_id, y, round(p, 6) AS p FROM pred")
def oof_predict(spark, d):
    return B.rounded(B.predictions(spark, d))


def ml_rows(spark, d):
    return B.rec(spark, d).select("row_id", "y", "x", F.col("sz").cast("double").alias("sz"))


@query()
def learn_rf_reg(spark, d):
    return L.learn_rf_reg(ml_rows(spark, d), B.assignments(spark, d, ["source5"]), ["x", "sz"])


@query()
def learn_gbt_reg(spark, d):
    return L.learn_gbt_reg(ml_rows(spark, d), B.assignments(spark, d), ["x", "sz"])


@query()
def contrast_trees(spark, d):
    """The contrasts of every honoured split for boosted trees, beside those of the mean and ridge."""
    a = B.assignments(spark, d)
    p = written(L.learn_gbt_reg(ml_rows(spark, d), a, ["x", "sz"]).unionByName(B.predictions(spark, d, a=a)), "tree-predictions")
    pairs_ = C.contrast_pairs(written(M.control_metrics(p), "tree-metrics"), spark.createDataFrame(B.HONOURED, "variant string, sizematch string"))
    return C.contrast_admissible(pairs_, verdicts(spark, d, a))


def quality_rows(spark, d):
    docs = read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id")
    share = F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.lit(1), F.length("text"))
    marks = F.regexp_count("text", F.lit("[!#$%&*|]")) / F.greatest(F.lit(1), F.length("text"))
    return docs.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("y"), "source", share.alias("upper"), marks.alias("marks"))


@query()
def learn_rf_clf(spark, d):
    return classified(spark, d)


def classified(spark, d):
    rows = quality_rows(spark, d)
    return L.learn_rf_clf(rows, S.split_group_k(rows, "source", 3).withColumn("variant", F.lit("source3")), ["upper", "marks"])


@query()
def score_refit(spark, d):
    rows = ml_rows(spark, d)
    return L.score_refit(rows, B.variants(spark, d, ["source5"]).drop("variant"), ["x", "sz"])


# Metrics


@query("SELECT variant, model, n, round(pooled_r2, 6) AS pooled_r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM met")
def metric_pooled_r2(spark, d):
    return B.rounded(M.metric_pooled(B.predictions(spark, d), ["variant", "model"]))


@query("SELECT variant, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM pred WHERE model = 'ridge' GROUP BY variant")
def metric_rmse(spark, d):
    return B.rounded(M.metric_pooled(B.predictions(spark, d).where("model = 'ridge'"), ["variant"]).select("variant", "rmse", "mae"))


@query("SELECT variant, model, round(fold_mean_r2, 6) AS fold_mean_r2, round(fold_sd_r2, 6) AS fold_sd_r2, n_folds FROM met")
def metric_fold_r2(spark, d):
    return B.rounded(M.metric_fold_r2(B.predictions(spark, d), ["variant", "model"]))


@query(f"SELECT variant, model, CASE WHEN grouping(fam) = 1 THEN 'all' ELSE fam END AS family, count(*) AS n, round({B.R2}, 6) AS r2 FROM (SELECT p.*, fam FROM pred p JOIN rec USING (row_id)) GROUP BY GROUPING SETS ((variant, model, fam), (variant, model))")
def metric_by_family(spark, d):
    return B.rounded(M.metric_by_family(B.predictions(spark, d), B.rec(spark, d).select("row_id", F.col("fam").alias("family")), ["variant", "model"]))


@query(f"SELECT model, count(*) AS n, round(max(a), 6) AS r2_a, round(max(b), 6) AS r2_b, round(max(a) - max(b), 6) AS delta FROM (SELECT h.model, h.row_id FROM pred h WHERE h.variant = 'holdout') JOIN (SELECT model, {B.R2} AS a FROM pred WHERE variant = 'holdout' GROUP BY model) USING (model) JOIN (SELECT r.model, {B.R2.replace('y', 'r.y').replace('(r.y - p)', '(r.y - r.p)')} AS b FROM pred r JOIN a_holdout h ON h.row_id = r.row_id WHERE r.variant = 'random5' GROUP BY r.model) USING (model) GROUP BY model")
def metric_same_rows(spark, d):
    p = B.predictions(spark, d, ["holdout", "random5"])
    return B.rounded(M.metric_same_rows(p.where("variant = 'holdout'"), p.where("variant = 'random5'")))


@query(", per AS (SELECT variant, model, src, count(*) AS k, sum((y - p) ** 2) AS sse FROM pred JOIN (SELECT row_id, src FROM rec) USING (row_id) GROUP BY ALL), w AS (SELECT variant, model, sum(k)::BIGINT AS n, count(*) AS n_sources, sum(sse) / sum(k) AS mr, avg(sse / k) AS ms FROM per GROUP BY ALL) SELECT variant, model, n, n_sources, round(mr, 6) AS mse_record_weighted, round(ms, 6) AS mse_source_equal, round(sqrt(mr), 6) AS rmse_record_weighted, round(sqrt(ms), 6) AS rmse_source_equal, round(ms / mr, 6) AS ratio FROM w")
def weight_source_equal(spark, d):
    return B.rounded(M.weight_source_equal(B.predictions(spark, d), B.rec(spark, d).select("row_id", F.col("src").alias("source"))))


ACCURACY = "WITH q AS (SELECT doc_id % 3 AS fold, quality AS y, CASE WHEN text LIKE '%!!%' OR text LIKE '%***%' THEN 0 ELSE 1 END AS label FROM documents JOIN labels USING (doc_id)), f AS (SELECT fold, avg((y = label)::INT) AS a FROM q GROUP BY fold), r AS (SELECT fold, avg(r) AS b FROM (SELECT fold, y, avg((y = label)::INT) AS r FROM q GROUP BY fold, y) GROUP BY fold) "


@query(ACCURACY + "SELECT 'rule' AS variant, round(avg(a), 6) AS accuracy_mean, round(stddev_pop(a), 6) AS accuracy_sd, round(avg(b), 6) AS balanced_accuracy_mean, round(stddev_pop(b), 6) AS balanced_accuracy_sd, count(*) AS \"K\" FROM f JOIN r USING (fold)", False)
def metric_accuracy(spark, d):
    rows = read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id")
    label = F.when(F.col("text").contains("!!") | F.col("text").contains("***"), 0).otherwise(1)
    return B.rounded(M.metric_accuracy(rows.select(F.lit("rule").alias("variant"), (F.col("doc_id") % 3).alias("fold"), F.col("quality").alias("y"), label.alias("label")), ["variant"]))


@query(", tc AS (SELECT sz % 4 AS c, count(*) AS total FROM rec GROUP BY 1), ce AS (SELECT variant, fold, sz % 4 AS c, count(*) AS t FROM asg JOIN rec USING (row_id) GROUP BY ALL) SELECT variant, f.fold::BIGINT AS fold, count(*) FILTER (coalesce(t, 0) > 0) AS classes_test, count(*) FILTER (total > coalesce(t, 0)) AS classes_train, min(t) AS min_support FROM (SELECT DISTINCT variant, fold FROM ce) f CROSS JOIN tc LEFT JOIN ce USING (variant, fold, c) GROUP BY variant, f.fold")
def class_support(spark, d):
    return M.class_support(B.rec(spark, d).select("row_id", (F.col("sz") % 4).alias("y")), B.assignments(spark, d))


# Contrasts

PAIR_COLUMNS = "variant, model, round(r2_random5, 6) AS r2_random5, round(r2_sizematch, 6) AS r2_sizematch, round(r2_honoured, 6) AS r2_honoured, round(fold_mean_r2, 6) AS fold_mean_r2, round(fold_sd_r2, 6) AS fold_sd_r2, K, round(delta_vs_random, 6) AS delta_vs_random, round(delta_vs_sizematch, 6) AS delta_vs_sizematch"


@query(f"SELECT {PAIR_COLUMNS} FROM pairs")
def contrast_pairs(spark, d):
    return B.rounded(pairs(spark, d).drop("split_admissible"))


@query(f"SELECT {PAIR_COLUMNS}, split_admissible FROM pairs")
def contrast_admissible(spark, d):
    return B.rounded(pairs(spark, d))


@query("SELECT count(*) AS n, count(*) FILTER (delta_vs_sizematch < 0) AS degrades, round(median(delta_vs_sizematch), 6) AS median_delta, count(*) FILTER (r2_honoured < 0) AS below_zero FROM pairs WHERE split_admissible AND delta_vs_sizematch IS NOT NULL")
def contrast_summary(spark, d):
    return B.rounded(C.contrast_summary(pairs(spark, d)))


@query("SELECT p.variant, p.model, round(m.pooled_r2, 6) AS r2_dummy, r2_honoured < m.pooled_r2 AS below_dummy FROM pairs p LEFT JOIN met m ON m.variant = p.variant AND m.model = 'dummy'")
def contrast_dummy_ref(spark, d):
    out = C.contrast_dummy_ref(pairs(spark, d), M.control_metrics(B.predictions(spark, d)))
    return B.rounded(out.select("variant", "model", "r2_dummy", "below_dummy"))


STRATA = [("source5", "*", "source"), ("combo5", "*", "combination"), ("dup5", "part", "duplication"), ("dup5", "*", "unused"), ("holdout", "*", "family")]
STRATUM = "CASE variant WHEN 'source5' THEN 'source' WHEN 'combo5' THEN 'combination' WHEN 'dup5' THEN 'duplication' WHEN 'holdout' THEN 'family' END"


def strata(spark, d):
    return C.contrast_stratum(pairs(spark, d), spark.createDataFrame(STRATA, "variant string, dataset string, stratum string"), "part")


@query(f"SELECT variant, model, {STRATUM} AS stratum FROM pairs")
def contrast_stratum(spark, d):
    return strata(spark, d).select("variant", "model", "stratum")


@query(ALIASED + "SELECT variant, model FROM cp WHERE variant <> 'source5'")
def contrast_dealias(spark, d):
    return C.contrast_dealias(copied_pairs(spark, d), S.split_alias(with_copy(spark, d))).select("variant", "model")


@query(f"SELECT {STRATUM} AS stratum, count(delta_vs_sizematch) AS n, count(*) FILTER (delta_vs_sizematch < 0) AS degrading, round(median(delta_vs_sizematch), 6) AS median_delta FROM pairs GROUP BY 1")
def contrast_stratum_summary(spark, d):
    return B.rounded(C.contrast_stratum_summary(strata(spark, d)))


@query("SELECT variant, round(min(r2_honoured), 6) AS worst_r2, arg_min(model, r2_honoured) AS model FROM pairs GROUP BY variant")
def contrast_worst(spark, d):
    return B.rounded(C.contrast_worst(pairs(spark, d)))


@query("SELECT variant, model, CASE WHEN variant = 'combo5' OR delta_vs_sizematch IS NULL THEN 'not evaluated' ELSE 'evaluated' END AS comparison FROM pairs")
def contrast_not_evaluated(spark, d):
    p = pairs(spark, d).withColumn("delta_vs_sizematch", F.when(F.col("variant") != "combo5", F.col("delta_vs_sizematch")))
    out = C.contrast_not_evaluated(p)
    return out.withColumn("comparison", F.when(F.col("comparison") == "not evaluated", F.col("comparison")).otherwise("evaluated"))


# Decisions


@query("SELECT outer_fold, round(demand, 6) AS demand FROM dem")
def demand_quantile(spark, d):
    return B.rounded(B.demands(spark, d, written(S.split_group_k(B.log_rec(spark, d), "src", B.K), "outer")))


@query("SELECT outer_fold, model, knob::INT AS knob, count(*) FILTER (p >= ln(demand) + ln(1 + knob / 100.0)) AS released, count(*) FILTER (exp(y) < demand) AS unsafe FROM orow, knobs GROUP BY ALL")
def act_regression(spark, d):
    return D.by_rule(B.outer_rows(spark, d), ["outer_fold", "model"], B.KNOBS, {"released": D.act_regression, "unsafe": lambda knob: D.unsafe_regression()})


@query("SELECT knob::INT AS knob, count(*) AS n, count(*) FILTER ((p >= ln(demand) + ln(1 + knob / 100.0)) <> (exp(p) >= demand * (1 + knob / 100.0))) AS mismatches FROM orow, knobs GROUP BY knob")
def unit_check(spark, d):
    return D.unit_check(B.outer_rows(spark, d), B.KNOBS)


@query("SELECT scenario, action_set, model, count(DISTINCT knob) AS rules, min(knob)::INT AS least, max(knob)::INT AS most FROM crv GROUP BY ALL")
def rule_grid(spark, d):
    """The rules of each grid that every setting has been held against."""
    return B.curve(spark, d).groupBy("scenario", "action_set", "model").agg(F.countDistinct("knob").alias("rules"), F.min("knob").alias("least"), F.max("knob").alias("most"))


@query("SELECT outer_fold, protocol, model, knob::INT AS knob, count(*) FILTER (confidence * 100 >= knob) AS acts FROM cin, (SELECT unnest(range(0, 101, 20)) AS knob) GROUP BY ALL")
def act_confidence(spark, d):
    """Released rows of every confidence, on out-of-fold probabilities of the inner folds."""
    return D.by_rule(B.category_inner(B.category_design(spark, d)), ["outer_fold", "protocol", "model"], B.CONFIDENCES, {"acts": D.act_confidence})


@query("SELECT outer_fold, protocol, model, knob::INT AS knob, count(*) FILTER (confidence * 100 >= knob AND label <> 0) AS acts FROM cin, (SELECT unnest(range(0, 101, 20)) AS knob) GROUP BY ALL")
def act_not_designated(spark, d):
    """The same without rows that are predicted to be designated."""
    return D.by_rule(B.category_inner(B.category_design(spark, d)), ["outer_fold", "protocol", "model"], B.CONFIDENCES, {"acts": lambda knob: D.act_not_designated(knob, F.lit(B.DESIGNATED))})


@query("SELECT fold::BIGINT AS outer_fold, model, row_id, y, label, confidence FROM cout")
def learn_class_probabilities(spark, d):
    """Out-of-fold label and confidence of each labelled document."""
    return B.category_outer(spark, d, B.category_design(spark, d))


CURVE = "scenario, action_set, outer_fold, protocol, model, knob::INT AS knob, n_test, n_released, n_unsafe, round(n_unsafe / n_test::DOUBLE, 6) AS r_all, round(n_unsafe / nullif(n_released, 0)::DOUBLE, 6) AS r_released, round(n_released / n_test::DOUBLE, 6) AS coverage"


@query(f"SELECT {CURVE} FROM crv")
def risk_curve(spark, d):
    return B.rounded(B.curve(spark, d))


@query(f"SELECT {CURVE} FROM crv")
def risk_block(spark, d):
    """Every rule's block, counted rule by rule: what `risk_curve` gets from running sums."""
    made = B.designs(spark, d)
    counts = lambda act: {"n_test": lambda knob: F.lit(True), "n_released": act, "n_unsafe": lambda knob: act(knob) & F.col("unsafe")}
    release = D.by_rule(B.as_release(B.inner_rows(spark, d, made[B.RELEASE], made["demand"])), [*D.SETTING, "model"], B.KNOBS, counts(D.act_regression))
    rows = D.with_action_sets(B.category_inner(made[B.CATEGORY])).withColumns({"scenario": F.lit(B.CATEGORY), "unsafe": D.unsafe_category(F.lit(B.DESIGNATED))})
    return B.rounded(D.with_rates(release.unionByName(D.by_rule(rows, [*D.SETTING, "model"], B.CONFIDENCES, counts(B.category_acts)))))


@query(f"SELECT {CURVE}, alpha::INT AS alpha, feasible FROM cand")
def rule_candidates(spark, d):
    return B.rounded(B.candidates(spark, d))


@query("SELECT scenario, action_set, outer_fold, protocol, alpha::INT AS alpha, n_feasible, model, knob::INT AS knob, n_released FROM sel")
def rule_select(spark, d):
    return D.rule_select(B.candidates(spark, d)).select(*D.SETTING, "alpha", "n_feasible", "rule.model", "rule.knob", "rule.n_released")


@query("SELECT scenario, action_set, outer_fold, protocol, alpha::INT AS alpha, model, knob::INT AS knob, n_unsafe FROM fal")
def rule_fallback(spark, d):
    return D.rule_fallback(B.candidates(spark, d)).select(*D.SETTING, "alpha", "rule.model", "rule.knob", "rule.n_unsafe")


DECISION = "scenario, action_set, outer_fold, protocol, alpha::INT AS alpha, released, n_feasible, model, knob::INT AS knob, round(inner_r_all, 6) AS inner_r_all, round(inner_coverage, 6) AS inner_coverage, n_test, n_released, n_unsafe, round(r_all, 6) AS r_all, round(r_released, 6) AS r_released, round(coverage, 6) AS coverage, round(gap_r_all, 6) AS gap_r_all, target_met"


@query(f"SELECT {DECISION} FROM dec")
def decision_outer(spark, d):
    return B.rounded(B.realised(spark, d))


@query("SELECT scenario, action_set, protocol, alpha::INT AS alpha, round(avg(inner_r_all), 6) AS estimate, round(avg(r_all), 6) AS realised, round(avg(gap_r_all), 6) AS gap, count(*) FILTER (gap_r_all > 0) AS folds_above_estimate, count(*) FILTER (target_met) AS folds_meeting, round(avg(coverage), 6) AS mean_coverage, round(avg(r_released), 6) AS mean_r_released FROM dec GROUP BY ALL")
def decision_fold_means(spark, d):
    return B.rounded(D.decision_fold_means(B.realised(spark, d)))


POOLED = ", po AS (SELECT scenario, action_set, protocol, alpha, sum(n_test)::BIGINT AS n_test, sum(n_released)::BIGINT AS n_released, sum(n_unsafe)::BIGINT AS n_unsafe FROM dec GROUP BY ALL) "


@query(POOLED + "SELECT scenario, action_set, protocol, alpha::INT AS alpha, n_test, n_released, n_unsafe, round(n_unsafe / n_test::DOUBLE, 6) AS r_all, round(n_unsafe / nullif(n_released, 0)::DOUBLE, 6) AS r_released, round(n_released / n_test::DOUBLE, 6) AS coverage FROM po")
def decision_pooled(spark, d):
    return B.rounded(D.decision_pooled(B.realised(spark, d)))


@query(POOLED + "SELECT scenario, action_set, protocol, alpha::INT AS alpha, abs(round(n_unsafe / n_test::DOUBLE - n_released / n_test::DOUBLE * (n_unsafe / nullif(n_released, 0)::DOUBLE), 6)) AS pooled_gap, round(m, 6) AS mean_gap FROM po JOIN (SELECT scenario, action_set, protocol, alpha, avg(r_all) - avg(coverage) * avg(r_released) AS m FROM dec GROUP BY ALL) USING (scenario, action_set, protocol, alpha)")
def identity_check(spark, d):
    return B.rounded(D.identity_check(B.realised(spark, d))).withColumn("pooled_gap", F.abs("pooled_gap"))


@query(POOLED + "SELECT scenario, action_set, alpha::INT AS alpha, round(max(r) FILTER (protocol = 'random'), 6) AS random, round(max(r) FILTER (protocol = 'source'), 6) AS source, round(max(r) FILTER (protocol = 'source') - max(r) FILTER (protocol = 'random'), 6) AS difference, max(r) FILTER (protocol = 'source') < max(r) FILTER (protocol = 'random') AS better FROM (SELECT *, n_unsafe / n_test::DOUBLE AS r FROM po) GROUP BY scenario, action_set, alpha")
def protocol_compare(spark, d):
    return B.rounded(D.protocol_compare(B.realised(spark, d)))


@query("SELECT scenario, action_set, outer_fold, protocol, alpha::INT AS alpha, count(*) FILTER (feasible) AS n_feasible, count(*) AS n_rules, bool_or(NOT feasible) AS active FROM cand GROUP BY ALL")
def constraint_active(spark, d):
    return D.constraint_active(B.candidates(spark, d))


@query("SELECT scenario, action_set, outer_fold, protocol, count(DISTINCT model || knob) AS rules FROM cho GROUP BY ALL")
def rule_stability(spark, d):
    return D.rule_stability(D.rule_choose(B.candidates(spark, d)))


@query("SELECT scenario, action_set, protocol, count(b) AS steps, count(*) FILTER (inner_coverage < b) AS decreases FROM (SELECT *, lag(inner_coverage) OVER (PARTITION BY scenario, action_set, outer_fold, protocol ORDER BY alpha) AS b FROM cho WHERE released) GROUP BY scenario, action_set, protocol")
def coverage_monotone(spark, d):
    return D.coverage_monotone(D.rule_choose(B.candidates(spark, d)))


@query("SELECT scenario, action_set, protocol, round(gap_r_all, 6) AS gap, outer_fold, alpha::INT AS alpha FROM (SELECT *, row_number() OVER (PARTITION BY scenario, action_set, protocol ORDER BY gap_r_all DESC, outer_fold, alpha) AS r FROM dec) WHERE r = 1")
def gap_extreme(spark, d):
    return B.rounded(D.gap_extreme(B.realised(spark, d)))


QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(", " + ", ".join(f"v{i} AS (SELECT {q}::DOUBLE AS q, l_returnflag AS flag, quantile_cont(l_extendedprice, {q}) AS value FROM lineitem GROUP BY l_returnflag)" for i, q in enumerate(QUANTILES)) + " " + " UNION ALL ".join(f"SELECT flag, q, round(value, 6) AS value FROM v{i}" for i in range(len(QUANTILES))))
def exact_quantiles(spark, d):
    """Five quantiles of all prices of each return flag, found by counting."""
    rows = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return B.rounded(quantiles(rows, "l_extendedprice", QUANTILES, ["flag"]))


SWEEP = ", dq AS (" + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, outer_fold, quantile_cont(exp(y), {q}) AS demand FROM trn GROUP BY outer_fold" for q in QUANTILES) + """),
cq AS (SELECT q, i.outer_fold, protocol, model, knob, count(*) AS n_test, count(*) FILTER (p >= ln(demand) + ln(1 + knob / 100.0)) AS n_released, count(*) FILTER (exp(y) < demand AND p >= ln(demand) + ln(1 + knob / 100.0)) AS n_unsafe FROM ipred i JOIN dq USING (outer_fold), knobs GROUP BY ALL),
aq AS (SELECT *, n_unsafe / n_test::DOUBLE AS r_all, n_unsafe * 100 <= alpha * n_test AS feasible FROM cq, (VALUES (5), (10), (20)) t(alpha)),
sq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, outer_fold, protocol, alpha ORDER BY NOT feasible, CASE WHEN feasible THEN -n_released ELSE n_unsafe END, CASE WHEN feasible THEN knob ELSE 0 END, model, knob) AS r FROM aq) WHERE r = 1),
oq AS (SELECT s.q, s.outer_fold, s.protocol, s.alpha, s.r_all AS inner_r_all, count(*) FILTER (s.feasible AND p >= ln(demand) + ln(1 + knob / 100.0) AND exp(y) < demand) / count(*)::DOUBLE AS r_all FROM sq s JOIN dq ON dq.q = s.q AND dq.outer_fold = s.outer_fold JOIN opred o ON o.fold = s.outer_fold AND o.model = s.model GROUP BY ALL)
"""


@query(SWEEP + "SELECT q, protocol, count(*) AS settings, count(*) FILTER (r_all - inner_r_all > 0) AS above FROM oq GROUP BY q, protocol")
def demand_sweep_gap(spark, d):
    return D.demand_sweep_gap(B.demand_sweep(spark, d, QUANTILES))


# Policies

POLICY = "scenario, action_set, outer_fold, protocol, alpha::INT AS alpha"


@query(f'SELECT {POLICY}, G_mode AS "G_mode", G_model AS "G_model", G_knob::INT AS "G_knob", G_released AS "G_released", G_unsafe AS "G_unsafe" FROM pol')
def policy_grouped(spark, d):
    return P.policy_grouped(B.candidates(spark, d))


@query(f"""SELECT {POLICY}, CASE WHEN n_feasible > 0 THEN 'select' ELSE 'refuse' END AS "R_mode", CASE WHEN n_feasible > 0 THEN G_model END AS "R_model", CASE WHEN n_feasible > 0 THEN G_knob::INT END AS "R_knob", CASE WHEN n_feasible > 0 THEN G_released ELSE 0 END AS "R_released", CASE WHEN n_feasible > 0 THEN G_unsafe ELSE 0 END AS "R_unsafe" FROM pol""")
def policy_grouped_refuse(spark, d):
    return P.policy_grouped_refuse(B.candidates(spark, d))


AUDIT = """CASE WHEN live THEN 'select' ELSE 'refuse' END AS "A_mode", CASE WHEN live THEN G_model END AS "A_model", CASE WHEN live THEN G_knob::INT END AS "A_knob", CASE WHEN live THEN G_released ELSE 0 END AS "A_released", CASE WHEN live THEN G_unsafe ELSE 0 END AS "A_unsafe" """


@query(f"SELECT {POLICY}, {AUDIT} FROM pol")
def policy_audit(spark, d):
    design = B.designs(spark, d)
    return P.policy_audit(B.candidates(spark, d, design), B.inner_verdicts(spark, d, design))


def compared(spark, d):
    design = B.designs(spark, d)
    return P.policy_compare(B.candidates(spark, d, design), B.inner_verdicts(spark, d, design))


@query(f'SELECT {POLICY}, n_candidates, n_feasible, G_mode AS "G_mode", G_model AS "G_model", G_knob::INT AS "G_knob", G_released AS "G_released", G_unsafe AS "G_unsafe", {AUDIT}, live AS same_choice FROM pol')
def policy_compare(spark, d):
    return compared(spark, d)


@query("""SELECT CASE WHEN grouping(protocol) = 1 THEN 'all' ELSE scenario END AS scenario, CASE WHEN grouping(protocol) = 1 THEN 'all' ELSE action_set END AS action_set, CASE WHEN grouping(protocol) = 1 THEN 'all' ELSE protocol END AS protocol, count(*) AS settings, count(*) FILTER (NOT live) AS differing, count(*) FILTER (n_feasible = 0) AS empty_feasible, count(*) FILTER (NOT live) AS refused, sum(G_released)::BIGINT AS "G_released", sum(G_unsafe)::BIGINT AS "G_unsafe", coalesce(sum(G_released) FILTER (live), 0)::BIGINT AS "A_released", coalesce(sum(G_unsafe) FILTER (live), 0)::BIGINT AS "A_unsafe" FROM pol GROUP BY GROUPING SETS ((scenario, action_set, protocol), ())""")
def policy_summary(spark, d):
    return P.policy_summary(compared(spark, d))


UTILITY = ", ut AS (SELECT scenario, action_set, alpha, " + ", ".join(f"sum(CASE WHEN protocol = '{p}' THEN {c} ELSE 0 END)::BIGINT AS {a}" for p, c, a in [("random", "n_test", "N"), ("random", "n_released", "A_rand"), ("random", "n_unsafe", "E_rand"), ("source", "n_released", "A_src"), ("source", "n_unsafe", "E_src")]) + " FROM dec GROUP BY scenario, action_set, alpha) "


@query(UTILITY + 'SELECT scenario, action_set, alpha::INT AS alpha, N AS "N", A_rand AS "A_rand", E_rand AS "E_rand", A_src AS "A_src", E_src AS "E_src", A_src - A_rand AS "dA", E_src - E_rand AS "dE", (A_src - A_rand) - (E_src - E_rand) AS base, -(E_src - E_rand) AS coeff FROM ut')
def utility_sensitivity(spark, d):
    return P.utility_sensitivity(B.realised(spark, d))


@query(UTILITY + ", bc AS (SELECT scenario, action_set, alpha, (A_src - A_rand) - (E_src - E_rand) AS b, -(E_src - E_rand) AS c FROM ut) SELECT scenario, action_set, alpha::INT AS alpha, round(CASE WHEN c <> 0 AND -b / c::DOUBLE > 0 THEN -b / c::DOUBLE END, 6) AS break_even FROM bc")
def utility_break_even(spark, d):
    return B.rounded(P.utility_break_even(P.utility_sensitivity(B.realised(spark, d))))


CONCENTRATION = ", fc AS (SELECT scenario, action_set, outer_fold, " + ", ".join(f"sum({c}) FILTER (protocol = '{p}')::BIGINT AS {a}" for p, c, a in [("random", "n_unsafe", "random"), ("source", "n_unsafe", "source"), ("random", "n_released", "rr"), ("source", "n_released", "rs")]) + " FROM dec WHERE alpha = 5 GROUP BY scenario, action_set, outer_fold) "


@query(CONCENTRATION + "SELECT scenario, action_set, outer_fold, random, source, random - source AS avoided, rr AS released_random, rs AS released_source FROM fc")
def fold_concentration(spark, d):
    return P.fold_concentration(B.realised(spark, d), 5)


@query(CONCENTRATION + "SELECT scenario, action_set, outer_fold, random - source AS avoided, rr - rs AS coverage_cost FROM fc")
def fold_influence(spark, d):
    return P.fold_influence(P.fold_concentration(B.realised(spark, d), 5))


# Expectations


def suite(spark, d):
    """Named checks, each of a result against the same numbers found in another way from the rows."""
    a = B.assignments(spark, d)
    labels = B.rec(spark, d).select("row_id", F.col("src").alias("label"))
    leak = S.split_leak_check(a.where("variant = 'source5'"), labels, ["variant"])
    sizes = a.groupBy("variant", "row_id").agg(F.count(F.lit(1)).alias("k"))
    predicted = B.predictions(spark, d, a=a)
    m = written(M.control_metrics(predicted), "metrics")
    p = C.contrast_admissible(C.contrast_pairs(m, spark.createDataFrame(B.HONOURED, "variant string, sizematch string")), verdicts(spark, d, a))
    # Released and unsafe rows of the chosen rules, row by row. Only their counts meet other tables: written rows of few distinct values
    # are such small files that Spark would broadcast all of them.
    made = B.designs(spark, d)
    chosen = written(D.rule_choose(B.candidates(spark, d, made)).where(F.col("scenario") == B.RELEASE), "chosen")
    outer_rows = written(B.outer_rows(spark, d, made[B.RELEASE], made["demand"]), "outer-rows")
    rows = outer_rows.join(chosen, ["outer_fold", "model"]).where("released")
    released = rows.where(D.act_regression(F.col("knob"))).withColumn("unsafe", D.unsafe_regression())
    acts = written(released.groupBy("outer_fold", "protocol", "alpha").agg(F.count(F.lit(1)).alias("n"), F.count_if("unsafe").alias("u")), "acts")
    outer = written(D.decision_outer(chosen, outer_rows), "decisions")
    settings = outer.select("protocol", "alpha").distinct()
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pooled = settings.join(acts, ["protocol", "alpha"], "left").groupBy("protocol", "alpha").agg(none("n").alias("n_released"), none("u").alias("n_unsafe"))
    sign = F.when(F.col("protocol") == "source", 1).when(F.col("protocol") == "random", -1)
    utility = outer.select("alpha").distinct().join(acts, "alpha", "left").groupBy("alpha").agg(none(sign * F.col("n")).alias("dA"), none(sign * F.col("u")).alias("dE"))
    bad = lambda protocol: none(F.when(F.col("protocol") == protocol, F.col("u")))
    folds = outer.select("outer_fold").distinct().join(acts.where("alpha = 5"), "outer_fold", "left").groupBy("outer_fold").agg(bad("random").alias("random"), bad("source").alias("source"))
    registry = R.corpus_rollup(assets(spark, d)).where("part <> 'all'")
    odd = F.substring("p_brand", -1, 1).cast("int") % 2 == 1
    direct = read_table(spark, d, "part").groupBy(F.when(odd, "analysis").otherwise("inventory").alias("part")).agg(F.countDistinct("p_brand").alias("assets"), F.count(F.lit(1)).alias("records"))
    # Scores and errors from sums over the predictions, not from the metrics that the contrasts are made of.
    y, e = F.col("y"), F.col("p")
    raw = predicted.where("model = 'ridge'").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in {"sy": y, "yy": y * y, "yp": y * e, "pp": e * e}.items()])
    sse = F.col("yy") - 2 * F.col("yp") + F.col("pp")
    raw = {r.variant: r for r in raw.select("variant", (1 - sse / (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"), F.sqrt(sse / F.col("n")).alias("rmse")).collect()}
    worse = sum(raw[h].r2 < raw[c].r2 for h, c in B.HONOURED)
    ridge = p.where("model = 'ridge'")
    return E.expect_suite(
        [
            E.check(sizes, "each_row_once", F.max("k") == 1, F.max("k")),
            E.check(leak, "no_straddling", F.sum("straddling") == 0, F.sum("straddling")),
            E.expect_pooled(outer, pooled, ["protocol", "alpha"]),
            E.expect_utility(P.utility_sensitivity(outer), utility),
            E.expect_concentration(P.fold_concentration(outer, 5), folds.withColumn("avoided", F.col("random") - F.col("source"))),
            E.expect_registry(registry, direct, ["part"]),
            E.expect_contrast(ridge, worse, len(B.HONOURED)),
            E.expect_numeric_tolerance(ridge.where("variant = 'source5'"), "delta_vs_sizematch", raw["source5"].r2 - raw["source5_sm"].r2, 1e-6, "source_difference"),
            E.expect_numeric_tolerance(m.where("variant = 'source5' and model = 'ridge'"), "rmse", raw["source5"].rmse, 1e-6, "source_rmse"),
            E.expect_table_text_rules(m, ["pooled_r2", "rmse"], "variant", B.VARIANTS),
        ]
    )


#: Declared values: (version, check, key, value, tolerance). What must hold at every size of the tables.
DECLARED = [
    (1, "regions", "all", 5.0, 0.0), (1, "nations", "all", 25.0, 0.0), *[(1, "nations_of_region", str(k), 5.0, 0.0) for k in range(5)],
    (1, "assets", "analysis", 15.0, 0.0), (1, "assets", "inventory", 10.0, 0.0), (1, "each_row_once", "most", 1.0, 0.0), (1, "straddling", "source5", 0.0, 0.0),
    (1, "folds", "source5", 5.0, 0.0), (1, "folds", "combo5", 5.0, 0.0), (1, "folds", "dup5", 5.0, 0.0), (1, "settings", "release", 30.0, 0.0), (1, "settings", "category", 60.0, 0.0),
    (1, "ridge_r2", "random5", 0.95, 0.06), (1, "dummy_r2", "random5", 0.0, 0.05), (1, "discount", "most", 0.1, 1e-9), (0, "discount", "most", 0.2, 1e-9),
]


def measured(spark, d):
    """(check, key, value): what the tables and results hold."""
    a = B.assignments(spark, d)
    m = written(M.control_metrics(B.predictions(spark, d, ["random5"], a.where("variant = 'random5'"))), "metrics")
    leak = S.split_leak_check(a.where("variant = 'source5'"), B.rec(spark, d).select("row_id", F.col("src").alias("label")), ["variant"])
    number = lambda c: c.cast("double").alias("value")
    row = lambda df, check, key, value: df.select(F.lit(check).alias("check"), (key if isinstance(key, F.Column) else F.lit(key)).cast("string").alias("key"), number(value))
    parts = [
        row(read_table(spark, d, "region").agg(F.count(F.lit(1)).alias("n")), "regions", "all", F.col("n")),
        row(read_table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n")), "nations", "all", F.col("n")),
        row(read_table(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), "nations_of_region", F.col("n_regionkey"), F.col("n")),
        row(R.corpus_rollup(assets(spark, d)).where("part <> 'all'"), "assets", F.col("part"), F.col("assets")),
        row(a.groupBy("variant", "row_id").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("k")), "each_row_once", "most", F.col("k")),
        row(leak, "straddling", F.col("variant"), F.col("straddling")),
        row(a.where("variant in ('source5', 'combo5', 'dup5')").groupBy("variant").agg(F.countDistinct("fold").alias("k")), "folds", F.col("variant"), F.col("k")),
        row(B.realised(spark, d).groupBy("scenario").agg(F.count(F.lit(1)).alias("k")), "settings", F.col("scenario"), F.col("k")),
        row(m, F.concat("model", F.lit("_r2")), F.col("variant"), F.col("pooled_r2")),
        row(read_table(spark, d, "lineitem").agg(F.max("l_discount").alias("k")), "discount", "most", F.col("k")),
    ]
    return reduce(DataFrame.unionByName, parts)


DECLARED_SQL = (
    ", dcl(version, chk, key, expected, tolerance) AS (VALUES "
    + ", ".join(f"({v}, '{c}', '{k}', {x}::DOUBLE, {t}::DOUBLE)" for v, c, k, x, t in DECLARED)
    + """), mea(chk, key, value) AS (SELECT 'regions', 'all', count(*)::DOUBLE FROM region UNION ALL SELECT 'nations', 'all', count(*) FROM nation UNION ALL SELECT 'nations_of_region', n_regionkey::VARCHAR, count(*) FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'assets', CASE WHEN right(p_brand, 1)::INT % 2 = 1 THEN 'analysis' ELSE 'inventory' END, count(DISTINCT p_brand) FROM part GROUP BY ALL UNION ALL SELECT 'each_row_once', 'most', max(k) FROM (SELECT count(*) AS k FROM asg GROUP BY variant, row_id)
UNION ALL SELECT 'straddling', 'source5', count(*) FILTER (k > 1) FROM (SELECT count(DISTINCT fold) AS k FROM a_source5 JOIN rec USING (row_id) GROUP BY src) UNION ALL SELECT 'folds', variant, count(DISTINCT fold) FROM asg WHERE variant IN ('source5', 'combo5', 'dup5') GROUP BY variant
UNION ALL SELECT 'settings', scenario, count(*) FROM dec GROUP BY scenario UNION ALL SELECT model || '_r2', variant, 1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)) FROM pred WHERE variant = 'random5' GROUP BY ALL UNION ALL SELECT 'discount', 'most', max(l_discount) FROM lineitem),
"""
)


@query(DECLARED_SQL + """nul AS (SELECT 1) SELECT coalesce(d.chk, m.chk) AS "check", coalesce(d.key, m.key) AS key, d.expected, round(m.value, 6) AS value, CASE WHEN d.chk IS NULL THEN 'undeclared' WHEN m.value IS NULL THEN 'missing' WHEN abs(m.value - d.expected) <= d.tolerance THEN 'holds' ELSE 'differs' END AS status
FROM (SELECT * FROM dcl WHERE version = (SELECT max(version) FROM dcl)) d FULL JOIN mea m ON m.chk = d.chk AND m.key = d.key""")
def expect_declared(spark, d):
    """Measured values against the declared ones of the newest version."""
    declared = spark.createDataFrame(DECLARED, "version int, check string, key string, expected double, tolerance double")
    return B.rounded(E.expect_declared(measured(spark, d), declared).select("check", "key", "expected", "value", "status"))


#: Every check again, from the tables.
SUITE = """, acts AS (SELECT c.outer_fold, c.protocol, c.alpha, exp(y) < demand AS unsafe FROM cho c JOIN orow o ON o.outer_fold = c.outer_fold AND o.model = c.model WHERE scenario = 'release' AND released AND p >= ln(demand) + ln(1 + knob / 100.0)),
sums AS (SELECT variant, 1 - (sum(y * y) - 2 * sum(y * p) + sum(p * p)) / (sum(y * y) - sum(y) ** 2 / count(*)) AS r2, sqrt((sum(y * y) - 2 * sum(y * p) + sum(p * p)) / count(*)) AS rmse FROM pred WHERE model = 'ridge' GROUP BY variant),
suite AS (
SELECT 'each_row_once' AS name, max(k) = 1 AS ok FROM (SELECT count(*) AS k FROM asg GROUP BY variant, row_id)
UNION ALL SELECT 'no_straddling', max(k) = 1 FROM (SELECT count(DISTINCT fold) AS k FROM a_source5 JOIN rec USING (row_id) GROUP BY src)
UNION ALL SELECT 'pooled', bool_and(r = coalesce(n, 0) AND u = coalesce(b, 0)) FROM (SELECT protocol, alpha, sum(n_released) AS r, sum(n_unsafe) AS u FROM dec WHERE scenario = 'release' GROUP BY ALL) LEFT JOIN (SELECT protocol, alpha, count(*) AS n, count(*) FILTER (unsafe) AS b FROM acts GROUP BY ALL) USING (protocol, alpha)
UNION ALL SELECT 'utility', bool_and(r = coalesce(n, 0) AND u = coalesce(b, 0)) FROM (SELECT alpha, sum(CASE protocol WHEN 'source' THEN n_released ELSE -n_released END) AS r, sum(CASE protocol WHEN 'source' THEN n_unsafe ELSE -n_unsafe END) AS u FROM dec WHERE scenario = 'release' GROUP BY alpha) LEFT JOIN (SELECT alpha, sum(CASE protocol WHEN 'source' THEN 1 ELSE -1 END) AS n, sum(CASE WHEN NOT unsafe THEN 0 WHEN protocol = 'source' THEN 1 ELSE -1 END) AS b FROM acts GROUP BY alpha) USING (alpha)
UNION ALL SELECT 'concentration', bool_and(u = coalesce(b, 0)) FROM (SELECT outer_fold, protocol, n_unsafe AS u FROM dec WHERE alpha = 5 AND scenario = 'release') LEFT JOIN (SELECT outer_fold, protocol, count(*) FILTER (unsafe) AS b FROM acts WHERE alpha = 5 GROUP BY ALL) USING (outer_fold, protocol)
UNION ALL SELECT 'registry', bool_and(a.assets = b.assets AND a.records = b.records) AND count(*) = 2 FROM (SELECT in_analysis, count(*) AS assets, sum(records) AS records FROM (SELECT right(p_brand, 1)::INT % 2 = 1 AS in_analysis, count(*) AS records FROM part GROUP BY p_brand) GROUP BY in_analysis) a
  LEFT JOIN (SELECT regexp_matches(p_brand, '[13579]$') AS odd, count(DISTINCT p_brand) AS assets, count(*) AS records FROM part GROUP BY ALL) b ON a.in_analysis = b.odd
UNION ALL SELECT 'contrast', (SELECT count(*) FROM sums h JOIN ctl ON ctl.variant = h.variant JOIN sums s ON s.variant = ctl.sizematch WHERE h.r2 < s.r2) = count(*) FILTER (delta_vs_sizematch < 0) AND count(delta_vs_sizematch) = 4 FROM pairs WHERE model = 'ridge'
UNION ALL SELECT 'source_difference', abs(max(delta_vs_sizematch) - (SELECT max(r2) FILTER (variant = 'source5') - max(r2) FILTER (variant = 'source5_sm') FROM sums)) < 1e-6 FROM pairs WHERE model = 'ridge' AND variant = 'source5'
UNION ALL SELECT 'source_rmse', abs(max(rmse) - (SELECT max(rmse) FILTER (variant = 'source5') FROM sums)) < 1e-6 FROM met WHERE variant = 'source5' AND model = 'ridge'
UNION ALL SELECT 'no_nan', count(*) FILTER (isnan(pooled_r2) OR isnan(rmse)) = 0 FROM met
UNION ALL SELECT 'variant_set', list_sort(list(DISTINCT variant)) = """ + str(sorted(B.VARIANTS)) + """ FROM met)
"""


@query(SUITE + "SELECT name, coalesce(ok, false) AS ok FROM suite")
def expect_suite(spark, d):
    return suite(spark, d).select("name", "ok")


@query(SUITE + "SELECT count(*) FILTER (coalesce(ok, false)) AS passed, count(*) FILTER (NOT coalesce(ok, false)) AS failed FROM suite")
def suite_totals(spark, d):
    return E.suite_totals(suite(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far source-honouring folds lower the score against size-matched ones, with the verdict on each split."""
    return pairs(spark, sf_dir)
