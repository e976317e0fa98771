"""Audit operators against published shapes and small literal tables."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from provaudit.operators import admissibility as A
from provaudit.operators import decisions as D
from provaudit.operators import expect as E
from provaudit.operators import graph as G
from provaudit.operators import learners as L
from provaudit.operators import metrics as M
from provaudit.operators import policy as P
from provaudit.operators import relations as R
from provaudit.operators import splits as S
from provaudit.plans import base as B
from provaudit.plans import queries
from provaudit.plans.queries import ORACLES, QUERIES
from provaudit.sources import tables as T

SMALL = "/root/testdata/sf0.001"

# An incidence of our own, small enough to work out every result by hand.
INCIDENCE = {"m1": {"P": 6}, "m2": {"P": 4}, "m3": {"Q": 5}, "m4": {"Q": 5}, "m5": {"R": 4}, "m6": {"P": 1, "R": 1}}


@pytest.fixture(scope="module")
def signatures(spark):
    rows = [(c, t) for c, ts in INCIDENCE.items() for t, n in ts.items() for _ in range(n)]
    return G.type_signature(spark.createDataFrame(rows, "campaign string, kind string"), "campaign", "kind").cache()


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(0)
    data = [(i, float(r.normal()), f"s{r.integers(0, 12)}", "abc"[min(2, int(r.integers(0, 5)))], float(r.normal()), float(r.normal())) for i in range(240)]
    return spark.createDataFrame(data, "row_id long, y double, src string, fam string, x double, z double").cache()


def test_structures_worked_by_hand(spark, signatures):
    s = G.structure_candidates(spark, ["P", "Q", "R"])
    assert s.count() == 14  # partitions of the subsets of three levels: B(4) - 1
    assert G.fold_ceiling(G.structure_eval(signatures, s)).first().folds == 3
    selection = G.discard_select(signatures, s, [2, 3, 4, 5]).cache()
    best = {r.k: (r.structure, r.step, r.retained, r.sizes) for r in selection.collect()}
    # K=2: P+R has 6+4+4+2 = 16 beside Q's 10; without m6 and m2 it has 10, and 20 rows are kept. Other structures keep 20 too.
    # K=3: P 10, Q 10, R 4 fit as they are; m6 lies in two clusters.
    assert best == {2: ("P+R/Q", 2, 20, [10, 10]), 3: ("P/Q/R", 0, 24, [10, 10, 4])}
    kept = {}
    for r in G.kept_campaigns(signatures, s, selection).collect():
        kept.setdefault(r.k, {})[r.campaign] = r.fold
    assert set(kept[2]) == {"m1", "m3", "m4", "m5"} and kept[2]["m1"] == kept[2]["m5"] != kept[2]["m3"] == kept[2]["m4"]
    assert set(kept[3]) == {"m1", "m2", "m3", "m4", "m5"} and len({kept[3]["m1"], kept[3]["m3"], kept[3]["m5"]}) == 3
    left = G.quarantine_list(signatures, G.kept_campaigns(signatures, s, selection).where("k = 2")).collect()
    assert sorted((r.campaign, r.records, r.types) for r in left) == [("m2", 4, ["P"]), ("m6", 2, ["P", "R"])]


def test_implication(signatures):
    got = {(r.t, r.u): (r.support, r.violations) for r in G.type_implication(signatures).collect()}
    assert got == {("P", "R"): (3, 2), ("R", "P"): (2, 1)}  # pairs that no campaign has together are violated by all of the first


def test_implication_of_all_pairs(spark, signatures):
    got = {(r.t, r.u): (r.support, r.violations) for r in G.type_implication(signatures, absent=True).collect()}
    assert got == {("P", "Q"): (3, 3), ("P", "R"): (3, 2), ("Q", "P"): (2, 2), ("Q", "R"): (2, 2), ("R", "P"): (2, 1), ("R", "Q"): (2, 2)}
    small = "/root/testdata/sf0.001"
    types = {t for r in B.signatures(spark, small).collect() for t in r.types}
    assert QUERIES["type_implication"](spark, small).count() == len(types) * (len(types) - 1)
    assert "HAVING" not in ORACLES["type_implication"]


def test_published_family_verdict(spark):
    sizes = [674, 396, 246]
    st = spark.createDataFrame([("honoured", f, 1316 - n, n) for f, n in enumerate(sizes)], "variant string, fold long, n_train long, n_test long")
    v = A.fold_admissibility(st, ["variant"]).first()
    assert (v.K, v.n, v.L, v.U, v.test_sizes, v.folds_below_L, v.folds_above_U, v.admissible) == (3, 1316, 66, 658, [246, 396, 674], 0, 1, False)


def test_published_feasibility(spark):
    groups = spark.createDataFrame([("a", 674), ("b", 396), ("c", 246)], "label string, n long")
    grid = spark.createDataFrame([(2, 1, 2), (2, 337, 658), (3, 337, 658), (4, 1, 2), (4, 337, 658)], "k long, num long, den long")
    got = {(r.k, r.num): (r.U, r.feasible, r.blocked_by) for r in A.feasibility_map(groups, grid).collect()}
    assert got == {(2, 1): (658, False, "max_w>U"), (2, 337): (674, True, ""), (3, 337): (674, True, ""), (4, 1): (658, False, "m<K; max_w>U"), (4, 337): (674, False, "m<K")}
    assert A.min_feasible_bound(groups, spark.createDataFrame([(3,)], "k long")).first().num == 674


def one_scenario(df):
    return df.withColumns({"scenario": F.lit("release"), "action_set": F.lit(D.MARGIN)})


def test_published_utility(spark):
    outer = one_scenario(spark.createDataFrame([(0, "random", 5, 804, 416, 40), (0, "source", 5, 804, 396, 16), (0, "random", 10, 804, 416, 40), (0, "source", 10, 804, 363, 13)], "outer_fold int, protocol string, alpha int, n_test long, n_released long, n_unsafe long"))
    got = {r.alpha: r for r in P.utility_sensitivity(outer).collect()}
    assert (got[5].dA, got[5].dE, got[5].base, got[5].coeff) == (-20, -24, 4, 24)
    assert (got[10].base, got[10].coeff) == (-26, 27)
    even = {r.alpha: r.break_even for r in P.utility_break_even(P.utility_sensitivity(outer)).collect()}
    assert even[5] is None and abs(even[10] - 26 / 27) < 1e-12


def test_published_concentration(spark):
    data = [(0, 0, 0, 17, 17), (1, 9, 9, 90, 90), (2, 5, 3, 114, 115), (3, 4, 4, 136, 136), (4, 22, 0, 59, 38)]
    rows = [(f, p, 5, 160, r, u) for f, a, b, c, d in data for p, r, u in (("random", c, a), ("source", d, b))]
    outer = one_scenario(spark.createDataFrame(rows, "outer_fold int, protocol string, alpha int, n_test long, n_released long, n_unsafe long"))
    c = P.fold_concentration(outer, 5)
    assert sum(r.avoided for r in c.collect()) == 24
    top = P.largest_fold_share(c).first()
    assert top.outer_fold == 4 and abs(top.share - 22 / 24) < 1e-12
    pooled = {r.protocol: (r.n_released, r.n_unsafe) for r in D.decision_pooled(outer).collect()}
    assert pooled == {"random": (416, 40), "source": (396, 16)}


def folds(df):
    return {r.row_id: r.fold for r in df.collect()}


def test_random_folds_partition_rows(rows):
    f = folds(S.split_random_k(rows, 7))
    sizes = sorted(np.bincount(list(f.values())).tolist())
    assert len(f) == 240 and sizes == [34] * 5 + [35] * 2
    assert f == folds(S.split_random_k(rows.repartition(9), 7))


def test_honoured_folds_do_not_straddle(rows):
    a = S.split_group_k(rows, "src", 5).withColumn("variant", F.lit("v"))
    leak = S.split_leak_check(a, rows.select("row_id", F.col("src").alias("label")), ["variant"]).first()
    assert leak.straddling == 0 and a.count() == 240


def test_size_match_has_the_same_sizes(rows):
    a = S.split_group_k(rows, "src", 5)
    b = S.split_size_matched(rows, a)
    count = lambda df: {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    assert count(a) == count(b)
    assert count(S.split_shuffled_labels(rows, "src", 5)) == count(a)


@pytest.mark.parametrize("by", [None, ["key"]])
def test_packing_is_balanced_at_every_size(spark, by):
    """Many small groups and one of nearly a whole fold; alone and beside a key with few groups."""
    groups = [(1, f"g{i}", 1 + (i % 7)) for i in range(3000)] + [(1, "huge", 2000)] + ([(2, "a", 5), (2, "b", 3), (2, "c", 2)] if by else [])
    got = S.pack_groups(spark.createDataFrame(groups, "key int, label string, n long"), 5, by).collect()
    assert len(got) == len(groups)
    loads = {}
    for r in got:
        if r.label not in "abc":
            loads[r.fold] = loads.get(r.fold, 0) + r.n
    assert len(loads) == 5 and max(loads.values()) - min(loads.values()) <= 14
    assert len({r.fold for r in got if r.label in "abc"}) == (3 if by else 0)


def test_packing_goes_by_falling_size(spark):
    groups = spark.createDataFrame([("a", 674), ("b", 396), ("c", 246), ("d", 246)], "label string, n long")
    assert {r.label: r.fold for r in S.pack_groups(groups, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 1}


def test_nested_folds_exclude_the_outer_test(rows):
    outer = S.split_group_k(rows, "src", 4)
    inner = S.split_nested(rows, outer, "src", 3)
    assert inner.join(outer.withColumnRenamed("fold", "own"), "row_id").where("own = outer_fold").count() == 0
    assert inner.groupBy("outer_fold", "protocol", "row_id").count().where("count > 1").count() == 0


def test_ridge_equals_closed_form(rows):
    a = S.split_random_k(rows, 4).withColumn("variant", F.lit("v"))
    got = {r.row_id: r.p for r in L.learn_ridge(rows, a, ["x", "z"]).collect()}
    one = {r.row_id: r.p for r in L.learn_ridge1(rows, a).collect()}
    fold, data = folds(a), {r.row_id: r for r in rows.collect()}
    for cols, p in ((["x", "z"], got), (["x"], one)):
        for f in range(4):
            tr = [d for i, d in data.items() if fold[i] != f]
            x, y = np.array([[d[c] for c in cols] for d in tr]), np.array([d.y for d in tr])
            m, s = x.mean(0), x.std(0)
            w = np.linalg.solve(((x - m) / s).T @ ((x - m) / s) + np.eye(len(cols)), ((x - m) / s).T @ (y - y.mean()))
            for i, d in data.items():
                if fold[i] == f:
                    assert abs(p[i] - (y.mean() + ((np.array([d[c] for c in cols]) - m) / s) @ w)) < 1e-9


def test_components_follow_chains(spark):
    rows = spark.createDataFrame([(i, f"a{i}", f"b{i // 2}") for i in range(40)] + [(100 + i, f"a{2 * i + 1}", f"b{i + 1}") for i in range(10)], "row_id long, a string, b string")
    got = G.union_components(rows, "a", "b")
    assert G.component_concentration(got).first().components == 10


def test_components_keep_rows_with_missing_relations(spark):
    rows = spark.createDataFrame([(1, "a1", "b1"), (2, None, "b1"), (3, "a2", None), (4, None, None), (5, None, "b9"), (6, "a2", "b1")], "row_id long, a string, b string")
    assert {r.row_id: r.component for r in G.union_components(rows, "a", "b").collect()} == {1: "a1", 2: "a1", 3: "a1", 4: "row:4", 5: "b:b9", 6: "a1"}


def test_moments_are_totals_less_the_fold(rows):
    split = rows.join(S.split_random_k(rows, 4), "row_id")
    got, data = {r.fold: r for r in R.train_moments(split, "x", []).collect()}, split.collect()
    for f in range(4):
        x = np.array([r.x for r in data if r.fold != f])
        assert abs(got[f]["mean"] - x.mean()) < 1e-9 and abs(got[f].sd - x.std()) < 1e-9


def test_curve_equals_rule_by_rule(spark, rows):
    r = rows.select("row_id", (F.col("y") + 3).alias("p"), F.lit(20.0).alias("demand"), (F.col("x") > 0.5).alias("unsafe"), F.lit(0).alias("g"))
    knobs = list(range(0, 101, 20))
    curve = {x.knob: (x.n_released, x.n_unsafe) for x in D.risk_curve(r, ["g"], knobs, D.act_regression).collect()}
    for k in knobs:
        b = D.risk_block(r.withColumn("act", D.act_regression(F.lit(k))), ["g"]).first()
        assert curve[k] == (b.n_released, b.n_unsafe)


def test_policies_agree_when_no_gate_binds(spark):
    c = one_scenario(spark.createDataFrame([(0, "random", 5, "m", k, 100, 50 - k, 2, True) for k in (0, 5)], "outer_fold int, protocol string, alpha int, model string, knob int, n_test long, n_released long, n_unsafe long, feasible boolean"))
    good = one_scenario(spark.createDataFrame([(0, "random", True)], "outer_fold int, protocol string, admissible boolean"))
    assert P.policy_compare(c, good).first().same_choice
    refused = P.policy_compare(c, good.withColumn("admissible", F.lit(False))).first()
    assert refused.A_mode == "refuse" and refused.A_released == 0 and refused.G_released == 50


def test_published_category_decisions(spark):
    """Screening at a target of 5 %: what the two protocols release and get wrong, pooled over folds, and the reversal at 10 %."""
    rows = [("random", 5, 393, 193, 31), ("source", 5, 393, 164, 22), ("random", 10, 393, 193, 30), ("source", 10, 393, 197, 35)]
    outer = spark.createDataFrame([(0, *r) for r in rows], "outer_fold int, protocol string, alpha int, n_test long, n_released long, n_unsafe long").withColumns({"scenario": F.lit("category"), "action_set": F.lit(D.NOT_DESIGNATED)})
    better = {r.alpha: r.better for r in D.protocol_compare(outer).collect()}
    assert better == {5: True, 10: False}
    assert {r.alpha: (r.dA, r.dE) for r in P.utility_sensitivity(outer).collect()} == {5: (-29, -9), 10: (4, 5)}


def test_action_sets_differ_by_the_designated_category(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.9), (2, 1, 0, 0.9), (3, 0, 1, 0.5), (4, 2, 2, 1.0)], "row_id long, y int, label int, confidence double")
    both = D.with_action_sets(rows).withColumn("unsafe", D.unsafe_category(F.lit(0)))
    got = {(r.action_set, r.knob): (r.n_test, r.n_released, r.n_unsafe) for r in D.risk_curve(both, ["action_set"], [0, 60, 100], lambda k: D.act_category(k, F.lit(0))).collect()}
    assert [got[D.CONFIDENT, k] for k in (0, 60, 100)] == [(4, 4, 2), (4, 3, 1), (4, 1, 0)]
    assert [got[D.NOT_DESIGNATED, k] for k in (0, 60, 100)] == [(4, 2, 1), (4, 1, 0), (4, 1, 0)]
    chosen = spark.createDataFrame([("category", a, 0, "random", 5, True, 2, "bayes", 60, 0.1, 0.5) for a in (D.CONFIDENT, D.NOT_DESIGNATED)], "scenario string, action_set string, outer_fold int, protocol string, alpha int, released boolean, n_feasible int, model string, knob int, inner_r_all double, inner_coverage double")
    outer = rows.withColumns({"outer_fold": F.lit(0), "model": F.lit("bayes")})
    done = {r.action_set: (r.n_released, r.n_unsafe, r.target_met) for r in D.decision_outer(chosen, outer, act=lambda k: D.act_category(k, F.lit(0)), unsafe=D.unsafe_category(F.lit(0))).collect()}
    assert done == {D.CONFIDENT: (3, 1, False), D.NOT_DESIGNATED: (1, 0, True)}


def test_class_probabilities_equal_a_plain_recomputation(spark):
    """Gaussian naive Bayes of each fold's other rows; a category that training lacks is never predicted."""
    rng = np.random.default_rng(4)
    data = [(i, int(c), float(rng.normal(c, 1.0)), float(rng.normal(-c, 2.0)), i % 3) for i, c in enumerate(rng.integers(0, 3, 60))]
    data = [(i, c, a, b, f) for i, c, a, b, f in data if not (c == 2 and f != 0)]  # category 2 is in fold 0 alone
    df = spark.createDataFrame(data, "row_id long, y int, a double, b double, fold long")
    got = {(r.model, r.row_id): (r.label, r.confidence) for r in L.learn_class_probabilities(df.drop("fold"), df.select(F.lit("v").alias("variant"), "row_id", "fold"), ["a", "b"], [0, 1, 2]).collect()}
    assert len(got) == 2 * len(data)
    for i, _, a, b, f in data:
        scores, shares = {}, {}
        for c in (0, 1, 2):
            own = [r for r in data if r[4] != f and r[1] == c]
            if own:
                shares[c] = len(own) / sum(r[4] != f for r in data)
                x = np.array([r[2:4] for r in own])
                v = x.var(axis=0) + 1e-6
                scores[c] = np.log(shares[c]) - 0.5 * (np.log(v) + (np.array([a, b]) - x.mean(axis=0)) ** 2 / v).sum()
        best = max(scores, key=scores.get)
        odds = 1 / sum(np.exp(s - scores[best]) for s in scores.values())
        assert got["bayes", i][0] == best and abs(got["bayes", i][1] - odds) < 2e-6
        assert got["prior", i] == (max(shares, key=shares.get), round(max(shares.values()), 6))


def test_boosted_trees_of_all_folds_equal_folds_one_by_one(spark):
    """Two splits fitted together give what a plain recomputation of each fold gives, and better than the mean."""
    from provaudit.operators import boosting

    rng = np.random.default_rng(8)
    n = 400
    x = np.round(rng.uniform(0, 10, (n, 2)), 2)
    y = np.where(x[:, 0] > 5, 3.0, 0.0) + np.sin(x[:, 1]) + rng.normal(0, 0.1, n)
    folds = {"a": np.arange(n) % 4, "b": np.where(np.arange(n) < 100, -1, np.arange(n) // 100)}  # in b some rows are never tested
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "row_id long, y double, p double, q double").repartition(3)
    asg = spark.createDataFrame([(v, i, int(f) if f >= 0 else None) for v, fs in folds.items() for i, f in enumerate(fs)], "variant string, row_id long, fold long")
    got = {(r.variant, r.row_id): (r.fold, r.p) for r in L.learn_gbt_reg(df, asg, ["p", "q"], rounds=8).collect()}
    assert len(got) == 400 + 300
    edges = boosting.edges_of(df, ["p", "q"])
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    for v, fs in folds.items():
        for f in sorted(set(fs.tolist()) - {-1}):
            train, test = fs != f, fs == f
            p_train, p_test = np.full(train.sum(), y[train].mean()), np.full(test.sum(), y[train].mean())
            for _ in range(8):
                res, bt, be = y[train] - p_train, bins[train], bins[test]
                at, ae = np.zeros(len(bt), int), np.zeros(len(be), int)
                for _ in range(3):
                    nt, ne = 2 * at, 2 * ae
                    for node in set(at.tolist()):
                        own = at == node
                        best = (1e-12, None)
                        for j in (0, 1):
                            for c in range(32):
                                left = own & (bt[:, j] <= c)
                                right = own & ~left
                                if left.any() and right.any():
                                    gain = res[left].sum() ** 2 / left.sum() + res[right].sum() ** 2 / right.sum() - res[own].sum() ** 2 / own.sum()
                                    if gain > best[0] + 1e-9:
                                        best = (gain, (j, c))
                        if best[1]:
                            j, c = best[1]
                            nt[own] += bt[own, j] > c
                            ne[ae == node] += be[ae == node, j] > c
                    at, ae = nt, ne
                value = {leaf: 0.1 * res[at == leaf].mean() for leaf in set(at.tolist())}
                p_train = p_train + np.array([value[a] for a in at])
                p_test = p_test + np.array([value.get(a, 0.0) for a in ae])
            for i, p in zip(np.flatnonzero(test).tolist(), p_test):
                assert got[v, i][0] == f and abs(got[v, i][1] - p) < 1e-6
            assert ((y[test] - p_test) ** 2).mean() < 0.6 * ((y[test] - y[train].mean()) ** 2).mean()


def test_metrics_guard_degenerate_folds(spark):
    p = spark.createDataFrame([("v", "m", 0, 1, 2.0, 1.0), ("v", "m", 1, 2, 3.0, 3.0), ("v", "m", 1, 3, 3.0, 2.0)], "variant string, model string, fold int, row_id long, y double, p double")
    got = M.metric_fold_r2(p, ["variant", "model"]).first()
    assert got.fold_mean_r2 is None and got.n_folds == 2


def test_relations(spark):
    df = spark.createDataFrame([(1, "a", None, "1.5"), (2, None, "x", "oops"), (3, "a", "x", None)], "id long, s string, t string, n string")
    assert [r.k for r in df.orderBy("id").select(R.composite_key("s", "t").alias("k")).collect()] == ["a|nan", "nan|x", "a|x"]
    assert [r.n for r in df.withColumns(R.coerce_numeric("n")).orderBy("id").collect()] == [1.5, None, None]
    wide = R.lowcard_onehot(df, ["s"], 12)
    assert [r["s=NA"] for r in wide.orderBy("id").collect()] == [0.0, 1.0, 0.0]


def test_expectations(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "k string, v long")
    assert E.expect_equal(a, a, ["k"], ["v"], "same").first().ok
    assert not E.expect_equal(a, a.where("k = 'x'"), ["k"], ["v"], "short").first().ok
    assert E.expect_numeric_tolerance(a.where("k = 'x'"), "v", 1.01, 0.1, "near").first().ok
    assert not E.expect_numeric_tolerance(a.where("k = 'x'"), "v", 1.2, 0.1, "far").first().ok
    outer = spark.createDataFrame([(0, "random", 5, 10, 4), (1, "random", 5, 20, 6)], "outer_fold int, protocol string, alpha int, n_released long, n_unsafe long")
    for released, ok in ((30, True), (29, False)):  # the second is a planted violation
        declared = spark.createDataFrame([("random", 5, released, 10)], "protocol string, alpha int, n_released long, n_unsafe long")
        assert E.expect_pooled(outer, declared, ["protocol", "alpha"]).first().ok == ok
    pairs = spark.createDataFrame([(-0.1,), (0.2,), (None,)], "delta_vs_sizematch double")
    assert E.expect_contrast(pairs, 1, 2).first().ok and not E.expect_contrast(pairs, 2, 2).first().ok
    suite = E.expect_suite([E.expect_contrast(pairs, 1, 2), E.expect_contrast(pairs, 2, 2)])
    assert tuple(E.suite_totals(suite).first()) == (1, 1)


def test_the_suite_joins_counts_of_acts(spark, monkeypatch):
    """What the chosen rules release is a row for each fold, protocol and target where it meets other tables, not a row for each act."""
    kept = {}
    monkeypatch.setattr(queries, "written", lambda df, name, f=queries.written: kept.setdefault(name, f(df, name)))
    assert all(r.ok for r in QUERIES["expect_suite"](spark, SMALL).collect())
    folds = B.K * 2 * len(D.ALPHAS)
    assert 0 < kept["acts"].count() <= folds < kept["acts"].agg(F.sum("n")).first()[0]


def test_rows_and_folds_are_never_broadcast(spark, monkeypatch):
    """Both have a row for each row of the table, however small their files are."""
    rows = spark.range(9).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("src"))
    folds = rows.select(F.lit("v").alias("variant"), "row_id", (F.col("row_id") % 3).alias("fold"))
    labels = rows.select("row_id", F.col("src").alias("label"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (L.by_row(rows, folds), S.split_leak_check(folds, labels, ["variant"]), S.dealt_labels(rows, "src"), B.category_rec(spark, SMALL)):
        assert "SortMergeJoin [" in plan(df) and "BroadcastHashJoin [row_id" not in plan(df)
    # Folds of few groups are broadcast, never the rows; those of many are sorted.
    assert "Inner, BuildRight" in plan(S.split_group_k(rows, "src", 3)).split("BroadcastHashJoin [label", 1)[1][:60]
    monkeypatch.setattr(S, "FEW", 0)
    by_groups = S.split_group_k(rows, "src", 3)
    assert "SortMergeJoin [label" in plan(by_groups) and by_groups.count() == 9


def test_boosting_rounds_run_on_cells(spark, monkeypatch):
    """Rows whose features share their bins are counted once; copies of all rows change neither the cells nor what is predicted."""
    from provaudit.operators import boosting

    kept = {}
    monkeypatch.setattr(boosting, "written", lambda df, name, f=boosting.written: kept.setdefault(name, f(df, name)))
    got = []
    for copies in (1, 5):
        kept.clear()
        rows = spark.range(60 * copies).select(F.col("id").alias("row_id"), F.pow(F.col("id") % 60, F.lit(2.0)), F.col("id") % 6 * 1.0).toDF("row_id", "y", "x")
        folds = rows.select(F.lit("v").alias("variant"), "row_id", (F.col("row_id") % 60 % 4).alias("fold"))
        got.append({r.row_id: r.p for r in L.learn_gbt_reg(rows, folds, ["x"], rounds=3).collect()})
        assert kept["boosting-cells"].count() == 6 and len(got[-1]) == 60 * copies
    assert all(abs(got[1][i] - got[0][i % 60]) < 1e-9 for i in got[1])
    with pytest.raises(Exception, match="assigned twice"):
        L.learn_gbt_reg(rows, folds.unionByName(folds), ["x"], rounds=1)


def test_demand_sweep_groups_settings_by_quantile(spark):
    rows = spark.createDataFrame([(0.1, "random", 0.2), (0.1, "random", -0.1), (0.9, "random", 0.3)], "q double, protocol string, gap_r_all double")
    assert {r.q: (r.settings, r.above) for r in D.demand_sweep_gap(rows).collect()} == {0.1: (2, 1), 0.9: (1, 1)}


def test_unit_check_counts_disagreements(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (1.2, 2.0)], "p double, demand double")
    assert {r.knob: (r.n, r.mismatches) for r in D.unit_check(rows, [0, 50]).collect()} == {0: (2, 0), 50: (2, 0)}


def test_missing_inputs_are_noted(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/here.parquet")
    registered = spark.createDataFrame([("here",), ("absent",)], "name string")
    got = T.skip_missing_input(registered, T.present_inputs(spark, str(tmp_path)), "name").collect()
    assert {r.name: r.note for r in got} == {"here": "read", "absent": "skipped: missing"}


def test_inputs_are_tables_right_in_the_folder(spark, tmp_path):
    """A folder of parts of any names is a table; what lies deeper is not."""
    registered = spark.createDataFrame([("whole",), ("parts",), ("deeper",)], "name string")
    noted = lambda: {r.name: r.note for r in T.skip_missing_input(registered, T.present_inputs(spark, str(tmp_path)), "name").collect()}
    assert set(noted().values()) == {"skipped: missing"}
    for name in ("parts", "old/deeper"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    pq.write_table(pa.table({"id": [1]}), f"{tmp_path}/whole.parquet")
    for i, part in enumerate(sorted((tmp_path / "parts.parquet").glob("part-*"))):
        part.rename(part.with_name(f"{i}.snappy"))
    assert spark.read.parquet(f"{tmp_path}/parts.parquet").count() == 3
    assert noted() == {"whole": "read", "parts": "read", "deeper": "skipped: missing"}


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", 2, [])], "k string, n long, xs array<long>")
    T.sink_parquet(df, f"{tmp_path}/p", ["k"])
    assert T.src_parquet(spark, f"{tmp_path}/p").where("k = 'a'").count() == 1
    T.sink_table(df, f"{tmp_path}/c")
    assert T.src_csv(spark, f"{tmp_path}/c", "k string, n long, xs string").orderBy("k").first().xs == "[1,2]"
    assert T.input_fingerprint(spark, f"{tmp_path}/p").count() >= 2
