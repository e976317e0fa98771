"""Exact dealing of groups and exact quantiles against plain recomputations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provaudit.functions import components as C
from provaudit.functions import dealing
from provaudit.functions import order_statistics as O
from provaudit.operators import admissibility as A
from provaudit.operators import expect as E
from provaudit.operators import graph as G
from provaudit.operators import relations as R
from provaudit.sources import tables as T


def brute(sizes, k, low):
    """Least largest fold over all ways to deal the groups, by the loads that can be reached."""
    loads = {(0,) * k}
    for n in sizes:
        loads = {tuple(sorted(v[:f] + (v[f] + n,) + v[f + 1 :])) for v in loads for f in range(k)}
    fit = [v[-1] for v in loads if v[0] >= max(1, low)]
    return min(fit) if fit else None


@pytest.mark.parametrize("seed", range(200))
def test_least_largest_fold_equals_all_deals(seed):
    rng = random.Random(seed)
    k = rng.randint(1, 4)
    sizes = [rng.choice([rng.randint(1, 9), 3, 7, rng.randint(20, 40)]) for _ in range(rng.randint(1, 9))]
    low = rng.choice([1, -(-sum(sizes) // 20), sum(sizes) // (2 * k) + 1])
    folds, proven = dealing.least_largest(sizes, k, low)
    want = brute(sizes, k, low)
    assert proven and (max(map(sum, folds)) if folds else None) == want
    if folds:
        assert len(folds) == k and sorted(itertools.chain(*folds)) == sorted(sizes) and min(map(sum, folds)) >= low


def test_bound_of_three_equal_groups_is_two_of_them(spark):
    groups = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "label string, n long")
    got = A.min_feasible_bound(groups, spark.createDataFrame([(2,), (3,), (4,)], "k long")).collect()
    assert {r.k: (r.num, r.den, r.proven) for r in got} == {2: (6, 9, True), 3: (3, 9, True), 4: (None, 9, True)}
    assert {tuple(x) for r in got if r.k == 2 for x in r.certificate} == {(0, 3, 2), (1, 3, 1)}


def test_many_groups_are_dealt_at_once(spark):
    groups = spark.range(20_000).select(F.col("id").alias("label"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("n"))
    r = A.min_feasible_bound(groups, spark.createDataFrame([(5,)], "k long")).first()
    assert r.proven and r.num == -(-r.den // 5)


def plain(values, q):
    return float(np.quantile(values, q)) if len(values) else None


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one"])
def test_quantiles_of_groups_and_fold_complements(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 3_000
    x = {"normal": rng.standard_normal(n), "ties": rng.integers(0, 4, n).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), "one": np.full(n, 2.5)}[kind]
    rows = [(int(g), int(f) if f < 4 else None, None if i % 11 == 0 else float(v)) for i, (g, f, v) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 5, n), x))]
    rows += [(0, 1, float("nan")), (1, 2, float("inf")), (9, 0, None), (8, 0, 1.0), (7, 0, 1.0), (7, 1, None)]
    df = spark.createDataFrame(rows, "g int, f int, x double")
    fit = [(g, f, v) for g, f, v in rows if v is not None and np.isfinite(v)]
    got = {(r.g, r.q): r.value for r in O.quantiles(df, "x", [0.0, 0.3, 0.5, 1.0], ["g"]).collect()}
    want = {(g, q): plain([v for a, _, v in fit if a == g], q) for g in {a for a, _, _ in fit} for q in (0.0, 0.3, 0.5, 1.0)}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)
    got = {(r.g, r.f): r.value for r in O.quantiles(df, "x", [0.5], ["g"], "f").collect()}
    want = {(g, f): plain([v for a, b, v in fit if a == g and b != f], 0.5) for g, f in {(a, b) for a, b, _ in rows if b is not None}}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(100_001).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 2).alias("f"))
    assert O.quantiles(df, "x", [0.25, 0.5]).orderBy("q").collect() == [(0.25, 12500.0), (0.5, 25000.0)]
    assert {r.f: r.value for r in O.quantiles(df, "x", [0.5], fold="f").collect()} == {0: 25000.0, 1: 25000.0}
    assert O.quantiles(df.where("false"), "x", [0.5]).count() == 0 and O.quantiles(df.where("false"), "x", [0.5], ["f"]).count() == 0


def test_few_values_of_many_columns(spark):
    cols = [f"c{i}" for i in range(200)]
    df = spark.range(500, numPartitions=4).select(*[(F.when(F.col("id") % (i + 2) != 0, F.col("id") % (i + 1))).cast("string").alias(c) for i, c in enumerate(cols)])
    got = R.few_values(df, cols, 12)
    for i, c in enumerate(cols):
        own = sorted({str(k % (i + 1)) for k in range(500) if k % (i + 2)})
        assert got[c] == (own if len(own) <= 12 else None)
    assert "Expand" not in R.lowcard_onehot(df, cols)._jdf.queryExecution().toString()


@pytest.mark.parametrize("last", [3, 200_000])
def test_components_of_chains_cycles_and_stars(spark, last):
    rng = random.Random(5)
    names = [f"n{i:04d}" for i in range(900)]
    rng.shuffle(names)
    links = list(zip(names[:300], names[1:300])) + [(names[400], n) for n in names[401:600]] + list(zip(names[600:700], names[601:700] + names[600:601])) + [(names[800], names[800])]
    rng.shuffle(links)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    df = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in links], "a string, b string").repartition(7)
    found, _ = C.components(df, last)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted(tuple(r) for r in found.collect()) == sorted((n, find(n)) for n in linked)
    assert C.components(df.where("false"), last)[0].count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n - 1, numPartitions=8).select(F.format_string("%06d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("a"), F.format_string("%06d", F.pmod((F.col("id") + 1) * 7919, F.lit(n))).alias("b")).repartition(8)
    found, rounds = C.components(chain, last=1_000)
    assert rounds <= 20 and found.agg(F.countDistinct("root"), F.count("node")).first() == (1, n)


def test_implications_of_very_many_types(spark):
    pairs = spark.range(50_000).select(F.concat(F.lit("c"), F.floor(F.col("id") / 2).cast("string")).alias("campaign"), F.format_string("t%05d", F.col("id")).alias("kind"))
    got = G.type_implication(G.type_signature(pairs, "campaign", "kind"))
    assert got.count() == 50_000 and got.where("support <> 1 or violations <> 0").isEmpty()
    few = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "x"), ("d", "y"), ("d", "x")], "campaign string, kind string")
    assert {tuple(r) for r in G.type_implication(G.type_signature(few, "campaign", "kind"), least=2).collect()} == {("x", "y", 4, 2), ("y", "x", 2, 0)}


def test_types_are_inferred_from_all_rows(spark, tmp_path):
    lines = ["n,x,t,flag,word,none,late"] + [f"{i},{i / 4},2024-01-{i % 28 + 1:02d} 00:00:00,{'true' if i % 2 else 'false'},w{i},,{i}" for i in range(500)] + ["500,1e300,,,,,last"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    df = T.src_csv(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "timestamp", "boolean", "string", "string", "string"]
    assert df.count() == 501 and df.where("n = 500 and x = 1e300 and word is null").count() == 1


def test_spec_names_target_relation_and_features(spark, tmp_path):
    lines = ["id,maker,grade,lot,x,leak,strength"] + [f"{i},m{i % 4},{'ab'[i % 2]},lot{i},{i % 5},{i},{'' if i % 7 == 0 else 'bad' if i % 7 == 1 else i}" for i in range(70)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    df = T.src_spec(spark, T.Spec(str(tmp_path / "t.csv"), T.LAST, "maker", T.MIX, ["id", "leak"]))
    assert df.columns == ["row_id", "y", "relation", "proxy", "x", "grade=a", "grade=b", "grade=NA"] and df.count() == 50
    r = df.where("y = 2").first()
    assert (r.relation, r.x, r["grade=a"], r.proxy) == ("m2", 2.0, 1.0, "2|m2|a|lot2|2|2")
    plain_ = T.src_spec(spark, T.Spec(str(tmp_path / "t.csv"), "x", proxy="grade", drop=["id", "leak", "strength"]))
    assert plain_.columns == ["row_id", "y", "relation", "proxy", "maker=m0", "maker=m1", "maker=m2", "maker=m3", "maker=NA"] and plain_.where("relation is null").count() == 70


def test_fingerprints_are_read_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    files = {"a b.bin": b"abc", "c%d.bin": bytes(range(256)) * 300, "e.bin": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(T, "CHUNK", 1_000)
    got = {r.sha256: r.length for r in T.input_fingerprint(spark, str(tmp_path)).collect()}
    assert got == {hashlib.sha256(c).hexdigest(): len(c) for c in files.values()}


def test_declared_values_report_each_difference(spark):
    declared = spark.createDataFrame([(1, "n", "old", 1.0, 0.0), (2, "n", "a", 5.0, 0.0), (2, "n", None, 2.0, 0.5), (2, "n", "gone", 1.0, 0.0), (2, "r2", "a", 0.5, 0.01)], "version int, check string, key string, expected double, tolerance double")
    good = [("n", "a", 5.0), ("n", None, 2.4), ("n", "gone", 1.0), ("r2", "a", 0.505)]
    schema = "check string, key string, value double"
    assert {r.status for r in E.expect_declared(spark.createDataFrame(good, schema), declared).collect()} == {"holds"}
    for i, (check, key, value) in enumerate(good):  # a planted violation in each
        rows = [*good[:i], (check, key, value + 1), *good[i + 1 :]]
        got = {(r.check, r.key): r.status for r in E.expect_declared(spark.createDataFrame(rows, schema), declared).collect()}
        assert got.pop((check, key)) == "differs" and set(got.values()) == {"holds"}
    got = {(r.check, r.key): r.status for r in E.expect_declared(spark.createDataFrame([("n", "a", None), ("x", "new", 1.0)], schema), declared).collect()}
    assert got == {("n", "a"): "missing", ("n", None): "missing", ("n", "gone"): "missing", ("r2", "a"): "missing", ("x", "new"): "undeclared"}
