"""Split assignments (row_id, fold) and what can be read from them.

An assignment names each row's test fold; a fold's training rows are all other rows of the table. Rows without a
fold are never tested. Folds are numbered from 0.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.functions.ranks import fold_of_rank, hash_rank, row_hash
from provaudit.plans.storage import written

#: Share of a fold above which a group is packed on its own.
EPSILON = 0.05
#: Stretches of ranks in which cuts are looked up.
STRETCHES = 4_096
#: Groups up to which their folds are broadcast to the rows; otherwise rows and groups are sorted, and neither is broadcast.
FEW = 50_000


def split_random_k(rows: DataFrame, k: int = 5, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Shuffled folds of equal size, the first n mod k one row larger."""
    by = by or []
    ranked = hash_rank(rows.select(*by, "row_id"), "row_id", seed, by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, by) if by else ranked.crossJoin(sizes)
    return ranked.select(*by, "row_id", fold_of_rank(F.col("rank"), F.col("_n"), k).alias("fold"))


def greedy(sizes: pd.DataFrame, k: int) -> list[int]:
    """Folds of groups in the given order, each to the lightest fold so far."""
    heap = [(0, f) for f in range(k)]
    out = []
    for n in sizes["n"].tolist():
        load, f = heapq.heappop(heap)
        out.append(f)
        heapq.heappush(heap, (load + n, f))
    return out


def pack_groups(groups: DataFrame, k: int, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Fold of every (by, label, n), packed from group counts, never from rows, in one way at every size.

    Groups above EPSILON * n / k, at most k / EPSILON of each `by` key, go one by one to the lightest fold, the largest first,
    ties by label. The others are laid in the order of a hash into the room that is left, as prefix sums of their
    sizes, which leaves every fold within one such group of balance. All comparisons are of whole numbers.
    """
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*by, "label"]] + ["_all int", "n long", "fold long"])
    key = [*by, "_all"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "label"], ascending=[False, True], kind="stable")
        return part.assign(fold=greedy(part, k))[[*by, "label", "_all", "n", "fold"]]

    groups = groups.withColumn("_all", F.lit(0))
    totals = groups.groupBy(*key).agg(F.sum("n").alias("_t"))  # one row for each `by` key
    sized = groups.join(totals, key)
    large = F.col("n") * k * round(1 / EPSILON) > F.col("_t")
    heavy = written(sized.where(large).groupBy(*key).applyInPandas(lambda part: run(part), schema), "heavy")
    loads = heavy.groupBy(*key).agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"_l{f}") for f in range(k)])
    load = [F.coalesce(F.col(f"_l{f}"), F.lit(0)) for f in range(k)]
    room = [F.greatest(F.lit(0), F.col("_t") - k * x) for x in load]  # times k, so that it is whole
    cuts = [sum(room[1 : f + 1], room[0]).alias(f"_c{f}") for f in range(k)]
    plan = totals.join(loads, key, "left").select(*key, (F.col("_t") - sum(load[1:], load[0])).alias("_tail"), *cuts)
    tail = sized.where(~large).withColumn("_h", row_hash(seed, "label")).withColumn("_b", F.substring("_h", 1, 3))
    sizes = tail.groupBy(*key, "_b").agg(F.sum("n").alias("_n"))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*key, "_b", earlier("_n", Window.partitionBy(*key).orderBy("_b")).alias("_o"))
    at = F.col("_o") + earlier("n", Window.partitionBy(*key, "_b").orderBy("_h", "label"))
    placed = tail.join(offsets, [*key, "_b"]).withColumn("_at", at)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    fold = sum([(whole("_at") * whole(f"_c{k - 1}") >= whole("_tail") * whole(f"_c{f}")).cast("long") for f in range(k - 1)], F.lit(0).cast("long"))
    placed = placed.join(plan, key).select(*by, "label", "n", fold.alias("fold"))
    return heavy.select(*by, "label", "n", "fold").unionByName(placed)


def split_group_k(rows: DataFrame, label: str, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """No label is both tested and trained on in a fold; folds as even as `pack_groups` makes them.

    Without `by`, k shrinks to the number of groups where there are fewer.
    """
    by = by or []
    groups = written(rows.groupBy(*by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")), "groups")
    n = groups.count()
    packed = pack_groups(groups, k if by else max(1, min(k, n)), by).select(*by, "label", "fold")
    packed = F.broadcast(packed) if n <= FEW else packed.hint("merge")
    return rows.select(*by, "row_id", F.col(label).alias("label")).join(packed, [*by, "label"]).select(*by, "row_id", "fold")


def min_groups_guard(rows: DataFrame, relations: list[str], least: int = 3) -> DataFrame:
    """Which relations have enough groups for an honoured split.

    (relation, group) pairs are made distinct within partitions first; no row is repeated for distinct counts of several columns.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("relation"), F.col(c).cast("string").alias("group")) for c in relations])).alias("x")
    found = rows.select(*relations).distinct().select(pairs).select("x.*").where("group is not null").distinct()
    counts = found.groupBy("relation").agg(F.count(F.lit(1)).alias("groups"))
    named = rows.sparkSession.createDataFrame([(c,) for c in relations], "relation string")
    n = F.coalesce("groups", F.lit(0).cast("long"))
    return named.join(counts, "relation", "left").select("relation", n.alias("groups"), (n >= least).alias("usable"))


def split_size_matched(rows: DataFrame, honoured: DataFrame, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """Random folds of exactly the honoured fold sizes: one permutation cut at their cumulative sums.

    by: columns of `honoured` that tell several assignments apart; all of them cut the same permutation. An assignment has few
    folds, each of which has models of its own, so its cuts are made in one task. The honoured table is read once.
    """
    by = by or []
    sizes = written(honoured.where("fold is not null").groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n")), "fold-sizes")
    w = Window.partitionBy(*by).orderBy("fold")
    cuts = sizes.select(*by, "fold", (F.sum("n").over(w) - F.col("n")).alias("lo"), F.sum("n").over(w).alias("hi"))
    # Ranks meet cuts through stretches of ranks, an equi-join: a cut goes to the stretches that it reaches into.
    step = max(1, (cuts.agg(F.max("hi")).first()[0] or 0) // STRETCHES)
    reach = F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("stretch")
    ranked = hash_rank(rows.select("row_id"), "row_id", seed).withColumn("stretch", F.floor(F.col("rank") / step))
    return ranked.join(cuts.select(*by, "fold", "lo", "hi", reach), "stretch").where("rank >= lo and rank < hi").select(*by, "row_id", "fold")


def dealt_labels(rows: DataFrame, label: str, seed: int = 2) -> DataFrame:
    """(row_id, label): every label dealt to another row by two permutations."""
    labels = hash_rank(rows.select("row_id", F.col(label).alias("label")), "row_id", seed, out="r").select("r", "label")
    places = hash_rank(rows.select("row_id"), "row_id", seed + 1, out="r").select("r", "row_id")
    return places.join(labels.hint("merge"), "r").select("row_id", "label")  # a row for each row on both sides


def split_shuffled_labels(rows: DataFrame, label: str, k: int = 5, seed: int = 2) -> DataFrame:
    """Negative control: labels dealt to other rows (same sizes), then an honoured split of the dealt labels."""
    return split_group_k(dealt_labels(rows, label, seed), "label", k)


def split_family_holdout(rows: DataFrame, family: str) -> DataFrame:
    """Each family but the largest is tested once; the largest always trains. A family is a fold, so their order is taken in one task."""
    sizes = rows.groupBy(F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    ranked = sizes.select("family", (F.row_number().over(Window.orderBy(F.desc("n"), "family")) - 2).alias("fold"))
    return rows.select("row_id", F.col(family).alias("family")).join(ranked.where("fold >= 0"), "family").select("row_id", "fold")


def split_family_holdout_sizematch(rows: DataFrame, holdout: DataFrame, seed: int = 3) -> DataFrame:
    return split_size_matched(rows, holdout, seed)


def split_nested(rows: DataFrame, outer: DataFrame, source: str, k: int = 4, seed: int = 4) -> DataFrame:
    """Inner folds inside each outer training set, by both protocols: outer_fold, protocol, row_id, fold."""
    base = rows.select("row_id", F.col(source).alias("source")).join(outer.withColumnRenamed("fold", "own").hint("merge"), "row_id", "left")
    folds = outer.select(F.col("fold").alias("outer_fold")).distinct()
    train = base.crossJoin(F.broadcast(folds)).where(F.col("own").isNull() | (F.col("own") != F.col("outer_fold"))).select("outer_fold", "row_id", "source")
    random = split_random_k(train, k, seed, ["outer_fold"]).withColumn("protocol", F.lit("random"))
    grouped = split_group_k(train, "source", k, ["outer_fold"]).withColumn("protocol", F.lit("source"))
    return random.unionByName(grouped).select("outer_fold", "protocol", "row_id", "fold")


def fold_structure(assignment: DataFrame, n_rows: DataFrame, by: list[str]) -> DataFrame:
    """Test and training rows of each fold. n_rows: (by, n) of the whole table."""
    tests = assignment.where("fold is not null").groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n_test"))
    return tests.join(n_rows, by).select(*by, "fold", (F.col("n") - F.col("n_test")).alias("n_train"), "n_test", ((F.col("n") - F.col("n_test")) / F.col("n")).alias("train_fraction"))


def split_coverage(assignment: DataFrame, n_rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows that are ever tested, as a number and a share."""
    got = assignment.where("fold is not null").groupBy(*by).agg(F.countDistinct("row_id").alias("covered"))
    return got.join(n_rows, by).select(*by, "covered", "n", (F.col("covered") / F.col("n")).alias("coverage"))


def split_leak_check(assignment: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Labels that straddle folds. labels: (row_id, label)."""
    spread = assignment.join(labels.hint("merge"), "row_id").groupBy(*by, "label").agg(F.countDistinct(F.coalesce("fold", F.lit(-1))).alias("folds"))
    return spread.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("folds") > 1).alias("straddling"))


def groups_per_fold(assignment: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    return assignment.join(labels, "row_id").groupBy(*by, "fold").agg(F.countDistinct("label").alias("groups"))


def split_alias(assignment: DataFrame, by: str = "variant") -> DataFrame:
    """Pairs of variants with the same test sets, whatever the folds are called."""
    first = assignment.groupBy(by, "fold").agg(F.min("row_id").alias("name"))
    named = assignment.join(first, [by, "fold"])
    marks = named.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row_id", "name").cast("decimal(38,0)")).alias("mark"))
    a, b = marks.alias("a"), marks.alias("b")
    return a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.mark") == F.col("b.mark")) & (F.col(f"a.{by}") < F.col(f"b.{by}"))).select(F.col(f"a.{by}").alias("variant"), F.col(f"b.{by}").alias("alias"))
