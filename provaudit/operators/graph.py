"""Joint claims over two relations: components of rows that share any value, and the structures they allow."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.functions.components import components
from provaudit.plans.storage import written

#: Type levels up to which all structures are listed (their number grows as Bell numbers do).
MOST_LEVELS = 8


def union_components(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with component: rows connected through equal values of either relation; named by the smallest value of a.

    NULL links nothing: a row without a belongs to the component of its b, or to one named after that b if no row with
    an a has it; a row without either is a component of its own, named by its row_id. Works on distinct pairs of values, not rows.
    """
    values = written(rows.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct(), "pairs")
    # Values of a sort before those of b, so the smallest node of a component is its smallest a.
    links = values.where("a is not null and b is not null").select(F.concat(F.lit("0"), "a").alias("a"), F.concat(F.lit("1"), "b").alias("b"))
    roots = written(components(links)[0].select("node", F.substr("root", F.lit(2)).alias("root")), "roots")
    out = rows.withColumns({"_a": F.col(a).cast("string"), "_b": F.col(b).cast("string")})
    out = out.join(roots.select(F.col("node").alias("_kb"), F.col("root").alias("_of_b")), F.concat(F.lit("1"), "_b") == F.col("_kb"), "left")
    out = out.join(roots.select(F.col("node").alias("_ka"), F.col("root").alias("_of_a")), F.concat(F.lit("0"), "_a") == F.col("_ka"), "left")
    alone = F.when(F.col("_b").isNotNull(), F.concat(F.lit("b:"), "_b")).otherwise(F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    return out.withColumn("component", F.coalesce("_of_a", "_a", "_of_b", alone)).drop("_a", "_b", "_ka", "_kb", "_of_a", "_of_b")


def component_concentration(members: DataFrame) -> DataFrame:
    """Number of components, and size and share of the largest."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))


def incidence_matrix(rows: DataFrame, campaign: str, kind: str, kinds: list[str]) -> DataFrame:
    """Records of each campaign by type, with totals; types are given, so no extra pass finds them."""
    out = rows.groupBy(campaign).pivot(kind, kinds).agg(F.count(F.lit(1))).fillna(0)
    return out.withColumn("total", sum((F.col(f"`{k}`") for k in kinds[1:]), F.col(f"`{kinds[0]}`")))


def type_signature(rows: DataFrame, campaign: str, kind: str) -> DataFrame:
    """campaign, types (sorted), n, by_type: records of each type."""
    cells = rows.groupBy(F.col(campaign).alias("campaign"), F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("k"))
    return cells.groupBy("campaign").agg(F.sort_array(F.collect_list("type")).alias("types"), F.sum("k").alias("n"), F.sort_array(F.collect_list(F.struct("type", "k"))).alias("by_type"))


def signature_counts(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("types").agg(F.count(F.lit(1)).alias("campaigns"), F.sum("n").alias("records"))


def single_vs_bridging(signatures: DataFrame) -> DataFrame:
    """For each type, campaigns that carry it alone and with others."""
    one = F.size("types") == 1
    return signatures.select(F.explode("types").alias("type"), one.alias("one")).groupBy("type").agg(F.count_if("one").alias("single"), F.count_if(~F.col("one")).alias("bridging"))


def type_implication(signatures: DataFrame, least: int = 1, absent: bool = False) -> DataFrame:
    """For each ordered pair of types that some campaign has together: campaigns with the first, and those among them without the second.

    Only pairs that occur are counted; of any other pair every campaign with the first is without the second, and `absent` lists these
    too, so that all ordered pairs are there. Types of fewer than `least` campaigns are left out before they are paired, so a campaign
    with very many rare types makes few pairs.
    """
    has = signatures.groupBy("types").agg(F.count(F.lit(1)).alias("c"))
    support = written(has.select(F.explode("types").alias("t"), "c").groupBy("t").agg(F.sum("c").alias("support")).where(F.col("support") >= least), "type-support")
    # A signature's number stands for its types while they are thinned out.
    each = has.withColumn("s", F.xxhash64("types", F.concat_ws("\u0001", "types"))).select("s", "c", F.explode("types").alias("t")).join(support.select("t"), "t", "left_semi")
    thin = each.groupBy("s", "c").agg(F.collect_list("t").alias("ts"))
    together = thin.select("c", "ts", F.explode("ts").alias("t")).select("c", "t", F.explode("ts").alias("u")).where("t <> u").groupBy("t", "u").agg(F.sum("c").alias("both"))
    if absent:
        every = support.crossJoin(support.select(F.col("t").alias("u"))).where("t <> u")
        return every.join(together, ["t", "u"], "left").select("t", "u", "support", (F.col("support") - F.coalesce("both", F.lit(0))).alias("violations"))
    return together.join(support, "t").select("t", "u", "support", (F.col("support") - F.col("both")).alias("violations"))


def partitions(items: list) -> list[list[list]]:
    """All set partitions of a list."""
    if not items:
        return [[]]
    out = []
    for p in partitions(items[1:]):
        out.append([[items[0]], *p])
        out += [[*p[:i], [items[0], *p[i]], *p[i + 1 :]] for i in range(len(p))]
    return out


def structure_candidates(spark, kinds: list[str]) -> DataFrame:
    """structure, clusters: every partition of every non-empty subset of the type levels."""
    if len(kinds) > MOST_LEVELS:
        raise ValueError(f"at most {MOST_LEVELS} type levels")
    found = [sorted(sorted(c) for c in p) for r in range(1, len(kinds) + 1) for kept in combinations(sorted(kinds), r) for p in partitions(list(kept))]
    rows = [("/".join("+".join(c) for c in p), p) for p in sorted(found)]
    return spark.createDataFrame(rows, "structure string, clusters array<array<string>>")


def structure_eval(signatures: DataFrame, structures: DataFrame) -> DataFrame:
    """structure, types, c, n, cluster: where each distinct signature falls; NULL if no single cluster holds its kept types."""
    distinct = signatures.groupBy("types").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    s = structures.withColumn("kept", F.flatten("clusters"))
    rows = distinct.crossJoin(F.broadcast(s)).withColumn("held", F.array_intersect("types", "kept"))
    inside = F.filter("clusters", lambda c: (F.size("held") > 0) & (F.size(F.array_except("held", c)) == 0))
    return rows.select("structure", "types", "c", "n", F.when(F.size(inside) == 1, F.array_join(inside[0], "+")).alias("cluster"))


def fold_ceiling(evaluated: DataFrame) -> DataFrame:
    """The most non-empty clusters of any structure, and the first structure that has them."""
    per = evaluated.groupBy("structure").agg(F.countDistinct("cluster").alias("clusters"))
    best = per.agg(F.min(F.struct((-F.col("clusters")).alias("minus"), "structure")).alias("b"))
    return best.select((-F.col("b.minus")).alias("folds"), F.col("b.structure").alias("structure"))


def closed_campaigns(signatures: DataFrame, structures: DataFrame) -> DataFrame:
    """structure, cluster, campaign, n for campaigns whose kept types lie in one cluster; n counts records of its types."""
    e = structure_eval(signatures, structures).where("cluster is not null").select("structure", "types", "cluster")
    inside = F.filter("by_type", lambda x: F.array_contains(F.split("cluster", r"\+"), x["type"]))
    size = F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x["k"])
    return e.join(signatures, "types").select("structure", "cluster", "campaign", size.alias("n"))


def groupings(spark, most: int, ks: list[int]) -> DataFrame:
    """m, k, places: every way to deal m clusters into k folds, as the fold of each cluster; folds are numbered as they first occur."""
    rows = []
    for m in range(1, most + 1):
        for p in partitions(list(range(m))):
            if len(p) in ks:
                names: dict[int, int] = {}
                rows.append((m, len(p), [names.setdefault(next(f for f, part in enumerate(p) if i in part), len(names)) for i in range(m)]))
    return spark.createDataFrame(rows, "m int, k int, places array<int>")


def removals(members: DataFrame) -> DataFrame:
    """structure, step, cluster, campaign, n: campaigns in the order in which shrinking removes them.

    Each step removes the smallest campaign of the cluster that is largest just then (never a cluster's last). The sizes a
    cluster has before each removal are suffix sums over its campaigns in order; ordering all removals of a structure
    by that size, largest first, gives the steps.
    """
    in_order = Window.partitionBy("structure", "cluster").orderBy("n", "campaign")
    steps = members.withColumn("i", F.row_number().over(in_order)).withColumn("size", F.sum("n").over(in_order.rowsBetween(0, Window.unboundedFollowing)))
    steps = steps.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("structure", "cluster"))).where("i < m")
    turn = Window.partitionBy("structure").orderBy(F.desc("size"), "cluster", "i")
    return steps.withColumn("step", F.row_number().over(turn)).select("structure", "step", "cluster", "campaign", "n")


def discard_select(signatures: DataFrame, structures: DataFrame, ks: list[int], lower_pct: int = 5, upper_pct: int = 50) -> DataFrame:
    """For each K, the structure that keeps most rows when its largest cluster is shrunk until its clusters, dealt into K
    folds, fit the bounds: k, structure, step, retained, sizes, clusters (sorted) and places, the fold of each.

    Sizes after each step are prefix sums over the removals of a cluster.
    """
    members = closed_campaigns(signatures, structures)
    count = members.groupBy("structure", "cluster").agg(F.sum("n").alias("whole"))
    moves = removals(members)
    grid = moves.select("structure", "step").union(count.select("structure", F.lit(0).alias("step")).distinct())
    state = grid.join(count, "structure").join(moves.select("structure", "step", "cluster", F.col("n").alias("rn")), ["structure", "step", "cluster"], "left")
    gone = F.sum(F.coalesce("rn", F.lit(0))).over(Window.partitionBy("structure", "cluster").orderBy("step"))
    now = state.withColumn("size", F.col("whole") - gone)
    parts = F.sort_array(F.collect_list(F.struct("cluster", "size")))
    clusters = now.groupBy("structure", "step").agg(F.count(F.lit(1)).cast("int").alias("m"), F.sum("size").alias("retained"), F.transform(parts, lambda x: x["size"]).alias("parts"), F.transform(parts, lambda x: x["cluster"]).alias("clusters"))
    ways = clusters.join(F.broadcast(groupings(signatures.sparkSession, MOST_LEVELS, ks)), "m")
    load = lambda f: F.aggregate(F.zip_with("parts", "places", lambda n, p: F.when(p == f, n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    folds = ways.withColumn("sizes", F.sort_array(F.transform(F.sequence(F.lit(0), F.col("k") - 1), load), asc=False))
    low = F.floor((F.col("retained") * lower_pct + 99) / 100)
    high = F.floor(F.col("retained") * upper_pct / 100)
    fits = folds.where((F.array_min("sizes") >= low) & (F.array_max("sizes") <= high))
    first = fits.withColumn("f", F.row_number().over(Window.partitionBy("structure", "k").orderBy("step", "places"))).where("f = 1")
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("retained"), "structure"))).where("r = 1")
    return best.select("k", "structure", "step", "retained", "sizes", "clusters", "places")


def kept_campaigns(signatures: DataFrame, structures: DataFrame, selection: DataFrame) -> DataFrame:
    """k, campaign, cluster, fold of the campaigns that each selection keeps."""
    members = closed_campaigns(signatures, structures.join(selection.select("structure").distinct(), "structure", "left_semi"))
    gone = removals(members).select("structure", "campaign", "step")
    rows = members.join(selection.withColumnRenamed("step", "last"), "structure").join(gone, ["structure", "campaign"], "left").where("step is null or step > last")
    return rows.select("k", "campaign", "cluster", F.element_at("places", F.array_position("clusters", F.col("cluster")).cast("int")).cast("long").alias("fold"))


def quarantine_list(signatures: DataFrame, kept: DataFrame) -> DataFrame:
    """Campaigns that a selection leaves out, with records and types."""
    return signatures.join(kept.select("campaign").distinct(), "campaign", "left_anti").select("campaign", F.col("n").alias("records"), "types")


def closure_verify(rows: DataFrame, folds: DataFrame, relations: list[str], by: list[str] | None = None) -> DataFrame:
    """Of each relation, how many values straddle folds. rows: (by, row_id, relations); folds: (by, row_id, fold).

    Values and their folds are made distinct once for all relations.
    """
    by = by or []
    joined = rows.join(folds, [*by, "row_id"])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), F.col(r).cast("string").alias("v")) for r in relations])).alias("x")
    spread = joined.select(*by, "fold", pairs).select(*by, "fold", "x.*").groupBy(*by, "relation", "v").agg(F.countDistinct("fold").alias("_k"))
    return spread.groupBy(*by, "relation").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.col("_k") > 1).alias("straddling"))
