"""Exact quantiles of very large sets, also of what is left when a fold is taken out.

Values are counted in the cells of a grid between their least and largest, by fold. Counts do subtract, so the cell that holds
a rank among the rows of all other folds is found from totals less the fold: no row is sent to any fold but its own.
Only rows of the cells that hold a wanted rank go on to the next pass, each cell being a grid of its own between its least and
largest value, until every wanted cell holds one value. A pass sends `CELLS` counts a cell and partition at most, whatever
the number of distinct values; each narrows a cell, as its least and largest value never share a cell of the next grid. The
first grid is even in the logarithm, the others in the value, so six passes suffice for any doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.plans.storage import written

#: Cells of a grid.
CELLS = 4_096


def by_size(c: str) -> Column:
    """Rises with the value, an octave of either sign taking one unit: the first grid, so that values of any size part soon."""
    x = F.col(c)
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def plain(c: str) -> Column:
    return F.col(c) / 2  # so that the difference of two large values stays finite


def quantiles(rows: DataFrame, value, qs: list[float], by: list[str] | None = None, fold: str | None = None) -> DataFrame:
    """by, [fold], q, value: linearly interpolated quantiles of the finite values of each `by` group.

    With `fold` there is a row for each fold, over the rows of the group that have another fold or none. by must not be NULL.
    Groups or complements without values have no row.
    """
    by = by or []
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    base = rows.select(*by, (F.col(fold) if fold else F.lit(None).cast("int")).alias("_f"), x.alias("_x")).where("_x is not null and not isnan(_x) and abs(_x) < double('infinity')")
    # Adding zero makes one value of the two zeros.
    base = base.withColumn("_x", F.col("_x") + F.lit(0.0))
    own = written(base.groupBy(*by, "_f").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), "fold-counts")
    total = own.groupBy(*by).agg(F.sum("_n").alias("_t"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    # A fold whose values are all missing leaves all others as they are.
    folds = rows.select(*by, F.col(fold).alias("_f")).where("_f is not null").distinct() if fold else total.select(*by, F.lit(-1).alias("_f"))
    on = [*by, "_f"]
    left = (folds.join(total, by) if by else folds.crossJoin(F.broadcast(total))).join(own.select(*on, F.col("_n").alias("_own")), on, "left").withColumn("_n", F.col("_t") - F.coalesce("_own", F.lit(0))).where("_n > 0")
    place = left.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_h", F.col("q") * (F.col("_n") - 1))
    ends = F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_r")
    wanted = written(place.select(*on, "q", F.col("_h").alias("_at"), F.lit(0.0).alias("_i"), "_lo", "_hi", ends).withColumn("_r0", F.col("_r")), "ranks")
    cells = wanted.select(*by, "_i", "_lo", "_hi").distinct()
    data = base.join(F.broadcast(cells), by) if by else base.crossJoin(F.broadcast(cells))
    found, scale = None, by_size
    key = [*by, "_i"]  # a cell goes by its least value
    while True:
        width = scale("_hi") - scale("_lo")
        data = data.withColumn("_c", F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((scale("_x") - scale("_lo")) / width * CELLS))).otherwise(0).cast("int"))
        counts = written(data.groupBy(*key, "_c", "_f").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b")), "cell-counts")
        whole = counts.groupBy(*key, "_c").agg(F.sum("_n").alias("_n"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
        less = counts.select(*key, "_c", "_f", F.col("_n").alias("_own"))
        grid = wanted.select(*key, "_f").distinct().join(whole, key).join(less, [*key, "_c", "_f"], "left").withColumn("_w", F.col("_n") - F.coalesce("_own", F.lit(0)))
        grid = grid.withColumn("_end", F.sum("_w").over(Window.partitionBy(*key, "_f").orderBy("_c"))).select(*key, "_f", "_c", "_w", "_end", "_a", "_b")
        hit = wanted.drop("_lo", "_hi").join(grid, [*key, "_f"]).where("_r < _end and _r >= _end - _w")
        hit = written(hit.select(*on, "q", "_at", "_r0", (F.col("_r") - F.col("_end") + F.col("_w")).alias("_r"), F.col("_a").alias("_i"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_c", F.col("_i").alias("_up")), "ranks")
        known = hit.where("_lo = _hi").select(*on, "q", "_at", "_r0", F.col("_lo").alias("value"))
        found = known if found is None else found.unionByName(known)
        wanted = hit.where("_lo < _hi").drop("_c", "_up")
        if wanted.isEmpty():
            break
        # At most two cells for each quantile of each group and fold.
        deeper = hit.where("_lo < _hi").select(*by, F.col("_up").alias("_i"), "_c", F.col("_i").alias("_j"), F.col("_lo").alias("_l"), F.col("_hi").alias("_h")).distinct()
        data = data.join(F.broadcast(deeper), [*key, "_c"]).select(*by, "_f", "_x", F.col("_j").alias("_i"), F.col("_l").alias("_lo"), F.col("_h").alias("_hi"))
        scale = plain
    both = found.groupBy(*on, "q", "_at").agg(F.min_by("value", "_r0").alias("_a"), F.max_by("value", "_r0").alias("_b"))
    share = F.col("_at") - F.floor("_at")
    out = both.withColumn("value", F.col("_a") + (F.col("_b") - F.col("_a")) * share)
    return out.select(*by, *([F.col("_f").alias(fold)] if fold else []), "q", "value")
