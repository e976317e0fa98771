"""Expectation suite: every check is one row (name, ok, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    """One row from an aggregate over df."""
    return df.agg(F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail")).select(F.lit(name).alias("name"), "ok", "detail")


def expect_suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def suite_totals(suite: DataFrame) -> DataFrame:
    return suite.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def expect_equal(got: DataFrame, expected: DataFrame, on: list[str], columns: list[str], name: str) -> DataFrame:
    """Rows of an aggregate equal declared rows, NULLs included."""
    e = expected.select(*on, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_e"))
    g = got.select(*on, *columns, F.lit(True).alias("_g"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    rows = g.join(e, on, "full").withColumn("same", F.coalesce(F.col("_e") & F.col("_g") & same, F.lit(False)))
    return check(rows, name, F.bool_and("same"), F.concat_ws("/", F.count_if("same").cast("string"), F.count(F.lit(1)).cast("string")))


def expect_pooled(outer: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    sums = outer.groupBy(*by).agg(F.sum("n_released").alias("n_released"), F.sum("n_unsafe").alias("n_unsafe"))
    return expect_equal(sums, expected, by, ["n_released", "n_unsafe"], "pooled")


def expect_concentration(concentration: DataFrame, expected: DataFrame) -> DataFrame:
    return expect_equal(concentration, expected, ["outer_fold"], ["random", "source", "avoided"], "concentration")


def expect_utility(sensitivity: DataFrame, expected: DataFrame) -> DataFrame:
    return expect_equal(sensitivity, expected, ["alpha"], ["dA", "dE"], "utility")


def expect_registry(registry: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    return expect_equal(registry, expected, on, [c for c in expected.columns if c not in on], "registry")


def expect_contrast(pairs: DataFrame, degrading: int, of: int) -> DataFrame:
    got = F.count_if(F.col("delta_vs_sizematch") < 0)
    return check(pairs, "contrast", (got == degrading) & (F.count("delta_vs_sizematch") == of), got)


def expect_numeric_tolerance(df: DataFrame, column: str, declared: float, tolerance: float, name: str) -> DataFrame:
    """The single value of a one-row table lies near the declared one."""
    return check(df, name, F.abs(F.max(column) - F.lit(declared)) < tolerance, F.max(column))


def expect_table_text_rules(df: DataFrame, numbers: list[str], label: str, allowed: list[str]) -> DataFrame:
    """No NaN in the numbers, and exactly the allowed labels."""
    nan = reduce(lambda a, b: a + b, [F.count_if(F.isnan(c)) for c in numbers])
    levels = F.array_sort(F.collect_set(label))
    return expect_suite([check(df, "no_nan", nan == 0, nan), check(df, f"{label}_set", levels == F.array(*[F.lit(x) for x in sorted(allowed)]), F.array_join(levels, ","))])


def expect_declared(measured: DataFrame, declared: DataFrame) -> DataFrame:
    """check, key, expected, tolerance, value, difference, status of every declared or measured value.

    measured: (check, key, value); declared: (version, check, key, expected, tolerance), of which the newest version counts. Keys may be
    NULL. status: holds, differs, missing (declared, not measured or without a value) or undeclared.
    """
    newest = declared.join(F.broadcast(declared.agg(F.max("version").alias("version"))), "version").select(F.col("check").alias("c"), F.col("key").alias("k"), "expected", "tolerance")
    rows = measured.join(newest, F.col("check").eqNullSafe(F.col("c")) & F.col("key").eqNullSafe(F.col("k")), "full")
    gap = F.col("value") - F.col("expected")
    status = F.when(F.col("expected").isNull(), "undeclared").when(F.col("value").isNull() | F.isnan("value"), "missing").when(F.abs(gap) <= F.col("tolerance"), "holds").otherwise("differs")
    return rows.select(F.coalesce("check", "c").alias("check"), F.coalesce("key", "k").alias("key"), "expected", "tolerance", "value", gap.alias("difference"), status.alias("status"))
