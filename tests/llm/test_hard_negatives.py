"""Hard negatives against all scores."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from provaudit.llm import hard_negatives as H

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows: list[tuple], every: int) -> list[tuple]:
    """rows: (id, vector, label); distinct rows that take part, anchors being ids divisible by `every`."""
    fit = [(i, tuple(int(math.floor(256 * np.float64(np.float32(x)))) for x in v), y) for i, v, y in rows if None not in (i, v, y) and v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in fit]
    fit = sorted({r for r in fit if len(r[1]) == max(sorted(set(lengths)), key=lengths.count)}) if fit else []
    out = []
    for a in [r for r in fit if r[0] % every == 0]:
        scored = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b) for b in fit if b != a)
        for s, i, _ in [x for x in scored if x[2][2] == a[2]][:5]:
            negatives = [(n, j) for n, j, b in scored if b[2] != a[2] and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a[0], i, k + 1, j, -s, -n) for k, (n, j) in enumerate(negatives)]
    return sorted(out)


def mined(df, every: int, **how) -> list[tuple]:
    return sorted(tuple(r) for r in H.hard_negatives(H.usable(df), F.col("vec_id") % every == 0, **how).collect())


def clustered(seed: int, n: int, dims: int, labels: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = centres[rng.integers(0, 12, n)] * 0.3 + rng.standard_normal((n, dims)) * 0.1
    return [(i, [float(c) for c in v], int(rng.integers(0, labels))) for i, v in enumerate(x)]


def test_heap_visits_sums_from_the_highest_down():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(-5, 5, rng.integers(1, 9)).astype(float), rng.standard_normal(rng.integers(1, 9))
        got = list(H.falling_sums(a, b))
        assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(len(a)) for j in range(len(b))]
        assert all(x[0] == a[x[1]] + b[x[2]] for x in got) and all(x[0] >= y[0] for x, y in zip(got, got[1:]))


def test_bounds_hold_for_every_row():
    x = np.floor(256 * np.array([v for _, v, _ in clustered(3, 900, 9, 4)]))
    cells = H.Cells(x[:300], len(x), 16)
    block = H.Block(cells, [0] * len(x), [v.astype(np.int32).tobytes() for v in x], [[i] for i in range(len(x))])
    visited = 0
    for q in x[:20].astype(np.int64):
        last = math.inf
        for upper, lower, s, e in block.visited(q):
            got = block.products(q, s, e)
            assert lower <= got.min() and got.max() <= upper and upper <= last + 1e-6
            last, visited = upper, visited + e - s
    assert visited == 20 * len(x) and len(block.spans) > 20


@pytest.mark.parametrize(("dims", "labels", "block_rows"), [(8, 4, 100), (8, 2, 5_000), (1, 3, 50), (33, 5, 250)])
def test_blocks_and_bounds_lose_nothing(spark, dims, labels, block_rows):
    rows = clustered(dims, 700, dims, labels)
    assert mined(spark.createDataFrame(rows, SCHEMA), 20, block_rows=block_rows, rows_per_cell=12) == expected(rows, 20)


def test_searches_stop_early_on_clustered_rows(spark, monkeypatch):
    """Windows are certified before all cells are visited."""
    rows = clustered(5, 3_000, 6, 3)
    keys = [(np.floor(256 * np.array(v))).astype(np.int32) for _, v, _ in rows]
    cells = H.Cells(np.stack(keys[:2000]).astype(float), len(keys), 20)
    block = H.Block(cells, [y for _, _, y in rows], [k.tobytes() for k in keys], [[i] for i, _, _ in rows])
    seen = []
    products = block.products
    monkeypatch.setattr(block, "products", lambda q, s, e: seen.append(e - s) or products(q, s, e))
    q = keys[0].astype(np.int64)
    positives = block.positives(q, rows[0][2], None, 6)
    assert len(positives) == 6 and 0 < sum(seen) < len(rows) / 2
    seen.clear()
    assert len(block.negatives(q, rows[0][2], [s for _, s, _ in positives], 10, 30, 90)) >= 10 and sum(seen) < len(rows)


def test_copies_ties_and_odd_rows(spark):
    """A third of the rows are one vector; zero vectors tie everywhere; rows that take no part; repeated rows and ids."""
    base = clustered(7, 150, 4, 3)
    hot = [(1_000 + i, [0.5, 0.25, -0.5, 1.0], i % 3) for i in range(120)]
    zero = [(2_000 + i, [0.0] * 4, i % 2) for i in range(30)]
    odd = [(None, [1.0] * 4, 1), (3_000, None, 1), (3_010, [1.0, None, 1.0, 1.0], 1), (3_020, [1.0, float("nan"), 1.0, 1.0], 1), (3_030, [1.0, float("inf"), 1.0, 1.0], 1), (3_040, [1.0] * 4, None), (3_050, [1.0] * 3, 1), (3_060, [], 1)]
    again = [(10, [0.9, -0.9, 0.1, 0.3], 1), (20, [0.1, 0.1, 0.1, 0.1], 2), (4_000, [100.0, 200.0, -300.0, 0.0], 0), (4_010, [90.0, 210.0, -300.0, 0.0], 1)]
    rows = base + hot + hot + zero + odd + again + base[:20]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("x"), "ids": F.lit(1), "block": F.lit(2), "score": F.lit("y"), "v": F.lit(0)})
    assert mined(df, 10, block_rows=64, rows_per_cell=8) == expected(rows, 10)


def test_components_too_large_for_products_of_doubles(spark):
    rows = [(i, [float((-1) ** (i + k) * (2**19 + 977 * i * k)) for k in range(6)], i % 2) for i in range(60)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10, block_rows=20, rows_per_cell=4) == expected(rows, 10)


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 10) == []
    assert mined(spark.createDataFrame([(3, [1.0, 2.0], 0)], SCHEMA), 10) == []
    assert mined(spark.createDataFrame([(0, [1.0, 2.0], 0)], SCHEMA), 10) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(H.ORACLE).fetchall())
    assert sorted(tuple(r) for r in H.op13_hard_negatives(spark, SF).collect()) == want and want
