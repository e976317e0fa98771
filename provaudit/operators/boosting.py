"""Boosted regression trees for all folds of all splits in one fit.

Features are cut into bins once. Rows whose features fall into the same bins are one cell, as every tree treats them alike: all that a fit needs
of them is their number and the sum of y, in all and by the fold that tests them. These are counted in one pass over the rows, and the
rounds run on cells, of which there are BINS to the power of the features at most, and never more than rows. Every (variant, fold) is a
key with an ensemble of its own, and all grow together: a pass over the cells adds the residuals of what each key trains on (the whole
cell less what the fold tests) to the histograms of its ensemble; histograms are summed in Spark by slot, and the next level of all trees
is chosen from them. So ten splits of five folds take as many jobs as one fold does: rounds times depth, and no row is sent to a fold.
What reaches the driver is one number a slot: ensembles * nodes * features * bins, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.plans.storage import written

BINS, DEPTH, RATE = 32, 3, 0.1


class Ensembles:
    """Trees of every key (variant number, fold), as complete binary trees over bins."""

    def __init__(self, keys: list[tuple[int, int]], start: np.ndarray, features: int):
        self.keys, self.start, self.features = keys, start, features
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (feature, last bin to the left, value of leaves) by key
        self.feature = np.zeros((len(keys), 2**DEPTH - 1), np.int64)
        self.cut = np.full((len(keys), 2**DEPTH - 1), BINS, np.int64)

    def leaf(self, bins: np.ndarray, k: int, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """Node that rows have reached after `depth` levels, numbered within the level."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(depth):
            node = at + 2**level - 1
            at = 2 * at + (bins[rows, feature[k, node]] > cut[k, node])
        return at

    def predicted(self, bins: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(bins), self.start[k])
        for feature, cut, value in self.trees:
            out += value[k, self.leaf(bins, k, feature, cut, DEPTH)]
        return out

    def histogram(self, bins: np.ndarray, n: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
        """Training rows and residual sums by (key, node, feature, bin); leaves have one feature and bin.

        n, y: rows and their sum of y by cell and key.
        """
        leaves = depth == DEPTH
        d, b = (1, 1) if leaves else (self.features, BINS)
        out = np.zeros((len(self.keys), 2**depth, d, b, 2))
        for k in range(len(self.keys)):
            own = np.flatnonzero(n[:, k])
            x, rows = bins[own], n[own, k]
            residual, node = y[own, k] - rows * self.predicted(x, k), self.leaf(x, k, self.feature, self.cut, depth)
            for j in range(d):
                slot = node * b + (0 if leaves else x[:, j])
                out[k, :, j, :, 0] = np.bincount(slot, rows, 2**depth * b).reshape(-1, b)
                out[k, :, j, :, 1] = np.bincount(slot, residual, 2**depth * b).reshape(-1, b)
        return out

    def split(self, h: np.ndarray, depth: int) -> None:
        """The best cut of every node of a level: most of the residuals' squares explained, ties to the first feature and bin."""
        left = np.cumsum(h, axis=3)
        whole = left[:, :, :, -1:, :]
        right = whole - left
        score = lambda x: np.where(x[..., 0] > 0, x[..., 1] ** 2 / np.maximum(x[..., 0], 1), 0.0)
        gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), score(left) + score(right) - score(whole), 0.0)
        flat = gain.reshape(*gain.shape[:2], -1)
        best = flat.argmax(axis=2)
        found = np.take_along_axis(flat, best[:, :, None], 2)[:, :, 0] > 1e-12
        nodes = slice(2**depth - 1, 2 ** (depth + 1) - 1)
        self.feature[:, nodes] = np.where(found, best // BINS, 0)
        self.cut[:, nodes] = np.where(found, best % BINS, BINS)

    def grow(self, h: np.ndarray) -> None:
        """Close the tree with shrunken means of the residuals in its leaves."""
        n, s = h[:, :, 0, 0, 0], h[:, :, 0, 0, 1]
        self.trees.append((self.feature.copy(), self.cut.copy(), RATE * np.where(n > 0, s / np.maximum(n, 1), 0.0)))
        self.cut[:] = BINS


def edges_of(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, from mergeable sketches of all rows."""
    shares = [i / BINS for i in range(1, BINS)]
    got = rows.agg(*[F.percentile_approx(f"`{c}`", shares, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.asarray(got[f"e{i}"] or [], np.float64)) for i in range(len(features))]


def tested_by(assignment: DataFrame, keys: DataFrame, variants: int) -> DataFrame:
    """row_id, ks: the keys that test a row, one a variant at most. keys: (variant, fold, v, k), a row a fold."""
    named = assignment.join(F.broadcast(keys), ["variant", "fold"])
    of = [F.max(F.when(F.col("v") == v, F.col("k"))) for v in range(variants)]
    own = named.groupBy("row_id").agg(F.array_compact(F.array(*of)).alias("ks"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.lit("a row is assigned twice in a variant"))
    return own.select("row_id", F.when(F.size("ks") == F.col("_n"), F.col("ks")).otherwise(twice).alias("ks"))


def learn_boosted(rows: DataFrame, assignment: DataFrame, features: list[str], rounds: int = 20) -> DataFrame:
    """variant, model, fold, row_id, y, p: each fold's test rows predicted by trees boosted on all other rows.

    rows: (row_id, y, features...), each row once; assignment: (variant, row_id, fold), few variants and folds. Rows that no fold tests
    train in all; missing features fall into the first bin; rows without y take no part.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    found = sorted((r.variant, int(r.fold)) for r in assignment.where("fold is not null").select("variant", "fold").distinct().collect())  # a row a fold
    place = {v: i for i, v in enumerate(sorted({v for v, _ in found}))}
    keys = spark.createDataFrame([(v, f, place[v], k) for k, (v, f) in enumerate(found)], "variant string, fold long, v int, k int")
    edges = edges_of(rows, features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell goes by the bins of its features, a byte each."""
        for batch in batches:
            values = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, len(features))
            bins = np.stack([np.searchsorted(e, np.nan_to_num(values[:, j], nan=-np.inf), side="left") for j, e in enumerate(edges)], axis=1)
            cell = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), batch.num_rows, [None, pa.py_buffer(bins.astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cell.cast(pa.binary())], ["row_id", "y", "cell"])

    kind = rows.schema["row_id"].dataType.simpleString()
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    cut = rows.where("y is not null").select("row_id", F.col("y").cast("double").alias("y"), x.alias("x")).mapInArrow(binned, f"row_id {kind}, y double, cell binary")
    # Both sides hold about a row for each row of the table, so none is broadcast, however small its files are.
    data = written(cut.join(tested_by(assignment, keys, len(place)).hint("merge"), "row_id", "left"), "boosting")
    # Sums of a cell by key; -1 has all its rows, tested or not.
    each = F.explode(F.array_append(F.coalesce("ks", F.array().cast("array<int>")), F.lit(-1))).alias("k")
    sums = written(data.select("cell", "y", each).groupBy("cell", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")), "boosting-sums")
    cells = written(sums.groupBy("cell").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n"), F.collect_list("s").alias("s")), "boosting-cells")
    whole = {r.k: (r.n, r.s) for r in sums.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}  # a row a fold
    n_all, s_all = whole.get(-1, (0, 0.0))
    others = [(n_all - n, s_all - s) for n, s in (whole.get(k, (0, 0.0)) for k in range(len(found)))]
    model = Ensembles(found, np.array([s / n if n else 0.0 for n, s in others]), len(features))

    def read(batch: pa.RecordBatch) -> np.ndarray:
        """Bins of each cell."""
        return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, len(features)).astype(np.int64)

    def trained(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums of y that each key trains on, by cell and key: the whole cell less what the key tests."""
        at = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
        k = batch.column(1).flatten().to_numpy()
        out = []
        for i in (2, 3):
            dense = np.zeros((batch.num_rows, len(found) + 1))
            dense[at, k] = batch.column(i).flatten().to_numpy()  # -1 is the last place
            out.append(dense[:, -1:] - dense[:, :-1])
        return out[0], np.where(out[0] > 0, out[1], 0.0)

    def summed(depth: int) -> np.ndarray:
        shared = sc.broadcast(model)
        d, b = (1, 1) if depth == DEPTH else (model.features, BINS)
        shape = (len(model.keys), 2**depth, d, b, 2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    out += shared.value.histogram(read(batch), *trained(batch), depth)
            flat = out.reshape(-1, 2)
            slot = np.flatnonzero(flat[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[slot, 0]), pa.array(flat[slot, 1])], ["slot", "n", "s"])

        h = np.zeros((int(np.prod(shape[:-1])), 2))
        for r in cells.mapInArrow(run, "slot long, n double, s double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
            h[r.slot] = r.n, r.s
        shared.unpersist()
        return h.reshape(shape)

    for _ in range(rounds if found and n_all else 0):
        for depth in range(DEPTH):
            model.split(summed(depth), depth)
        model.grow(summed(DEPTH))
    shared = sc.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each key predicts for a cell."""
        for batch in batches:
            bins = read(batch)
            p = np.array([shared.value.predicted(bins, k) for k in range(len(found))]).reshape(len(found), batch.num_rows)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(p.T.ravel()))], ["cell", "p"])

    fitted = written(cells.mapInArrow(predict, "cell binary, p array<double>"), "boosting-predicted")
    out = data.join(fitted, "cell").select("row_id", "y", "p", F.explode("ks").alias("k")).withColumn("p", F.get("p", F.col("k")))
    return out.join(F.broadcast(keys), "k").select("variant", F.lit("gbt").alias("model"), "fold", "row_id", "y", "p")
