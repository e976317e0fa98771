"""Hard negatives by an inverted multi-index over integer vectors.

Two codebooks, one for each half of the components, are fitted by k-means on a bounded sample; their pairs are cells, and
every row goes to one. The half score of an anchor with the rows of a half-codeword is at most its product with the codeword
plus its length times the codeword's radius (the largest distance of a row from it), so the sum of two such bounds bounds
a cell. A multi-sequence heap visits cells from the highest sum down; a search ends when what it has found lies
above the next bound: then no cell left can hold a better row, and the answer is exact whatever the sample was.

Three searches: the positives of an anchor in the cells around its highest bound, then in all others whose bound reaches
what was found there, then the negatives of all its windows (`low` to `high` per cent of a positive's score) at once. Runs of
neighbouring cells form blocks of bounded size, a full cell having several; an anchor goes only to blocks that its bounds
admit. What is broadcast: codebooks and one row a cell (65,536 at most), whatever the table.

Rows without an id, label or vector, with a NULL or non-finite component, with a component beyond 2 ** 20 (its products
may not fit 64 bits), or of another length than the most common one take no part. Rows equal in id, label and vector are one row;
rows that share an id only are rows of their own, and a row is other than the anchor if it differs in any of the three. Rows equal in label and vector are
one entry with its smallest ids, kept within partitions first, so copies cost one comparison. Ties go to the smaller id.
An empty table gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.llm.common import table, worker_state, written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
LARGEST = 2.0**20
#: Rows on which codebooks are fitted, rows of a cell aimed at, codewords of a half at most, rows of a block.
SAMPLE = 20_000
ROWS_PER_CELL = 128
CODEWORDS = 256
BLOCK_ROWS = 16_384
SEED = 11
#: What rounding may take from a bound, as a share of it.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel=None) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part. relabel(id, label): the label to use."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    rows = rows.where("vec_id is not null and label is not null and size(v) > 0").where(fine)
    if relabel is not None:
        rows = rows.withColumn("label", relabel(F.col("vec_id"), F.col("label")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == F.lit(sizes.n)) if sizes else rows
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def keys_of(column: pa.Array) -> list[bytes]:
    flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.int32)
    return [v.tobytes() for v in flat.reshape(len(column), -1)] if len(column) else []


def entries(rows: DataFrame, most: int) -> DataFrame:
    """label, key (bytes of the vector), ids: the `most` smallest ids of rows equal in both, ascending."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for i, label, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), keys_of(batch.column(2))):
                ids = held.setdefault((label, key), [])
                ids.append(i)
                if len(ids) > 4 * most:
                    ids[:] = sorted(set(ids))[:most]
            if len(held) > 20_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        labels, keys = zip(*held) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(keys, pa.binary()), pa.array([sorted(set(x))[:most] for x in held.values()], pa.list_(pa.int64()))], ["label", "key", "ids"])

    first = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    part = rows.mapInArrow(local, "label long, key binary, ids array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    return part.groupBy("label", "key", "salt").agg(first).groupBy("label", "key").agg(first)


def codewords(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means of rows x."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=1))


class Cells:
    """Both codebooks; radii, cells and blocks once `laid_out`."""

    def __init__(self, sample: np.ndarray, n: int, rows_per_cell: int = ROWS_PER_CELL):
        self.half = sample.shape[1] // 2
        k = max(1, min(CODEWORDS, int((n / rows_per_cell) ** 0.5)))
        self.books = [codewords(x, k, SEED) if x.shape[1] else np.zeros((1, 0)) for x in self.halves(sample)]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[..., : self.half], x[..., self.half :]

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each row, and its distances from both codewords."""
        own = [nearest(h, c) for h, c in zip(self.halves(x), self.books)]
        return own[0] * CODEWORDS + own[1], [distances(h, c[o]) for h, c, o in zip(self.halves(x), self.books, own)]

    def laid_out(self, stats: list, block_rows: int) -> Cells:
        """stats: (cell, n, far0, far1) of each cell that has rows, by cell. Runs of cells share a block, a full cell has several."""
        self.cells = np.array([s.cell for s in stats])
        self.radii = [np.zeros(len(c)) for c in self.books]
        for h, own in enumerate((self.cells // CODEWORDS, self.cells % CODEWORDS)):
            np.maximum.at(self.radii[h], own, [s[2 + h] for s in stats])
        runs, block, held = [], 0, 0  # first cell, first block, blocks
        for at, s in enumerate(stats):
            parts = -(-s.n // block_rows)
            if not runs or parts > 1 or held + s.n > block_rows:
                block += runs[-1][2] if runs else 0
                runs.append((at, block, parts))
                held = 0
            held = block_rows if parts > 1 else held + s.n
        self.run_cell, self.run_block, self.run_parts = (np.array(x) for x in zip(*runs))
        return self

    def block_of(self, cell: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.run_cell, np.searchsorted(self.cells, cell), side="right") - 1
        return self.run_block[run] + hashed % self.run_parts[run]

    def half_bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(products with codewords, what radii add or take) of each half; q is one anchor or several."""
        return [(h @ c.T, np.sqrt((h * h).sum(axis=-1))[..., None] * r * (1 + SLACK)) for h, c, r in zip(self.halves(q), self.books, self.radii)]

    def run_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest upper and lowest lower bound of the cells of each run, for anchors q."""
        (a, ra), (b, rb) = self.half_bounds(q)
        i, j = self.cells // CODEWORDS, self.cells % CODEWORDS
        middle, spread = a[:, i] + b[:, j], ra[:, i] + rb[:, j]
        spread = spread + SLACK * np.abs(middle) + 1e-6
        return np.maximum.reduceat(middle + spread, self.run_cell, axis=1), np.minimum.reduceat(middle - spread, self.run_cell, axis=1)


def falling_sums(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(a[i] + b[j], i, j) from the highest sum down: the multi-sequence heap."""
    by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    x, y = a[by_a].tolist(), b[by_b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        minus, i, j = heap[0]
        yield -minus, by_a[i], by_b[j]
        if j + 1 < len(y):
            heapq.heapreplace(heap, (-(x[i] + y[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class Block:
    """Rows of a block by cell, with radii of their own."""

    def __init__(self, books: Cells, labels: list[int], keys: list[bytes], ids: list[list[int]]):
        x = np.stack([np.frombuffer(k, np.int32) for k in keys]).astype(np.int64)
        cell, far = books.assigned(x.astype(np.float64))
        order = np.argsort(cell, kind="stable")
        self.x, cell = x[order], cell[order]
        largest = int(np.abs(self.x).max(initial=0))
        self.exact = largest * largest * x.shape[1] < 2**52  # then products of doubles are exact
        if self.exact:
            self.x = self.x.astype(np.float64)
        self.largest = largest
        self.label = np.array(labels)[order]
        self.ids = [ids[i] for i in order.tolist()]
        cuts = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
        self.spans = {(c // CODEWORDS, c % CODEWORDS): (s, e) for c, s, e in zip(cell[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist())}
        self.books, self.own = books, [np.unique(cell // CODEWORDS), np.unique(cell % CODEWORDS)]
        self.radii = []
        for own, word, d in zip(self.own, (cell // CODEWORDS, cell % CODEWORDS), far):
            r = np.zeros(len(own))
            np.maximum.at(r, np.searchsorted(own, word), d[order])
            self.radii.append(r)

    def visited(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, first row, end) of the cells that have rows, from the highest upper bound down."""
        half = [(h @ c[own].T, (h @ h) ** 0.5 * r * (1 + SLACK)) for h, c, own, r in zip(self.books.halves(q.astype(np.float64)), self.books.books, self.own, self.radii)]
        (a, ra), (b, rb) = half
        words = [w.tolist() for w in self.own]
        for bound, i, j in falling_sums(a + ra, b + rb):
            if span := self.spans.get((words[0][i], words[1][j])):
                loose = SLACK * (abs(a[i]) + abs(b[j])) + 1e-6
                yield bound + loose, a[i] - ra[i] + b[j] - rb[j] - loose, *span

    def products(self, q: np.ndarray, s: int, e: int) -> np.ndarray:
        if self.exact and self.largest * int(np.abs(q).max(initial=0)) * len(q) < 2**52:
            return (self.x[s:e] @ q.astype(np.float64)).astype(np.int64)
        return self.x[s:e].astype(np.int64) @ q

    def first(self, score: np.ndarray, row: np.ndarray, most: int) -> list[tuple[int, int, int]]:
        """(score, id, entry) of the `most` first rows of those given, ties to smaller ids."""
        if len(row) > most:
            take = score >= np.partition(score, len(score) - most)[len(score) - most]
            score, row = score[take], row[take]
        out = heapq.nsmallest(most, ((-s, i, r) for s, r in zip(score.tolist(), row.tolist()) for i in self.ids[r]))
        return [(-s, i, r) for s, i, r in out]

    def positives(self, q: np.ndarray, label: int, floor: int | None, most: int) -> list[tuple[int, int, int]]:
        """(1 for the anchor's own entry, score, id) of the `most` first rows of the label that score `floor` at least."""
        scores, rows, best = [], [], []
        for bound, _, s, e in self.visited(q):
            if floor is not None and bound < floor or len(best) == most and best[0] > bound:
                break
            same = np.flatnonzero(self.label[s:e] == label)
            if len(same):
                got = self.products(q, s, e)[same]
                keep = got >= (best[0] if len(best) == most else floor if floor is not None else -(2**63))
                if keep.any():
                    scores.append(got[keep])
                    rows.append(same[keep] + s)
                    for x in got[keep].tolist():
                        (heapq.heappushpop if len(best) == most else heapq.heappush)(best, x)
        if not rows:
            return []
        return [(int((self.x[r] == q).all()), s, i) for s, i, r in self.first(np.concatenate(scores), np.concatenate(rows), most)]

    def negatives(self, q: np.ndarray, label: int, wanted: list[int], most: int, low: int, high: int) -> list[tuple[int, int, int]]:
        """(positive's score, score, id) of the `most` first rows of other labels in each positive's window."""
        windows = [(p, -(-low * p // 100), high * p // 100) for p in wanted if p >= 0]  # whole scores in a window
        scores, rows = [], []
        open_ = windows
        for bound, least, s, e in self.visited(q):
            if windows and bound < max(h for _, _, h in open_):  # only now can a window be certified
                found = np.concatenate(scores) if scores else np.zeros(0, np.int64)
                open_ = [w for w in open_ if bound >= w[1] and np.count_nonzero((found > bound) & (found <= w[2])) < most]
            if not open_:
                break
            if least > max(h for _, _, h in open_):
                continue
            got = self.products(q, s, e)
            fit = np.flatnonzero((self.label[s:e] != label) & (got >= min(w[1] for w in open_)) & (got <= max(w[2] for w in open_)))
            if len(fit):
                scores.append(got[fit])
                rows.append(fit + s)
        if not rows:
            return []
        scores, rows = np.concatenate(scores), np.concatenate(rows)
        out = []
        for p, lo, hi in windows:
            fit = (scores >= lo) & (scores <= hi)
            out += [(p, s, i) for s, i, _ in self.first(scores[fit], rows[fit], most)]
        return out


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: (vec_id, label, v) as `usable` gives them; anchors: a condition on vec_id. low, high: whole per cent.
    """
    spark, most = rows.sparkSession, max(positives + 1, negatives)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    unit = written(entries(rows, most), "entries")
    n = int(unit.agg(F.count(F.lit(1))).first()[0])
    if not n:
        return spark.createDataFrame([], schema)
    every = max(1, n // SAMPLE)
    drawn = unit.where(F.pmod(F.xxhash64("key", "label"), F.lit(every)) == 0).select("key").limit(2 * SAMPLE).collect() or unit.select("key").limit(SAMPLE).collect()
    cells = Cells(np.stack([np.frombuffer(bytes(r.key), np.int32) for r in drawn]).astype(np.float64), n, rows_per_cell)
    books = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(k, np.int32) for k in batch.column(1).to_pylist()]).astype(np.float64)
                cell, far = books.value.assigned(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), *(pa.array(f * (1 + SLACK)) for f in far)], [*batch.schema.names, "cell", "far0", "far1"])

    placed = written(unit.mapInArrow(assign, "label long, key binary, ids array<long>, cell int, far0 double, far1 double"), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).orderBy("cell").collect()  # 65,536 at most
    plan = spark.sparkContext.broadcast(cells.laid_out(stats, block_rows))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = plan.value.block_of(batch.column(3).to_numpy(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *batch.columns[:3]], ["block", "label", "key", "ids"])

    hashed = placed.select("label", "key", "ids", "cell", F.pmod(F.xxhash64("key", "label", F.lit(1)), F.lit(1 << 31)).alias("h"))
    index = hashed.mapInArrow(blocks, "block long, label long, key binary, ids array<long>").withColumns({"asks": F.lit(0), "state": F.array().cast("array<long>")})

    def route(step: str):
        """Anchors (label, key, state) to the blocks that their bounds admit."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = plan.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    state = part.column(2).to_pylist()
                    upper, lower = p.run_bounds(np.stack([np.frombuffer(k, np.int32) for k in part.column(1).to_pylist()]).astype(np.float64))
                    home = np.argmax(upper, axis=1)
                    if step == "home":
                        go = np.zeros(upper.shape, bool)
                        go[np.arange(len(home)), home] = True
                    elif step == "others":
                        go = upper >= np.array([s[0] if s else -np.inf for s in state])[:, None]
                        go[np.arange(len(home)), home] = False
                    else:
                        go = (upper >= np.array([low * min(s) / 100 for s in state])[:, None]) & (lower <= np.array([high * max(s) / 100 for s in state])[:, None])
                    who, run_ = np.nonzero(go)
                    parts = p.run_parts[run_]
                    who, first = np.repeat(who, parts), np.repeat(p.run_block[run_], parts)
                    block = first + np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(c.take(pa.array(who)) for c in part.columns)], ["block", "label", "key", "state"])

        return run

    def searched(asked: DataFrame, step: str, into: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state()
            now, labels, keys, ids, block_ = None, [], [], [], None
            for batch in batches:
                block, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                change = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
                for s, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                    if s == e:
                        continue
                    if block[s] != now:
                        now, labels, keys, ids, block_ = block[s], [], [], [], None
                    label, key, own, state = (batch.column(i).slice(s, e - s).to_pylist() for i in range(2, 6))
                    if not asks[s]:
                        labels += label
                        keys += key
                        ids += own
                    elif keys:
                        block_ = block_ or Block(books.value, labels, keys, ids)
                        for at in range(0, len(key), 500):
                            yield found(block_, label[at : at + 500], key[at : at + 500], state[at : at + 500])

        def found(block_: Block, labels: list, keys: list, states: list) -> pa.RecordBatch:
            out = []
            for label, key, state in zip(labels, keys, states):
                q = np.frombuffer(key, np.int32).astype(np.int64)
                if step == "windows":
                    out += [(label, key, *x) for x in block_.negatives(q, label, state, negatives, low, high)]
                else:
                    out += [(label, key, *x) for x in block_.positives(q, label, state[0] if state else None, positives + 1)]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["label", "key", "window", "score", "id"])

        asks = asked.mapInArrow(route(step), "block long, label long, key binary, state array<long>").withColumns({"asks": F.lit(1), "ids": F.array().cast("array<long>")})
        names = ["block", "asks", "label", "key", "ids", "state"]
        dealt = index.select(*names).union(asks.select(*names)).repartition("block").sortWithinPartitions("block", "asks")
        best = dealt.mapInArrow(run, "label long, key binary, window long, score long, id long")
        return written(best, into)

    def best(found_: DataFrame, by: list[str], n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found_.withColumn("r", rank).where(F.col("r") <= n)

    asking = rows.where(anchors).mapInArrow(anchor_keys, "vec_id long, label long, key binary").distinct()
    asking = written(asking, "anchors")
    unique = asking.select("label", "key").distinct()
    home = searched(unique.withColumn("state", F.array().cast("array<long>")), "home", "home")
    reach = best(home, ["label", "key"], positives + 1).groupBy("label", "key").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("c"))
    state = F.when(F.col("c") > positives, F.array("least")).otherwise(F.array().cast("array<long>"))
    others = searched(unique.join(reach, ["label", "key"], "left").select("label", "key", F.coalesce(state, F.array().cast("array<long>")).alias("state")), "others", "others")
    near = written(best(home.union(others), ["label", "key"], positives + 1).select("label", "key", "score", "id", F.col("window").alias("own")), "positives")
    windows = near.where("score >= 0").groupBy("label", "key").agg(F.collect_set("score").alias("state"))  # positives + 1 at most
    wrong = best(searched(windows, "windows", "windows"), ["label", "key", "window"], negatives)
    # The row itself is left out of its positives, which then are the first that the entry has found.
    own = asking.join(near, ["label", "key"]).where((F.col("id") != F.col("vec_id")) | (F.col("own") == 0))
    first = F.row_number().over(Window.partitionBy("label", "key", "vec_id").orderBy(F.desc("score"), "id"))
    own = own.withColumn("p", first).where(F.col("p") <= positives).select("label", "key", "vec_id", F.col("id").alias("positive_id"), F.col("score").alias("window"))
    out = own.join(wrong.select("label", "key", "window", "r", "score", F.col("id").alias("negative_id")), ["label", "key", "window"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("r").cast("int").alias("rank"), "negative_id", F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


def anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys_of(batch.column(2)), pa.binary())], ["vec_id", "label", "key"])


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    relabel = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(usable(table(spark, sf_dir, "embeddings"), relabel=relabel), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.label <> n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10
"""
