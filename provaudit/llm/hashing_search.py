"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors become codes by several rotations learned on a bounded sample: principal directions, then iterative
quantisation, each from its own start. A code is split into 8-bit substrings, each with an index of its own. For a Hamming
radius r, substring i has a threshold t_i with sum(t_i + 1) = r + 1, so every code within r agrees with the query up to t_i in
some substring (the pigeonhole principle); the index holds, for each substring value, the set of rows within t_i as
a bitmap, so probing is the union of one bitmap per substring. What it retrieves is checked against r, then ranked
by exact inner products in double precision. The radius is the one that holds `RECALL` of the true neighbours of
sample queries in the sample; where fewer than k rows lie within it, it grows until k do.

Search: equal vectors are one entry with its k + 1 smallest distinct ids (taken within partitions first), so a group of copies
costs one comparison and ties are exact. Entries are dealt into index blocks of bounded size and the stated query set is
searched in each block; a block returns candidates of k + 1 distinct ids a query, merged by key. NULL, zero and non-finite
vectors, and those of another length than the most common one, take no part. Repeated rows are one candidate, and an id
with several vectors is found once, by the nearest; rows of the query's id are not its candidates. A row without an
id takes no part. Ties go to the smaller id. An empty table gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.llm.common import table, worker_state, written

K = 20
ROTATIONS = 4
SAMPLE = 6_000
RECALL = 0.985
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_000
SEED = 7


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == F.lit(sizes.n)) if sizes else rows


def principal(x: np.ndarray) -> np.ndarray:
    """Directions of largest variance about the origin, as columns."""
    return np.linalg.svd(x, full_matrices=False)[2].T


def iterative_quantisation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """A rotation of x whose signs lose least."""
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        b = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(x.T @ b)
        r = u @ w
    return r


class Hasher:
    """Learned projections from vectors to 64-bit words of code.

    For the largest inner product a stored vector gets one more component, which fills its length up to the longest;
    queries have zero there, so angles order as inner products do.
    """

    def __init__(self, sample: np.ndarray, longest: float, k: int = K):
        self.longest = longest
        x = self.stored(sample)
        basis = principal(x)
        turned = x @ basis
        # Short vectors take more rotations, so that codes have at least 64 bits whatever the dimension.
        rotations = max(ROTATIONS, -(-64 // basis.shape[1]))
        self.projection = np.concatenate([basis @ iterative_quantisation(turned, SEED + i) for i in range(rotations)], axis=1)
        self.n_bits = self.projection.shape[1] // 64 * 64
        self.projection = self.projection[:, : self.n_bits]
        self.radius = self.n_bits
        if len(sample) > 2 * k:
            queries = sample[: min(400, len(sample))]
            truth = queries @ sample.T
            truth[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
            best = np.argpartition(-truth, k, axis=1)[:, :k]
            codes, own = self.codes(x), self.codes(self.asked(queries))
            far = np.bitwise_count(own[:, None, :] ^ codes[best]).sum(axis=2)
            self.radius = int(np.quantile(far, RECALL))

    def stored(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0.0, self.longest**2 - (v * v).sum(axis=1)))])

    def asked(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.zeros(len(v))])

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = x @ self.projection >= 0
        return np.packbits(bits, axis=1).view(np.uint64)


class MultiIndex:
    """Substring indexes of a block of codes for one radius."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        self.parts = codes.view(np.uint8).reshape(len(codes), -1)
        m = self.parts.shape[1]
        base, more = divmod(radius + 1, m)  # thresholds t_i + 1 share radius + 1
        self.near = []
        for i in range(m):
            sets = np.zeros((256, -(-len(codes) // 8)), np.uint8)
            for value in np.unique(self.parts[:, i]):
                sets[value] = np.packbits(self.parts[:, i] == value)
            for _ in range(min(8, base + (i < more) - 1)):  # widen by one bit flip at a time
                sets = sets | np.bitwise_or.reduce([sets[np.arange(256) ^ (1 << b)] for b in range(8)])
            self.near.append(sets if base + (i < more) > 0 else None)

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows within the radius: pigeonhole probing, then the exact distance."""
        probed = [sets[v] for sets, v in zip(self.near, code.view(np.uint8)) if sets is not None]
        rows = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(probed), count=len(self.codes)))
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= self.radius]

    def at_least(self, code: np.ndarray, k: int) -> np.ndarray:
        """Rows within the radius, or within the smallest larger one that holds k rows."""
        rows = self.within(code)
        if len(rows) < min(k, len(self.codes)):
            far = np.bitwise_count(self.codes ^ code).sum(axis=1)
            rows = np.flatnonzero(far <= np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1])
        return rows


def entries(rows: DataFrame, most: int) -> DataFrame:
    """key (bytes of the vector), ids: the `most` smallest ids of equal vectors, ascending.

    Each partition keeps `most` ids a vector before anything is shuffled, so a group of copies stays small.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), np.float64) + 0.0
            for i, v in zip(batch.column(0).to_pylist(), flat.reshape(batch.num_rows, -1) if batch.num_rows else ()):
                ids = held.setdefault(v.tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * most:
                    ids[:] = sorted(set(ids))[:most]
            if len(held) > 20_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(x))[:most] for x in held.values()], pa.list_(pa.int64()))], ["key", "ids"])

    part = rows.mapInArrow(local, "key binary, ids array<long>")
    return part.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, itself left out.

    vectors, queries: (vec_id, v) as `usable` gives them, queries being rows of vectors.
    """
    spark = vectors.sparkSession
    unit = written(entries(vectors, k + 1), "entries")
    n, longest = unit.agg(F.count(F.lit(1)), F.lit(0)).first()[0], vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    every = max(1, n // SAMPLE)
    drawn = unit.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").limit(2 * SAMPLE).collect() or unit.select("key").limit(SAMPLE).collect()
    sample = np.stack([np.frombuffer(bytes(r.key)) for r in drawn])
    shared = spark.sparkContext.broadcast(Hasher(sample, longest, k))
    blocks = -(-n // block_rows)
    index = unit.select(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).alias("block"), F.lit(0).alias("asks"), "key", "ids")
    asked = queries.mapInArrow(key_of, "vec_id long, key binary")
    texts = asked.select("key").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("block").cast("long"), F.lit(1).alias("asks"), "key", F.array().cast("array<long>").alias("ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        hasher, now, keys, ids, ready = shared.value, None, [], [], None
        for batch in batches:
            block, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if s == e:
                    continue
                if block[s] != now:
                    now, keys, ids, ready = block[s], [], [], None
                got = batch.column(2).slice(s, e - s).to_pylist()
                if not asks[s]:
                    keys += got
                    ids += batch.column(3).slice(s, e - s).to_pylist()
                elif keys:
                    if ready is None:
                        x = np.stack([np.frombuffer(g) for g in keys])
                        ready = (x, MultiIndex(hasher.codes(hasher.stored(x)), hasher.radius))
                    for at in range(0, len(got), QUERY_ROWS):
                        yield found(hasher, *ready, ids, got[at : at + QUERY_ROWS])

    def nearest_ids(x, ids, v, near) -> list[tuple[float, int]]:
        """(score, id) of the k + 1 nearest distinct ids among rows `near`, ties to smaller ids."""
        score = (x[near] * v).sum(axis=1)
        order, take = np.argsort(-score, kind="stable"), k + 1
        falling = -score[order]
        while True:
            stop = int(np.searchsorted(falling, falling[min(take, len(falling)) - 1], side="right"))  # ties of the last place stay
            best: dict[int, float] = {}
            for s, r in zip((-falling[:stop]).tolist(), near[order[:stop]].tolist()):
                for i in ids[r]:
                    best.setdefault(i, s)
            if len(best) > k or stop == len(falling):
                return sorted(((s, i) for i, s in best.items()), key=lambda o: (-o[0], o[1]))[: k + 1]
            take *= 2

    def found(hasher, x, index_, ids, wanted) -> pa.RecordBatch:
        q = np.stack([np.frombuffer(g) for g in wanted])
        codes, rows = hasher.codes(hasher.asked(q)), []
        for key, v, code in zip(wanted, q, codes):
            near = index_.at_least(code, k + 1)
            best = nearest_ids(x, ids, v, near)
            if len(best) <= k and len(near) < len(x):  # ids with several vectors
                best = nearest_ids(x, ids, v, np.arange(len(x)))
            rows += [(key, i, s) for s, i in best]
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["key", "vec_id", "score"])

    dealt = index.union(texts).repartition("block").sortWithinPartitions("block", "asks")
    local = dealt.mapInArrow(search, "key binary, vec_id long, score double")
    local = local.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    best = local.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    per = asked.withColumnRenamed("vec_id", "query_id").distinct().join(lists, "key")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = per.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def key_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = np.asarray(batch.column(1).flatten(), np.float64) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat.reshape(batch.num_rows, -1)], pa.binary())], ["vec_id", "key"])


def op5_multi_index(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0))
