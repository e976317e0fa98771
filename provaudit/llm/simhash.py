"""SimHash near-duplicates by generalised pigeonhole search.

A document's fingerprint has, for each bit, the majority over the hashes of its word shingles. Documents with equal
fingerprints are grouped first, so copies never meet in pairs. Among distinct fingerprints, the 64 bits of a
word are dealt into partitions of correlated bits with thresholds t_i of their own, where sum(t_i + 1) = radius + 1: two
words within the radius then differ in at most t_i bits of some partition i. Partitions and thresholds
come from a dynamic programme over the rows shuffled and candidates compared that a bounded sample of
fingerprints lets expect (the plan never changes the result). Each fingerprint is at home at its own value in each
partition and probes the values within t_i; candidates meet there and are verified on all bits inside the
task, and only a spanning forest of the verified links leaves it. A value that many fingerprints share is dealt into a
grid of tasks. Components follow by star contraction.

`near_groups` links fingerprints of 64 bits over all shingles within a radius. `near_duplicates` links texts whose
sets of distinct shingles resemble each other by a given share: the fingerprint then has several words over the distinct
shingles, each word is searched, candidates within the bits that the resemblance lets expect are joined
closest first, and every link that is kept has been verified on the two whole sets. Where the sets refute a link, other
candidates of the same group were passed over for it; such groups are searched again with the sets at hand, in
blocks of bounded size, so that no candidate that the sets confirm is lost.

NULL and empty texts have fingerprint zero and link like any other. A component's id is its smallest non-NULL id
(NULL if it has none). Repeated rows are returned as often as they come, and ids may be NULL or shared. Very long texts
are hashed in parts. An empty table gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.llm.common import as_bytes, chunks, keyed, row_count, table, worker_state, written
from provaudit.llm.sketch import Hasher

SEED = 42
SAMPLE = 10_000
#: Cost of comparing two fingerprints, in rows sent to a partition's value.
PAIR_COST = 0.0005
#: Fingerprints at home in one task of a value, and the most values whose numbers reach the driver.
HEAVY = 16_000
MOST_HEAVY = 20_000
#: Hashes whose bits are counted at once, and pairs compared at once.
HASHES = 200_000
PAIRS = 1_000_000
#: Shingle hashes of a block of texts whose links are settled on whole sets.
SET_HASHES = 200_000
#: Links that one task settles at once.
SETTLED = 200_000
#: Fixed values of a 64-bit finaliser (splitmix64), which derives further hashes from one.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash derived from h; the 0-th is h itself."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(MIX[0] * k % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[1])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[2])
        return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; a shorter text is one run, a text without words none."""
    words = text.lower().split()
    if len(words) <= width:
        return np.asarray([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in runs), np.uint64, len(words) - width + 1)


def majority_bits(lists: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints of lists of hashes as a (lists, 8 * words) array of bytes, the most significant first."""
    n = np.asarray([len(x) for x in lists], np.int64)
    out, full = np.zeros((len(lists), words, 8), np.uint8), np.flatnonzero(n)
    if not len(full):
        return out.reshape(len(lists), -1)
    ends = np.cumsum(n[full])
    flat = np.concatenate([lists[i] for i in full])
    for k in range(words):
        set_ = np.zeros((len(full), 64), np.int64)
        for at in range(0, len(flat), HASHES):
            part = flat[at : at + HASHES]
            bits = np.unpackbits(mixed(part, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            first = int(np.searchsorted(ends, at, side="right"))
            last = int(np.searchsorted(ends, at + len(part), side="left"))
            starts = np.maximum(np.concatenate(([0], ends[first:last])) - at, 0)
            starts[0] = 0
            set_[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[full, k] = np.packbits(set_ * 2 > n[full, None], axis=1)
    return out.reshape(len(lists), -1)


def binary_array(rows: np.ndarray) -> pa.Array:
    """A (rows, width) array of bytes as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of one width as a (rows, width) array of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp: the binary fingerprint of 64 bits of each row, over all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for batch in batches:
            for part in chunks(batch, "text", 2_000_000):
                got = majority_bits([shingle_hashes(t, width) for t in as_bytes(part.column(1))], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), binary_array(got)], ["doc_id", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, fp binary")


def shingle_sets(texts: list[bytes], hasher: Hasher) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and a 16-byte digest of them."""
    sets = [np.unique(h) for h in hasher.shingles(texts)]
    digests = np.frombuffer(b"".join([hashlib.md5(x.tobytes(), usedforsecurity=False).digest() for x in sets]), np.uint8)
    return sets, digests.reshape(-1, 16)


def correlated_partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """Deal the columns of a 0/1 matrix into m groups of nearly equal size, each grown from its most correlated bits."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    near = np.abs((centred / scale).T @ (centred / scale))
    left, groups = set(range(bits.shape[1])), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        group = [max(left, key=lambda b: (near[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (near[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def partition_costs(bits: np.ndarray, group: list[int], n: int, radius: int) -> list[float]:
    """Estimated cost of thresholds -1, 0, .. radius for one partition."""
    p = bits[:, group].mean(axis=0)
    differ = np.zeros(len(group) + 1)
    differ[0] = 1.0
    for q in 2 * p * (1 - p):  # distribution of the distance, bits taken as independent
        differ[1:] = differ[1:] * (1 - q) + differ[:-1] * q
        differ[0] *= 1 - q
    _, same = np.unique(np.packbits(bits[:, group].astype(np.uint8), axis=1), axis=0, return_counts=True)
    s = max(2, len(bits))
    equal = max(differ[0], (same * (same - 1)).sum() / (s * (s - 1)))
    costs = [0.0]
    for t in range(radius + 1):
        side = max(1, -(-n // (HEAVY << len(group))))  # values that all are shared by too many go to grids of tasks
        rows = n * side * sum(comb(len(group), j) for j in range(min(t, len(group)) + 1))
        pairs = n * n / 2 * min(1.0, differ[1 : t + 1].sum() + equal)
        costs.append(rows + PAIR_COST * pairs)
    return costs


def search_plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[int, list[int], int]]:
    """Partitions as (mask, single-bit masks, threshold) whose thresholds cover the radius at least estimated cost."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    best: tuple[float, list] = (np.inf, [])
    for m in range(2, min(radius + 1, 16) + 1):
        groups = correlated_partitions(bits, m)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # thresholds plus one spent so far
        for group in groups:
            costs, wider = partition_costs(bits, group, n, radius), {}
            for spent, (cost, ts) in reach.items():
                for t in range(-1, radius + 1 - spent):
                    option = (cost + costs[t + 1], [*ts, t])
                    wider[spent + t + 1] = min(wider.get(spent + t + 1, (np.inf, [])), option)
            reach = wider
        cost, ts = reach[radius + 1]
        if cost < best[0]:
            best = (cost, [(sum(1 << (63 - b) for b in g), [1 << (63 - b) for b in g], t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def flips(singles: list[int], t: int) -> np.ndarray:
    """Masks that flip at most t bits of a partition; the first flips none."""
    out = [0]
    for k in range(1, t + 1):
        for c in combinations(singles, k):
            out.append(sum(c))
    return np.asarray(out, np.uint64)


class Forest:
    """Union-find over row numbers that keeps only links between different trees, the closest first."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def flatten(self) -> np.ndarray:
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]
        return self.up

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which links join different trees."""
        tree = self.flatten()
        return tree[a] != tree[b]

    def add(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        tree = self.flatten()
        order = np.argsort(far, kind="stable")
        a, b = a[order], b[order]
        low, high = np.minimum(tree[a], tree[b]), np.maximum(tree[a], tree[b])
        first = np.sort(np.unique(low * len(tree) + high, return_index=True)[1])  # one link for two trees
        for x, y in zip(a[first].tolist(), b[first].tolist()):
            rx, ry = self.root(x), self.root(y)
            if rx != ry:
                self.up[max(rx, ry)] = min(rx, ry)
                self.kept.append((x, y))


def verified_links(fps: np.ndarray, sizes: np.ndarray, home: np.ndarray, new: np.ndarray, forest: Forest, most: int, share: float) -> None:
    """Add to the forest the links of `home` rows with `new` rows: at most `most` differing bits and sizes within `share`.

    Pairs that differ in a third of `most` bits at most are joined at once; the others wait and are joined closest first.
    """
    share = max(share - 1e-9, 1e-9)
    home, new = home[np.argsort(sizes[home], kind="stable")], new[np.argsort(sizes[new], kind="stable")]
    waiting, size, sorted_sizes = [], 0, sizes[new]
    step = max(1, PAIRS // max(1, len(new)))

    def settle() -> None:
        nonlocal waiting, size
        if waiting:
            forest.add(*(np.concatenate(x) for x in zip(*waiting)))
        waiting, size = [], 0

    for k in range(0, len(home), step):
        rows = home[k : k + step]
        lo = int(np.searchsorted(sorted_sizes, sizes[rows[0]] * share, side="left"))
        hi = int(np.searchsorted(sorted_sizes, sizes[rows[-1]] / share, side="right"))
        far = np.zeros((len(rows), hi - lo), np.uint8 if fps.shape[1] < 4 else np.uint16)
        for word in fps.T:
            far += np.bitwise_count(word[rows][:, None] ^ word[new[lo:hi]][None, :])
        a, b = np.nonzero(far <= most)
        far, a, b = far[a, b], rows[a], new[lo:hi][b]
        fit = np.minimum(sizes[a], sizes[b]) >= share * np.maximum(sizes[a], sizes[b])
        keep = fit & forest.apart(a, b)
        a, b, far = a[keep], b[keep], far[keep]
        near = far * 3 <= most
        forest.add(a[near], b[near], far[near])
        waiting.append((a[~near], b[~near], far[~near]))
        size += len(waiting[-1][0])
        if size > PAIRS:
            settle()
    settle()


def links(nodes: DataFrame, radius: int, words: int = 1, most: int | None = None, share: float = 0.0) -> DataFrame:
    """Links (a, b) between nodes that span, in every value's task, the groups of linked fingerprints.

    nodes: (node, fp, n), a binary id of 16 bytes, a fingerprint of `words` 64-bit words, a size. Two nodes meet if any of
    their words are within the radius; they are linked if all bits differ in at most `most` (the radius where None) and
    the smaller size is at least `share` of the larger.
    """
    most = radius if most is None else most
    n = row_count(nodes)
    every = max(1, n // SAMPLE)
    drawn = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE).collect()
    sample = np.frombuffer(b"".join(bytes(r.fp) for r in drawn) or bytes(8 * words), ">u8").astype(np.uint64).reshape(-1, words)
    plan = [(w, np.uint64(mask), flips(singles, t)) for w in range(words) for mask, singles, t in search_plan(sample[:, w], max(n, 1000), radius)]
    width = 16 + 8 * words + 4 + 1

    def keys_of(fps: np.ndarray, i: int, probes: int | None = None) -> np.ndarray:
        """The values that fingerprints probe in partition i, the first their own."""
        w, mask, change = plan[i]
        return mixed(((fps[:, w] & mask)[:, None] ^ change[None, :probes]) ^ mixed(np.asarray([i], np.uint64), 1), 2)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return byte_rows(batch.column(1), 8 * words).view(">u8").astype(np.uint64), batch.column(2).to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        held: dict[int, int] = {}
        for batch in batches:
            fps, _ = read(batch)
            for i in range(len(plan)):
                own, times = np.unique(keys_of(fps, i, 1), return_counts=True)
                for k, c in zip(own.tolist(), times.tolist()):
                    held[k] = held.get(k, 0) + c
            if len(held) > 500_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(list(held), np.uint64).view(np.int64)), pa.array(list(held.values()), pa.int64())], ["key", "n"])

    # Values that many nodes share: as many at most as the bound on their size lets there be.
    least = max(HEAVY, n * len(plan) // MOST_HEAVY)
    heavy = nodes.select("node", "fp", "n").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    heavy = sorted((r.key % (1 << 64), -(-r.n // least)) for r in heavy)
    heavy_keys, grids = np.asarray([k for k, _ in heavy], np.uint64), np.asarray([g for _, g in heavy], np.int64)

    def placed(key: np.ndarray, who: np.ndarray, home: np.ndarray, own: np.ndarray):
        """Rows (key, node, flag) of the tasks that a value's rows go to. flag 0: at home and met, 1: at home only, 2: met only."""
        at = np.searchsorted(heavy_keys, key) if len(heavy_keys) else np.zeros(len(key), np.int64)
        hot = (heavy_keys[np.minimum(at, len(heavy_keys) - 1)] == key) if len(heavy_keys) else np.zeros(len(key), bool)
        yield key[~hot], who[~hot], np.where(home[~hot], 0, 2).astype(np.uint8)
        for k in np.unique(at[hot]).tolist():
            side, rows = int(grids[k]), np.flatnonzero(hot & (at == k))
            group = (own[who[rows]] % np.uint64(side)).astype(np.int64)
            for i in range(side):
                for j in range(side):
                    here, met = home[rows] & (group == i), group == j
                    some = here | met
                    cell = mixed(heavy_keys[k : k + 1] + np.uint64(i * side + j), 3)
                    flag = np.where(here[some] & met[some], 0, np.where(here[some], 1, 2)).astype(np.uint8)
                    yield np.repeat(cell, some.sum()), who[rows[some]], flag

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                node, (fps, sizes) = byte_rows(part.column(0), 16), read(part)
                base = np.concatenate([node, fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), sizes.astype("<i4").view(np.uint8).reshape(-1, 4), np.zeros((len(fps), 1), np.uint8)], axis=1)
                own = mixed(np.ascontiguousarray(node[:, :8]).view(np.uint64)[:, 0], 1)
                for i in range(len(plan)):
                    key = keys_of(fps, i)
                    who = np.repeat(np.arange(len(fps)), key.shape[1])
                    home = np.tile(np.arange(key.shape[1]) == 0, len(fps))
                    for k, w, flag in placed(key.ravel(), who, home, own):
                        if len(k):
                            rows = base[w]
                            rows[:, -1] = flag
                            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(flag.astype(np.int32)), binary_array(rows)], ["key", "flag", "row"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by value, those at home first, so no more than these are held."""
        worker_state()
        now, homes, up = None, np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
        for batch in batches:
            key, flag, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), byte_rows(batch.column(2), width)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            pairs = []
            for s, e in zip(cuts, cuts[1:]):
                if key[s] != now:
                    now, homes, up = key[s], homes[:0], up[:0]
                mine = flag[s:e]
                if not len(homes) and (mine[0] == 2 or e - s < 2):
                    if mine[0] != 2:
                        homes, up = rows[s:e], np.arange(e - s)
                    continue
                # held homes, then this batch's rows: homes first
                all_, held, more = np.concatenate([homes, rows[s:e]]), len(homes), int((mine != 2).sum())
                forest = Forest(len(all_))
                forest.up[:held] = up
                fps = np.ascontiguousarray(all_[:, 16:-5]).view(">u8").astype(np.uint64)
                sizes = np.ascontiguousarray(all_[:, -5:-1]).view("<i4")[:, 0].astype(np.int64)
                met = held + np.flatnonzero(mine != 1)
                verified_links(fps, sizes, np.arange(held + more), met, forest, most, share)
                if held and more:  # homes held before meet those of this batch from the other side too
                    back = np.flatnonzero(all_[:held, -1] != 1)
                    verified_links(fps, sizes, np.arange(held, held + more), back, forest, most, share)
                for a, b in forest.kept:
                    x, y = all_[a, :16].tobytes(), all_[b, :16].tobytes()
                    pairs.append((min(x, y), max(x, y)))
                tree = forest.flatten()
                homes = all_[: held + more]
                # A home whose tree has its root elsewhere takes the first home of that tree.
                first = np.full(len(all_), len(all_))
                np.minimum.at(first, tree[: held + more], np.arange(held + more))
                up = first[tree[: held + more]]
            a, b = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    spread = nodes.select("node", "fp", "n").repartition(4 * nodes.sparkSession.sparkContext.defaultParallelism)  # a row becomes many
    probes = spread.mapInArrow(probe, "key long, flag int, row binary")
    dealt = probes.repartition("key").sortWithinPartitions("key", "flag")
    return dealt.mapInArrow(verify, "a binary, b binary").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with at most one link a node and partition, to the smallest node that the partition joins it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        def out() -> pa.RecordBatch:
            found = [(root(x), x) for x in list(up) if root(x) != x]
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
            if len(up) > 2 * SETTLED + 100_000:
                yield out()
                up.clear()
        yield out()

    return edges.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node of the component of every node that has a link.

    Links contract inside partitions, then large-star and small-star steps alternate until at most SETTLED links are left, which
    one task joins (few links need no rounds at all). Each round is written to the shared folder, which cuts lineage.
    Smallest neighbours are written too, so that a join with a node of very many links has plain shuffles on both
    sides, which Spark splits where they are skewed.
    """
    edges = written(contracted(edges), name)
    before = None
    while (n := row_count(edges)) > SETTLED:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select("m", "a").where("a <> m").union(small.select("m", "b")).toDF("a", "b").distinct()
        edges = written(small, name)
        now = (n, *edges.agg(F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        edges = written(contracted(edges.coalesce(1)), name)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def grouped_rows(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of prints with component_id, the smallest id of their component.

    prints: (id, node, ...); nodes: (node, first: its smallest id, ...).
    """
    roots = components(edges)
    linked = written(nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    smallest = written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = linked.join(smallest, "root").select("node", "component_id")
    return prints.join(named, "node")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of (doc_id, text): fingerprints of 64 bits that link within the radius."""
    prints = written(fingerprints(docs, width), "fingerprints").withColumn("node", F.concat("fp", "fp"))
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.lit(1).alias("n"), F.min("doc_id").alias("first")), "nodes")
    return grouped_rows(prints, nodes, links(nodes, radius)).select("doc_id", "fp", "component_id")


def expected_share(similarity: float) -> float:
    """Share of bits in which two sets of that resemblance, of equal sizes, are expected to differ."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, words: int = 2, radius: int = 12) -> DataFrame:
    """id_col, component_id for every row: groups of texts linked by a resemblance of their shingle sets of `similarity` or more.

    Ids may be of any type that has an order. Candidates are within `radius` bits in one of `words` 64-bit words (0.97 of the
    pairs at 0.8, more above) and within four standard deviations of the expected number over all words; each link
    is verified on the whole sets. In a value's task, candidates are joined closest first and only links between different trees
    go on to that check; groups in which it refutes one are searched again by `settled_links`.
    """
    share, bits = expected_share(similarity), 64 * words
    most = int(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        hasher = Hasher(width)
        for batch in batches:
            for part in chunks(batch, "text", 1_000_000):
                sets, digests = shingle_sets(as_bytes(part.column(1)), hasher)
                n = pa.array([len(x) for x in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), binary_array(digests), n, binary_array(majority_bits(sets, words))], ["id", "t", "node", "n", "fp"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        hasher = Hasher(width)
        for batch in batches:
            for part in chunks(batch, "text", 1_000_000):
                sets, digests = shingle_sets(as_bytes(part.column(0)), hasher)
                yield pa.RecordBatch.from_arrays([binary_array(digests), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "hashes"])

    prints = written(rows.mapInArrow(sketched, f"id {kind}, t binary, node binary, n int, fp binary"), "shingle-prints")
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min("id").alias("first"), F.min("t").alias("t")), "shingle-nodes")
    found = written(links(nodes, radius, words, most, similarity), "candidates")
    asked = nodes.join(found.select(F.col("a").alias("node")).union(found.select("b")).distinct(), "node", "left_semi").select("t")
    texts = rows.groupBy("t").agg(F.first("text").alias("text")).join(asked, "t", "left_semi").select("text")
    sets = written(texts.mapInArrow(gathered, "node binary, hashes array<long>"), "shingle-sets")
    pairs = found.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    alike = both >= F.lit(similarity - 1e-9) * (F.size("x") + F.size("y") - both)
    checked = written(pairs.select("a", "b", alike.alias("alike")), "checked")
    edges = checked.where("alike").select("a", "b")
    if not checked.where("not alike").isEmpty():
        edges = written(edges.union(settled_links(nodes, sets, checked, words, most, similarity)), "verified")
    return grouped_rows(prints, nodes, edges).select(F.col("id").alias(id_col), "component_id")


def settled_links(nodes: DataFrame, sets: DataFrame, checked: DataFrame, words: int, most: int, similarity: float) -> DataFrame:
    """Further links (a, b) between nodes of groups of candidates in which a link was refuted.

    nodes: (node, fp, n); sets: (node, hashes); checked: candidates (a, b, alike). All pairs of such a group that are within the bits
    and not yet joined are held against the sets, closest first, in a grid of blocks of about SET_HASHES hashes.
    """
    groups = written(components(checked.select("a", "b"), "candidate-groups"), "candidate-groups")
    again = groups.join(checked.where("not alike").select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct()
    trees = components(checked.where("alike").select("a", "b"), "verified-trees").withColumnRenamed("root", "tree")
    rows = groups.join(again, "root", "left_semi").join(nodes.select("node", "fp", "n"), "node").join(trees, "node", "left")
    rows = written(rows.select("root", "node", F.coalesce("tree", "node").alias("tree"), "fp", "n"), "again")
    sides = rows.groupBy("root").agg(F.ceil(F.sum(F.greatest("n", F.lit(100))) / SET_HASHES).cast("int").alias("side"))
    own = F.pmod(F.xxhash64("node"), F.col("side")).cast("int")
    dealt = rows.join(sides, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    cells = dealt.select(F.concat_ws("-", F.hex("root"), F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") > F.col("other")).alias("late"), (F.col("own") == F.col("other")).alias("inner"), "node", "tree", "fp")
    cells = cells.join(sets, "node").select("cell", "late", "inner", "node", "tree", "fp", "hashes")

    def settle(part: pa.Table) -> pa.Table:
        """Rows of one cell: those of a block and of another (late), or of one block alone (inner)."""
        node, tree = part.column("node").to_pylist(), part.column("tree").to_pylist()
        fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
        hashes = [np.asarray(x) for x in part.column("hashes").to_numpy()]
        late, inner = part.column("late").to_numpy(), part.column("inner").to_numpy()[0]
        forest = Forest(len(node))
        first: dict[bytes, int] = {}
        forest.up = np.array([first.setdefault(t, i) for i, t in enumerate(tree)])
        left, right = (np.arange(len(node)), np.arange(len(node))) if inner else (np.flatnonzero(~late), np.flatnonzero(late))
        out, step = [], max(1, PAIRS // max(1, len(right)))
        for k in range(0, len(left), step):
            rows_ = left[k : k + step]
            far = np.zeros((len(rows_), len(right)), np.uint16)
            for word in fps.T:
                far += np.bitwise_count(word[rows_][:, None] ^ word[right][None, :])
            a, b = np.nonzero(far <= most)
            far, a, b = far[a, b], rows_[a], right[b]
            keep = (a < b if inner else a != b) & forest.apart(a, b)
            order = np.argsort(far[keep], kind="stable")
            for x, y in zip(a[keep][order].tolist(), b[keep][order].tolist()):
                rx, ry = forest.root(x), forest.root(y)
                if rx != ry:
                    u, v = hashes[x], hashes[y]
                    if min(len(u), len(v)) < (similarity - 1e-9) * max(len(u), len(v)):
                        continue
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    if both >= (similarity - 1e-9) * (len(u) + len(v) - both):
                        forest.up[max(rx, ry)] = min(rx, ry)
                        out.append((min(node[x], node[y]), max(node[x], node[y])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return cells.groupBy("cell").applyInArrow(settle, "a binary, b binary")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
