"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's word shingles, sorted. Sketches merge by keeping the k
smallest of their union, so parts of a document, or documents of a corpus, can be sketched apart. From two
sketches come resemblance (Jaccard) and containment of their shingle sets, from one the number of
distinct shingles; a sketch of fewer than k hashes is the whole set and its estimates are exact.

Texts are lower-cased (A-Z) and split at ASCII white space; a text of fewer than `width` words is one shingle; one
without words (empty, NULL) has an empty sketch. Two empty sketches resemble and contain each other fully, an empty and a
non-empty one not at all. Very long texts are hashed alone. Repeated rows are returned as often as they come; an empty table
gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.llm.common import as_bytes, keyed, table

K = 128
WIDTH = 5
BLOCK_ROWS = 500
MOST_BLOCKS = 10_000
#: Bytes of text hashed at once; longer texts are hashed alone.
CHUNK = 1_000_000

#: An odd multiplier for word hashes, and a 64-bit finaliser (splitmix64).
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
INVERSE = pow(BASE, -1, 1 << 64)


def finalised(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % (1 << 64)
    return out


class Hasher:
    """Shingle hashes of many texts at once, vectorised over their bytes."""

    def __init__(self, width: int):
        self.width = width
        self.white = np.zeros(256, bool)
        self.white[[0x20, *range(0x09, 0x0E)]] = True
        self.up, self.down = powers(BASE, 1), powers(INVERSE, 1)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every word, and each text's number of words."""
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        if len(self.up) < len(data) + 1:
            self.up, self.down = powers(BASE, len(data) + 1), powers(INVERSE, len(data) + 1)
        white = self.white[data]
        before = np.concatenate(([True], white[:-1]))
        starts, ends = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))
        hashes = finalised((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        stops = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(starts, stops)
        return hashes, np.diff(upto, prepend=0)

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """Hashes of each text's shingles, repeats included."""
        with np.errstate(over="ignore"):
            words, n = self.words(texts)
            first = np.cumsum(n) - n
            runs, fold = {}, np.zeros(len(words), np.uint64)
            for length in range(1, self.width + 1):
                size = len(words) - length + 1
                if size <= 0:
                    break
                fold = finalised(fold[:size] * np.uint64(BASE) + words[length - 1 :])
                runs[length] = fold
        out = []
        for s, k in zip(first.tolist(), n.tolist()):
            out.append(runs[self.width][s : s + k - self.width + 1] if k >= self.width else runs[k][s : s + 1] if k else words[:0])
        return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all shingles of either."""
    union = np.union1d(a, b)
    if len(a) == k or len(b) == k:
        union = union[:k]
    if not len(union):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, common, assume_unique=True).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    both = r * distinct_shingles(merged(a, b, k), k)
    return min(1.0, both / distinct_shingles(a, k))


def spelled(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").astype(np.uint64)


def sketches(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, sketch (array of longs: bit patterns of the hashes, in unsigned order), n_distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        for batch in batches:
            for start, texts in grouped(as_bytes(batch.column(1))):
                found = [bottom(h, k) for h in hasher.shingles(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([distinct_shingles(s, k) for s in found])],
                    ["doc_id", "sketch", "n_distinct"],
                )

    return keyed(docs).mapInArrow(run, "doc_id long, sketch array<long>, n_distinct double")


def merge_sketches(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """Merge the sketches of each key: within partitions first, then over sorted keys, holding one sketch at a time.

    A hot key's rows shrink to one per partition before the shuffle, and no group is ever collected.
    """
    kind = parts.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.asarray(s or [], np.int64).view(np.uint64)
                held[x] = merged(held[x], now, k) if x in held else now
            if len(held) > 20_000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([s.view(np.int64) for s in held.values()], pa.list_(pa.int64()))], [key, "sketch"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict = {}
        for batch in batches:
            done: dict = {}
            for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.asarray(s or [], np.int64).view(np.uint64)
                if x not in open_:
                    done.update(open_)
                    open_ = {x: now}
                else:
                    open_[x] = merged(open_[x], now, k)
            if done:
                yield rows(done)
        if open_:
            yield rows(open_)

    schema = f"`{key}` {kind}, sketch array<long>"
    local = parts.select(key, "sketch").mapInArrow(fold, schema)
    return local.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(last, schema)


def grouped(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes, each with the place of its first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


class Blocks:
    """Blocks of rows in falling order of id, then rising order of text hash; the larger a block's number, the earlier it comes.

    cuts: ids at even steps through all rows. An id that spans several steps has as many blocks of its own, by text
    hash; NULL ids come last, in `nulls` blocks numbered below zero.
    """

    def __init__(self, cuts: list[int], nulls: int):
        values, times = np.unique(np.asarray(cuts, np.int64), return_counts=True)
        self.values, self.times, self.nulls = values, np.where(times > 1, times, 0), max(1, nulls)
        self.first = np.cumsum(self.times + 1) - self.times  # of an id's own blocks; the block below them holds what lies between cuts

    @staticmethod
    def share(h: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Which of `parts` equal ranges of 64-bit hashes each hash is in, the highest range first."""
        high = (h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return parts - 1 - (high.astype(np.int64) * parts >> 32)

    def of(self, ids: pa.Array, h: pa.Array) -> np.ndarray:
        x, hash_ = ids.fill_null(0).to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.values, x)
        block = np.concatenate((self.first, [self.first[-1] + self.times[-1] + 1 if len(self.first) else 1]))[at] - 1
        if len(self.values):
            near = np.minimum(at, len(self.values) - 1)
            own = (self.values[near] == x) & (self.times[near] > 0)
            block = np.where(own, self.first[near] + self.share(hash_, np.maximum(1, self.times[near])), block)
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        return np.where(missing, self.share(hash_, np.full(len(x), self.nulls)) - self.nulls, block)


def with_followers(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows sorted by descending doc_id inside blocks of about equal numbers of rows, each block ended by a ghost: the row after its last.

    Blocks are cut at quantiles of the ids, so order needs no global sort; at most MOST_BLOCKS quantiles and block heads (id
    and text hash) reach the driver. Ties of doc_id follow the text's hash, NULL ids come last. The last row of all is
    followed by the first. Only rows equal in both id and text cannot be dealt to several blocks.
    """
    docs = keyed(docs).withColumn("h", F.xxhash64("text"))
    n, known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    blocks = max(1, min(MOST_BLOCKS, n // block_rows))
    steps = [k / blocks for k in range(1, blocks)]
    cuts = docs.agg(F.percentile_approx("doc_id", steps, 4 * blocks)).first()[0] if known and steps else []
    plan = Blocks(cuts or [], -(-blocks * (n - known) // max(1, n)))

    @F.arrow_udf("long")
    def block(ids: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(plan.of(ids, h))

    docs = docs.withColumn("block", block("doc_id", "h"))
    heads = docs.groupBy("block").agg(F.max_by(F.struct("doc_id", "h"), F.struct("doc_id", -F.col("h").cast("decimal(20,0)"))).alias("head")).collect()
    order = sorted(((r.block, r.head.doc_id, r.head.h) for r in heads), reverse=True)
    ghosts = [(b, i, h, order[k - 1][0]) for k, (b, i, h) in enumerate(order)]
    ghosts = docs.sparkSession.createDataFrame(ghosts, "b long, head_id long, head_h long, previous long")
    own = docs.join(F.broadcast(ghosts), F.col("block") == F.col("b"), "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    places = F.array_compact(F.array(F.struct(F.col("block"), F.lit(False).alias("ghost")), F.when(is_head, F.struct(F.col("previous").alias("block"), F.lit(True).alias("ghost")))))
    dealt = own.select("doc_id", "text", "h", F.explode(places).alias("p")).select("doc_id", "text", "h", "p.block", "p.ghost")
    return dealt.repartition("block").sortWithinPartitions("block", "ghost", F.col("doc_id").desc_nulls_last(), "h")


def edited_pairs(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketch every text and its edit: its last third replaced by as much of the start of the next document's text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(width), []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (doc_id, text, block, ghost), each but the last followed by its next."""
            texts, edits, sizes = [r[1] for r in rows], [], []
            for (_, text, block, ghost), nxt in zip(rows, rows[1:]):
                if ghost:
                    edits.append(b"")
                    sizes.append(0)
                    continue
                s = text.decode("utf-8", "replace")
                cut = len(s) // 3
                edits.append((s[: len(s) - cut] + nxt[1][: 4 * cut].decode("utf-8", "ignore")[:cut]).encode())
                sizes.append(len(s))
            own = [bottom(h, k) for _, ts in grouped(texts) for h in hasher.shingles(ts)]
            new = [bottom(h, k) for _, ts in grouped(edits) for h in hasher.shingles(ts)]
            got = [
                (r[0], sizes[i], hashlib.sha256(edits[i]).hexdigest(), spelled(own[i]), spelled(new[i]), resemblance(own[i], new[i], k), resemblance(own[i], own[i + 1], k))
                for i, r in enumerate(rows[:-1])
                if not r[3]
            ]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * 7, kinds)], names)

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            size = 0
            for row in rows:
                held.append(row)
                size += len(row[1])
                if size > 4 * CHUNK:
                    yield out(held)
                    held, size = held[-1:], 0
        if len(held) > 1:
            yield out(held)

    return with_followers(docs).mapInArrow(run, schema)


def op2_bottom_k(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
