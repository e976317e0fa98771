"""Best-fit packing by minimum bin slack.

Documents become token sequences; longer ones are cut into pieces of at most `capacity` tokens. Pieces of equal
length are interchangeable, so bins are planned on the histogram of lengths alone (at most `capacity` rows): the
largest remaining length opens a bin, a bitset subset-sum over the remaining lengths finds the fullest feasible
combination, and that combination is removed as often as the histogram holds it. Each piece then finds its place
from its rank among the pieces of its length; ranks come from windows over hashed blocks of a length plus
the blocks' offsets, so a length that a third of all pieces have is still spread over many tasks.

NULL and empty texts become the end mark alone; an empty table packs to no rows. Very long texts are cut into pieces of
`capacity` tokens, the first of them shorter. Repeated rows are packed like others; they are the same piece in every
column, so which copy lies where does not matter; the number that each piece got in its task spreads them. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provaudit.llm.common import as_bytes, chunks, keyed, table, written
from provaudit.llm.vocabulary import ASCII_PATTERN, BYTE_PATTERN, Memo, VocabularyFile, packed_ids, per_worker

END_ID = 2
CAPACITY = 1024
#: Pieces of one length ranked in one task, and the most blocks of a length (beyond, blocks grow).
ROWS_PER_BLOCK = 500
MOST_BLOCKS = 20_000
#: White space that is not a lone space or line feed between words (or may be: first bytes suffice).
ODD_SPACE = [b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\x0b", b"\x0c", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
EDGES = (b"", b" ", b"\n")
#: Words that are letters for certain, whatever the version of Unicode.
LATIN_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
MARKS = b".,;:!?"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class ByteCodec:
    """Ids of a byte-level vocabulary, cached by word.

    A single space or line feed between two non-white characters always ends a pre-token, so the parts between
    them can be encoded one by one. Texts with other white space or special strings are cut at such spaces only.
    """

    def __init__(self, name: str):
        f = VocabularyFile(name)
        self.file, self.merge = f, f.merger(False)
        self.pattern = regex.compile(BYTE_PATTERN)
        self.safe = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")
        self.special = {k: packed_ids([v]) for k, v in f.special.items()}
        self.marks = [*ODD_SPACE, *(k.encode() for k in self.special)]
        self.words = Memo(lambda w: packed_ids(self.merge(w)))
        self.first = Memo(self.part)
        self.inner = Memo(self.after_space)
        self.line_end = self.part(b"\n")

    def part(self, part: bytes) -> bytes:
        """A part of a text that is complete in pre-tokens."""
        words = self.words
        if part.isascii():
            return b"".join([words[w] for w in ASCII_PATTERN.findall(part)])
        return b"".join([words[w.encode()] for w in self.pattern.findall(part.decode("utf-8", "replace"))])

    def after_space(self, word: bytes) -> bytes:
        mark = word[-1:] if word[-1:] in MARKS else b""
        stem = word[:-1] if mark else word
        if stem.isalpha() or not stem.isascii() and LATIN_LETTERS.fullmatch(stem.decode("utf-8", "replace")):
            return self.words[b" " + stem] + self.words[mark] if mark else self.words[b" " + stem]
        return self.part(b" " + word)

    def odd_text(self, text: bytes) -> bytes:
        """Any text: special strings, then cuts before single spaces."""
        out, at, s = [], 0, text.decode("utf-8", "replace")
        for m in [*self.file.special_pattern.finditer(s), None]:
            stop = m.start() if m else len(s)
            out += [self.first[p.encode()] for p in self.safe.split(s[at:stop]) if p]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        get, first = self.inner.__getitem__, self.first
        for t in texts:
            if t[:1] in EDGES or t[-1:] in EDGES or any([k in t for k in self.marks]):
                yield self.odd_text(t)
            else:
                lines = []
                for line in t.split(b"\n"):
                    head, *rest = line.split(b" ")
                    lines.append(first[head] + b"".join(map(get, rest)))
                yield self.line_end.join(lines)
        for cache in (self.words, self.inner, self.first):
            cache.trim()


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise every text, add the end mark and cut what is longer than `capacity`; the first piece may be shorter.

    `salt` numbers the pieces of a task, so that rows equal in all else can be told apart and spread.
    """
    end = packed_ids([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, made = per_worker(ByteCodec, vocabulary), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), codec.encode(as_bytes(part.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                salt = pa.array(np.arange(made, made + len(rows)))
                made += len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), salt], [*NAMES, "salt"])

    return keyed(docs).mapInArrow(run, PIECES + ", salt long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest remaining length and the combination of others that leaves the least slack beside it."""
    largest = max(counts)
    room, steps, reach = capacity - largest, [], 1
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length] - (length == largest), room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    used, at = {largest: 1}, reach.bit_length() - 1
    for length, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + 1
            at -= length
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of bins of one combination, as arrays sorted by (length, first rank).

    A row says: pieces of `length` with ranks from `rank` on lie `each` to a bin in the bins from `bin` on, at `offset`.
    """
    left, at, bins, rows = dict(histogram), dict.fromkeys(histogram, 0), 0, []
    while left:
        used = fullest(left, capacity)
        times, offset = min(left[x] // n for x, n in used.items()), 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, at[length], n, bins, offset))
            offset += length * n
            at[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    table_ = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "bin", "offset"), table_.T))


def length_counts(cut: DataFrame) -> dict[int, int]:
    """Pieces of each length, which are no more than the capacity."""
    return {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def ranked(cut: DataFrame, histogram: dict[int, int], names: list[str], ties: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """`names` of the pieces and rank (from 0) among the pieces of the same length, in the order of blocks and `ties`."""
    # Each length has blocks of its own number, so that a frequent one is spread and a rare one keeps one block.
    sizes = cut.sparkSession.createDataFrame([(x, min(MOST_BLOCKS, -(-n // rows_per_block))) for x, n in histogram.items()], "length long, blocks long")
    cut = cut.join(F.broadcast(sizes), "length").withColumn("block", F.pmod(F.xxhash64(*ties), "blocks"))
    offsets = cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    offsets = offsets.select("length", "block", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy(*ties))
    out = cut.withColumn("within", within).join(offsets, ["length", "block"])
    return out.select(*names, (F.col("before") + F.col("within") - 1).alias("rank"))


def placed(cut: DataFrame, capacity: int = CAPACITY, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add sequence_id and offset to pieces (a table that is read, not recomputed, each time)."""
    histogram = length_counts(cut)
    plan = cut.sparkSession.sparkContext.broadcast(plan_bins(histogram, capacity))
    pieces_ = ranked(cut, histogram, NAMES, ["doc_id", "piece", "start", "ids_crc32", "salt"], rows_per_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        firsts = p["length"] * (1 << 50) + p["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            k = np.searchsorted(firsts, length * (1 << 50) + rank, side="right") - 1
            nth = rank - p["rank"][k]
            seq, offset = p["bin"][k] + nth // p["each"][k], p["offset"][k] + nth % p["each"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return pieces_.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its place in a sequence of at most `capacity` tokens."""
    return placed(written(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
