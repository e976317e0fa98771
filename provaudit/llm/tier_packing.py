"""Hierarchical packing into sequences of several lengths.

Contexts come in tiers of powers of two up to the window. A document gives whole windows while it fills them; what is left
goes to the shortest tier that holds it. Tiers are packed from the longest down, on the histogram of lengths alone: the
longest document left opens a sequence of its tier, and a bitset subset-sum over the documents of shorter tiers (and
of its own, where they fit) finds what fills its gap. Where no whole documents fill the gap, documents are cut: a cut
document falls into the powers of two of its length, longest first, and these parts fill gaps of any size. Parts that
no gap takes make up sequences among themselves. So every sequence is full, and every length is a power of two.

A document's cuts depend on its length alone, so checksums of the whole and of its parts are made where it is tokenised, and neither
ids nor texts move again. Ranks within a length come from blocks, as in `packing`. Sequences are dealt in turn, the longest first,
to step groups of about `step_tokens` tokens, so groups differ by a window at most and each has its share of every tier.

NULL and empty texts become the end mark alone; an empty table packs to no rows. Very long texts give many windows. Repeated rows are packed like
others; the number that each piece got in its task tells them apart. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provaudit.llm.common import as_bytes, chunks, keyed, table, written
from provaudit.llm.packing import ByteCodec, fullest, length_counts, ranked
from provaudit.llm.vocabulary import packed_ids, per_worker

END_ID = 1
WINDOW = 2048
#: The shortest tier, parts of cut documents in one sequence at most, and tokens of a step group aimed at.
SHORTEST_TIER = 256
MOST_PARTS = 16
STEP_TOKENS = 64 * 2048
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<long>"


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def whole_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Windows of each document and what is left of it, with the checksums of its parts; `salt` numbers the pieces of a task."""
    end = packed_ids([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, made = per_worker(ByteCodec, vocabulary), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), codec.encode(as_bytes(part.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        own = ids[4 * start : 4 * (start + window)]
                        length, at, parts = len(own) // 4, 0, []
                        for size in powers(length):
                            parts.append(zlib.crc32(own[4 * at : 4 * (at + size)]))
                            at += size
                        rows.append((doc_id, start, length, parts[0] if len(parts) == 1 else zlib.crc32(own), n, parts))
                kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
                salt = pa.array(np.arange(made, made + len(rows)))
                made += len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), salt], [*NAMES, "salt"])

    return keyed(docs).mapInArrow(run, PIECES + ", salt long")


@dataclass
class Plan:
    """Runs of sequences of one make.

    whole: (length, first rank, pieces a sequence, first sequence, offset); cut: (length, first rank, number of the first part
    of each size); pool: (size, number of the first part, parts a sequence, first sequence, offset); runs: (tokens, first sequence, sequences).
    """

    window: int
    shortest: int
    whole: list[tuple] = field(default_factory=list)
    cut: list[tuple] = field(default_factory=list)
    pool: list[tuple] = field(default_factory=list)
    runs: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        sizes = powers(2 * self.window - 1)
        self.made, self.used, self.sequences = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0), 0

    def fill(self, gap: int) -> dict[int, int] | None:
        """Parts at hand that add up to the gap, if few do."""
        out = {}
        for size in self.made:
            if n := min(self.made[size] - self.used[size], gap // size):
                out[size] = n
                gap -= n * size
        return out if not gap and sum(out.values()) <= MOST_PARTS else None

    def add(self, tokens: int, times: int, pieces: list[tuple[int, int, int]], parts: list[tuple[int, int]]) -> None:
        """`times` sequences, each of these pieces (length, first rank, number) and parts (size, number)."""
        offset = 0
        for length, rank, n in pieces:
            self.whole.append((length, rank, n, self.sequences, offset))
            offset += length * n
        for size, n in parts:
            self.pool.append((size, self.used[size], n, self.sequences, offset))
            self.used[size] += n * times
            offset += size * n
        self.runs.append((tokens, self.sequences, times))
        self.sequences += times

    def rest(self) -> None:
        """Sequences of the parts that are left: windows, then the powers of two of what remains."""
        total = sum(size * (n - self.used[size]) for size, n in self.made.items())
        rooms = [(self.window, total // self.window), *((size, 1) for size in powers(total % self.window))]
        for room, times in rooms:
            while times:
                parts, left = [], room
                for size in self.made:  # the largest first, so a room is always filled exactly
                    if n := min(self.made[size] - self.used[size], left // size):
                        parts.append((size, n))
                        left -= n * size
                same = min([times, *((self.made[size] - self.used[size]) // n for size, n in parts)])
                self.add(room, same, [], parts)
                times -= same


def planned(histogram: dict[int, int], window: int = WINDOW, shortest: int = SHORTEST_TIER) -> Plan:
    """All sequences from the number of pieces of each length."""
    plan, left = Plan(window, shortest), {x: n for x, n in histogram.items() if n}
    at = dict.fromkeys(left, 0)
    while left:
        longest = max(left)
        tier = min(window, max(shortest, 1 << (longest - 1).bit_length()))
        used = fullest(left, tier)
        slack = tier - sum(length * n for length, n in used.items())
        parts = plan.fill(slack)
        if parts is None:
            # So many that their tokens could fill the gaps of the others.
            cut = -(-left[longest] * slack // (longest + slack))
            plan.cut.append((longest, at[longest], *[plan.made[size] for size in plan.made]))
            for size in powers(longest):
                plan.made[size] += cut
            at[longest] += cut
            left[longest] -= cut
        else:
            times = min([left[x] // n for x, n in used.items()] + [(plan.made[s] - plan.used[s]) // n for s, n in parts.items()])
            plan.add(tier, times, [(x, at[x], n) for x, n in sorted(used.items(), reverse=True)], list(parts.items()))
            for x, n in used.items():
                at[x] += n * times
                left[x] -= n * times
        left = {x: n for x, n in left.items() if n}
    plan.rest()
    return plan


class Places:
    """A plan as sorted arrays, for looking up where pieces go."""

    def __init__(self, plan: Plan, step_tokens: int = STEP_TOKENS):
        array = lambda rows, width: np.asarray(sorted(rows), np.int64).reshape(-1, width)
        self.sizes = list(plan.made)
        self.whole, self.cut, self.pool = array(plan.whole, 5), array(plan.cut, 2 + len(self.sizes)), array(plan.pool, 5)
        self.runs = np.asarray(plan.runs, np.int64).reshape(-1, 3)
        order = np.argsort(-self.runs[:, 0], kind="stable")
        self.turn = np.empty(len(order), np.int64)
        self.turn[order] = np.cumsum(self.runs[order, 2]) - self.runs[order, 2]
        self.groups = max(1, -(-int((self.runs[:, 0] * self.runs[:, 2]).sum()) // step_tokens))

    def found(self, rows: np.ndarray, kind: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Row of `rows` whose first number is the last at or below this one; -1 if it has another kind."""
        if not len(rows):
            return np.full(len(kind), -1)
        at = np.searchsorted(rows[:, 0] << 50 | rows[:, 1], kind << 50 | number, side="right") - 1
        return np.where((at >= 0) & (rows[at, 0] == kind), at, -1)

    def placed(self, rows: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset)."""
        kind, first, each, sequence, offset = rows[at].T
        nth = number - first
        return sequence + nth // each, offset + nth % each * kind

    def sequence(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of the sequence, its step group)."""
        at = np.searchsorted(self.runs[:, 1], number, side="right") - 1
        return self.runs[at, 0], (self.turn[at] + number - self.runs[at, 1]) % self.groups

    def pieces(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple]:
        """(rows, start in the row's piece, length, index of the part or -1 for the whole, sequence, offset)."""
        whole, cut = self.found(self.whole, length, rank), self.found(self.cut, length, rank)
        first = lambda rows, at: np.where(at >= 0, rows[at, 1] if len(rows) else 0, -1)
        is_cut = first(self.cut, cut) > first(self.whole, whole)
        own = np.flatnonzero(~is_cut)
        yield own, np.zeros(len(own), np.int64), length[own], np.full(len(own), -1), *self.placed(self.whole, whole[own], rank[own])
        for i, size in enumerate(self.sizes):
            own = np.flatnonzero(is_cut & (length & size > 0))
            if len(own):
                number = self.cut[cut[own], 2 + i] + rank[own] - self.cut[cut[own], 1]
                start = length[own] & ~(2 * size - 1)
                kind = np.full(len(own), size)
                yield own, start, kind, np.bitwise_count(start), *self.placed(self.pool, self.found(self.pool, kind, number), number)


def tier_packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, shortest: int = SHORTEST_TIER, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece with its place, the length of its sequence and the step group of that."""
    cut = written(whole_pieces(docs, vocabulary, window, end_id), "pieces")
    histogram = length_counts(cut)
    places = cut.sparkSession.sparkContext.broadcast(Places(planned(histogram, window, shortest), step_tokens))
    pieces = ranked(cut, histogram, NAMES, ["doc_id", "start", "ids_crc32", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            start, length, crc, tokens, rank = (batch.column(i).to_numpy() for i in (1, 2, 3, 4, 6))
            parts = batch.column(5)
            flat, first = parts.flatten().to_numpy(), np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
            for own, at, size, which, sequence, offset in p.pieces(length, rank):
                if len(own):
                    sums = np.where(which < 0, crc[own], flat[first[own] + np.maximum(which, 0)])
                    columns = [batch.column(0).take(pa.array(own)), start[own] + at, size, sums, tokens[own], sequence, offset, *p.sequence(sequence)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in placed_schema.split(", ")])

    placed_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return pieces.mapInArrow(run, placed_schema)


def op12_tier_packing(spark, sf_dir: str) -> DataFrame:
    return tier_packed(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
