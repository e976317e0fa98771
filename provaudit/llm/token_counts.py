"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of the token lengths of frequent pre-tokens, broadcast once: their strings in one Arrow array,
their lengths as 16-bit integers. Every pre-token is looked up there first. Tier two serves the misses: each
worker's own bounded cache, filled by encoding. No pre-token is ever shuffled.

The table only saves time: counts do not depend on it. It is therefore learned from about `sample_docs` rows drawn at
random from all partitions; each partition gives the `PARTITION_WORDS` most frequent pre-tokens of its share, and the table
holds `table_size` entries at most, so what the driver gathers and broadcasts is bounded.

NULL and empty texts count no tokens. A very long text is read in parts that end at white space, which no pre-token crosses. Repeated
rows are returned as often as they come; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from provaudit.llm.bpe_codec import lowered
from provaudit.llm.common import as_bytes, chunks, keyed, row_count, table
from provaudit.llm.vocabulary import WORD_PATTERN, Memo, VocabularyFile, per_worker

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SAMPLE_DOCS = 4_000
TABLE_SIZE = 50_000
PARTITION_WORDS = 5_000
#: Bytes of text whose pre-tokens are held at once.
PART = 1_000_000
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def parts(text: bytes, most: int = PART) -> Iterator[bytes]:
    """A text in parts of about `most` bytes that end at ASCII white space."""
    at = 0
    while len(text) - at > most:
        cut = SPACE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class Frequent:
    """Tier one: pre-tokens and their lengths."""

    def __init__(self, words: list[str], lengths: list[int]):
        self.words, self.lengths = pa.array(words, pa.string()), np.asarray(lengths, np.uint16)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of words, and the places of those that the table lacks."""
        at = pc.index_in(pa.array(words, pa.string()), value_set=self.words)
        found = at.fill_null(-1).to_numpy(zero_copy_only=False)
        miss = np.flatnonzero(found < 0)
        out = self.lengths[found].astype(np.int64) if len(self.lengths) else np.zeros(len(found), np.int64)
        return out, miss


class WordLengths:
    """Pre-tokens of texts, and tier two: the lengths of those that a worker has met."""

    def __init__(self, name: str):
        f = VocabularyFile(name)
        self.special, self.merge, self.pattern = f.special_pattern, f.merger(True), regex.compile(WORD_PATTERN)
        self.words = Memo(lambda w: len(self.merge(w.encode())))

    def pretokens(self, text: bytes) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings it holds."""
        s = text.decode("utf-8", "replace")
        pieces = self.special.split(s) if "<" in s else [s]
        if len(pieces) == 1:
            return self.pattern.findall(lowered(s)), 0
        return [w for p in pieces for w in self.pattern.findall(lowered(p))], len(pieces) - 1

    def count(self, texts: list[bytes], frequent: Frequent) -> np.ndarray:
        out, held, owner = np.zeros(len(texts), np.int64), [], []

        def settle():
            n, miss = frequent.look_up(held)
            words = self.words
            n[miss] = [words[held[i]] for i in miss.tolist()]
            np.add.at(out, np.repeat(*np.asarray(owner, np.int64).reshape(-1, 2).T), n)
            held.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in parts(text):
                words, special = self.pretokens(part)
                out[i] += special
                held += words
                owner.append((i, len(words)))
                size += len(part)
                if size > PART:
                    settle()
                    size = 0
        settle()
        self.words.trim()
        return out


def frequent_lengths(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> tuple[list[str], list[int]]:
    """The most frequent pre-tokens of a sample of rows, with their token lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = per_worker(WordLengths, vocabulary), Counter()
        for batch in batches:
            for text in as_bytes(batch.column(1)):
                for part in parts(text):
                    seen.update(codec.pretokens(part)[0])
        top = sorted(seen, key=lambda w: (-seen[w], w))[:PARTITION_WORDS]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([seen[w] for w in top], pa.int64()), pa.array([codec.words[w] for w in top], pa.int32())], ["word", "n", "length"])

    share = min(1.0, sample_docs / max(1, row_count(docs)))
    rows = keyed(docs).sample(share, 7).mapInArrow(run, "word string, n long, length int").toArrow()
    seen, length = Counter(), {}
    for w, n, k in zip(*(c.to_pylist() for c in rows.columns)):
        if k < 1 << 16:
            seen[w] += n
            length[w] = k
    top = sorted(seen, key=lambda w: (-seen[w], w))[:table_size]
    return top, [length[w] for w in top]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds `limit`, for every row of (doc_id, text)."""
    words, lengths = frequent_lengths(docs, vocabulary, sample_docs, table_size)
    compact = docs.sparkSession.sparkContext.broadcast(("\n".join(words), np.asarray(lengths, "<u2").tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(WordLengths, vocabulary)
        words, lengths = compact.value
        frequent = Frequent(words.split("\n") if words else [], np.frombuffer(lengths, "<u2"))
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = as_bytes(part.column(1))
                n = codec.count(texts, frequent)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return keyed(docs).mapInArrow(run, SCHEMA)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
