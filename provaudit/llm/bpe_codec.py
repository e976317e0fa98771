"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by any merge, so it marks a certain cut.
Every pre-token is cut there, the fragments are encoded independently (the last one with the word-end mark) and
their ids concatenated. Fragments repeat far more often than words, so a worker's caches serve most of them.

Work is a single map over the texts: no shuffle. A text is read in white-space separated pieces, which no
pre-token, normalisation or special string crosses. NULL and empty texts encode to no ids; very long texts are read
like others, and pieces too long for the caches are encoded each time. Repeated rows are returned as often as they come;
an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from provaudit.llm.common import as_bytes, chunks, keyed, table
from provaudit.llm.vocabulary import WORD_PATTERN, Memo, VocabularyFile, byte_characters, packed_ids, per_worker

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma has no special form)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordCodec:
    """Encoder and decoder for a lower-casing vocabulary with word ends.

    Three caches, each filled from the next: pieces of text, pre-tokens, fragments. A value is (ids, decoded).
    """

    def __init__(self, name: str):
        f = VocabularyFile(name)
        self.file, self.pattern = f, regex.compile(WORD_PATTERN)
        self.by_id = {i: t.encode() for t, i in [*f.vocab.items(), *f.special.items()]}
        self.merge = {False: f.merger(False), True: f.merger(True)}
        self.joined = self.pairs_inside_tokens()
        self.fragments = Memo(lambda key: self.value(self.merge[key[1]](key[0])), size=lambda key: len(key[0]))
        self.words = Memo(self.word)
        self.pieces = Memo(self.piece)

    def pairs_inside_tokens(self) -> bytes:
        """1 at a*256+b where byte b follows byte a inside some token."""
        code, table_ = {c: b for b, c in enumerate(byte_characters())}, bytearray(65536)
        for token in self.file.vocab:
            body = token.removesuffix(self.file.suffix)
            if all(c in code for c in body):
                raw = [code[c] for c in body]
                for a, b in zip(raw, raw[1:]):
                    table_[a * 256 + b] = 1
        return bytes(table_)

    def split(self, word: bytes) -> list[bytes]:
        """Fragments of a pre-token between forced boundaries."""
        joined, out, start = self.joined, [], 0
        for i, (a, b) in enumerate(zip(word, word[1:]), 1):
            if not joined[a * 256 + b]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def value(self, ids: list[int]) -> tuple[bytes, bytes]:
        return packed_ids(ids), b" ".join([self.by_id[i] for i in ids])

    @staticmethod
    def concatenated(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        return parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]))

    def word(self, word: str) -> tuple[bytes, bytes]:
        *inner, last = self.split(word.encode())
        return self.concatenated([*(self.fragments[x, False] for x in inner), self.fragments[last, True]])

    def piece(self, piece: bytes) -> tuple[bytes, bytes]:
        """A white-space separated piece of text, which may hold special strings."""
        parts, at, text = [], 0, piece.decode("utf-8", "replace")
        for m in self.file.special_pattern.finditer(text) if "<" in text else ():
            parts += [self.words[w] for w in self.pattern.findall(lowered(text[at : m.start()]))]
            parts.append(self.value([self.file.special[m[0]]]))
            at = m.end()
        return self.concatenated(parts + [self.words[w] for w in self.pattern.findall(lowered(text[at:]))])

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (little-endian, 4 bytes each) and its decoded text."""
        get = self.pieces.__getitem__
        for text in texts:
            found = [x for x in map(get, text.split()) if x[0]]
            yield b"".join([x[0] for x in found]), b" ".join([x[1] for x in found])
        for cache in (self.pieces, self.words, self.fragments):
            cache.trim()

    def decode(self, ids: Iterable[int]) -> str:
        return self.value([i for i in ids if i in self.by_id])[1].decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: str, outputs: str = "digest") -> DataFrame:
    """Encode and decode whole texts of (doc_id, text).

    outputs="digest": doc_id, n_tokens and SHA-256 of ids and decoded text; "full": doc_id, ids array, decoded.
    """
    digest = outputs == "digest"
    schema = SCHEMA if digest else "doc_id long, ids array<long>, decoded string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(WordCodec, vocabulary)
        for batch in batches:
            for part in chunks(batch, "text"):
                coded = codec.encode(as_bytes(part.column(1)))
                if digest:
                    rows = [(len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for a, b in coded]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                else:
                    rows = [(np.frombuffer(a, "<u4").astype(np.int64), b.decode("utf-8", "replace")) for a, b in coded]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.list_(pa.int64()), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return keyed(docs).mapInArrow(run, schema)


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
