"""Tokenizer files and per-worker caches.

Nothing here trains a tokenizer: the file's name or path is a parameter, found by each worker on its own machine.
A worker keeps what it has encoded in dictionaries bounded in bytes: long strings are never kept, and a full dictionary
takes nothing more until it is trimmed to the entries inserted first, as frequent strings come first.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import regex

from provaudit.llm.common import worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Entries of one cache, those kept when it is trimmed, and the longest key kept (characters or bytes). Values are ids or
#: a few bytes for each byte of the key, so a cache stays below some 90 MB whatever the texts are.
CACHE_ENTRIES = 300_000
KEPT_ENTRIES = 200_000
LONGEST_KEY = 64

#: The pre-token patterns of the two vocabulary files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
BYTE_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The same for ASCII text as bytes.
ASCII_PATTERN = re.compile(rb"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def default_path(name: str) -> str:
    """The file of a public vocabulary on this machine; anything with a folder in it is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """A bounded cache that computes what it lacks; a full one keeps nothing new until it is trimmed."""

    def __init__(self, compute, size=len):
        super().__init__()
        self.compute, self.size = compute, size

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < CACHE_ENTRIES and self.size(key) <= LONGEST_KEY:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) >= CACHE_ENTRIES:
            while len(self) > KEPT_ENTRIES:  # the last come out first
                self.popitem()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in set(shown):
            table[b] = chr(b)
        else:
            table[b] = chr(0x100 + extra)
            extra += 1
    return table


class VocabularyFile:
    """A tokenizer JSON file: vocabulary, merges and special strings."""

    def __init__(self, name: str):
        with open(default_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def merger(self, suffix: bool):
        """A function from bytes to token ids: the library's merge loop alone, without any splitting."""
        from tokenizers import models

        marks = {"end_of_word_suffix": self.suffix} if suffix and self.suffix else {}
        model = models.BPE(vocab=self.vocab, merges=self.merges, **marks)
        shown = dict(enumerate(byte_characters()))
        return lambda raw: [t.id for t in model.tokenize(raw.decode("latin-1").translate(shown))] if raw else []


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def per_worker(kind: type, name: str):
    """One instance of a codec for each Python worker, kept between tasks until another operator runs there."""
    return worker_state((kind, name), lambda: kind(name))
