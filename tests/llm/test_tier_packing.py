"""Hierarchical packing: every id once, every sequence full, step groups even."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provaudit.llm import tier_packing as T
from provaudit.llm.vocabulary import default_path

VOCABULARY = "byte_bpe_50k.json"
ODD = ["", None, "one", "a  b\n\n c", " lead", "trail ", "it's <|endoftext|>ok y", "日本語 テスト😀😀 123 1,234.56", "same words here", "same words here", "lorem ipsum dolor sit amet " * 3000]


def histograms():
    rng = random.Random(3)
    yield {1100: 1000}
    yield {1: 5000}
    yield {2047: 7, 1025: 3, 3: 1}
    yield {2048: 12}
    yield {1024: 3, 512: 1}
    yield {n: 1 for n in range(1, 2049)}
    for _ in range(12):
        yield {rng.randint(1, 2048): rng.choice([1, 3, 50, 2_000]) for _ in range(rng.choice([1, 5, 60, 400]))}


@pytest.mark.parametrize("histogram", list(histograms()))
def test_plans_are_full_and_use_every_piece_once(histogram):
    places = T.Places(T.planned(histogram), 4 * 2048)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    spans, covered = defaultdict(list), np.zeros(len(length), np.int64)
    for own, start, size, which, sequence, offset in places.pieces(length, rank):
        assert ((start + size <= length[own]) & (size > 0)).all() and ((which >= 0) | (size == length[own])).all()
        covered[own] += size
        for row in zip(sequence.tolist(), offset.tolist(), size.tolist()):
            spans[row[0]].append(row[1:])
    assert (covered == length).all()
    total = 0
    for s, pieces in spans.items():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end == places.sequence(np.array([s]))[0][0] and end & (end - 1) == 0 and end <= 2048
        total += end
    assert total == length.sum() and sorted(spans) == list(range(len(spans)))
    tokens, groups = places.sequence(np.arange(len(spans)))
    loads = np.bincount(groups, tokens, places.groups)
    assert loads.max() - loads.min() <= 2048
    for size in set(tokens.tolist()):  # each group has its share of a tier
        each = np.bincount(groups[tokens == size], minlength=places.groups)
        assert each.max() - each.min() <= 1


def test_few_documents_are_cut():
    """Where shorter documents abound, gaps are filled by whole ones."""
    rng = random.Random(1)
    histogram = Counter(min(2047, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    places = T.Places(T.planned(histogram))
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    cut = {i for own, _, size, _, _, _ in places.pieces(length, rank) for i in own[size < length[own]].tolist()}
    assert len(cut) < 0.05 * len(length)


def ids_of(docs):
    library = Tokenizer.from_file(default_path(VOCABULARY))
    return [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]


@pytest.mark.parametrize("source", ["odd", "sf0.001"])
def test_pieces_hold_the_ids_of_documents(spark, source):
    if source == "odd":
        rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (3, "shared id")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "parts": F.lit(1), "length": F.lit(2), "tier": F.lit(3)})
    else:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = T.tier_packed(docs, VOCABULARY).collect()
    want = Counter()
    for doc_id, ids in ids_of(docs):
        want[doc_id] += len(ids)
    have, spans = Counter(), defaultdict(list)
    known = defaultdict(list)
    for doc_id, ids in ids_of(docs):
        known[doc_id].append(ids)
    for r in got:
        have[r.doc_id] += r.length
        own = [ids for ids in known[r.doc_id] if len(ids) == r.doc_tokens and zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert own and r.start + r.length <= r.doc_tokens
        spans[r.sequence_id].append((r.offset, r.length, r.tier))
    assert have == want
    for pieces in spans.values():
        assert sum(n for _, n, _ in pieces) == pieces[0][2]
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(pieces), sorted(pieces)[1:])) and min(pieces)[0] == 0
    assert T.tier_packed(docs.where("false"), VOCABULARY).count() == 0
