"""Spelling variants against pairs of words compared one by one."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provaudit.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts: dict[str, int]) -> set[tuple]:
    by_length: dict[int, list[str]] = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    others = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)] for w in counts}
    form = {}
    for w, xs in others.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(others[w]), counts.get(form[w])))
    return out


def plain_counts(rows) -> dict[str, int]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = spelling.planted(doc_id, "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run))
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def words_near_each_other(seed: int, bases: int, letters: str = "abé") -> list[str]:
    rng, found = random.Random(seed), set()
    for _ in range(bases):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 11)))
        for _ in range(6):
            found.add(w)
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + (rng.choice(letters + "z") if kind else "") + w[i + (kind != 1) :]
    return sorted(w for w in found if len(w) >= 7)


@pytest.mark.parametrize("seed", range(6))
def test_both_searches_find_each_near_word_once(seed):
    words = words_near_each_other(seed, 40)
    index = spelling.BothWays(words)
    got = [p for side in (True, False) for p in zip(*(x.tolist() for x in index.near(words, side)))]
    assert sorted(got) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)]


def test_index_looks_up_words_with_letters_that_it_lacks():
    index = spelling.BothWays(["abcdefg", "abcdefgh"])
    asked, got = index.near(["abcdefx", "xbcdefg", "ÿbcdefg", "zzzzzzz"], True)
    assert list(zip(asked.tolist(), got.tolist())) == [(0, 0)]
    asked, got = index.near(["abcdefx", "xbcdefg", "ÿbcdefg", "zzzzzzz"], False)
    assert list(zip(asked.tolist(), got.tolist())) == [(1, 0), (2, 0)]


@pytest.mark.parametrize("block_chars", [200, 3_000, 60_000])
def test_blocks_and_shared_beginnings_lose_no_word(spark, block_chars):
    """All words share few beginnings, so full indexes are split and looked up in every part."""
    words = words_near_each_other(9, 120)
    counts = {w: 2 + (i * 7919) % 1000 * (i % 3 == 0) for i, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.spelling_variants(df, block_chars=block_chars).collect()} == expected(counts)


def test_forms_lead_to_their_root(spark):
    chain = {"abcdefghij": 100_000, "abcdefghi": 10_000, "abcdefgh": 1_000, "abcdefg": 100, "abcdefx": 10, "zbcdefx": 1, "abcdefy": 11}
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert {got[w].root for w in chain if w != "abcdefy"} == {"abcdefghij"} and got["abcdefghij"].form is None
    assert got["abcdefy"].form is None and got["abcdefy"].root == "abcdefy"  # 11 * 10 > 100
    assert got["abcdefx"].n_near == 3 and got["abcdefx"].form_n == 100


def test_words_of_odd_texts(spark):
    long_run = "q" * 5_000
    rows = [(1, "Zebracorns zebracorns ZEBRACORNS Étudiants Étudiants étudiants"), (2, None), (3, ""), (None, "zebracorn zebracorn"), (4, "short words"), (5, f"{long_run} {long_run}x 9{long_run}9"), (6, "zebracorns"), (6, "zebracorns")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "block": F.lit(2), "side": F.lit(3)})
    got = {tuple(r) for r in spelling.spelling_variants(spelling.word_counts(docs, spelling.planted)).collect()}
    assert got == expected(plain_counts(rows)) and any(r[0] == "zebracorns" for r in got)
    assert spelling.spelling_variants(spelling.word_counts(docs.where("false"), spelling.planted)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.op11_spelling(spark, SF).collect()} == expected(plain_counts(rows))
