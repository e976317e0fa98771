"""Spelling variants by search schemes over a bidirectional FM-index.

Words are counted over all documents. Two words are near if one inserted, deleted or replaced code point makes one the
other; then the first or the second half of the one is whole in the other, so two searches find every near word: match
one half exactly, then extend across the other half allowing one error. Both run as suffix-rank intervals, in the text
and in the reversed text at once, over a vocabulary in which every word stands between two marks.

Distribution: words that share an exact half share their first (or last) three code points, so an index holds the words of
some such beginnings (or endings) and a word is looked up in the index that holds its own. Indexes hold about `block_chars`
characters: rare beginnings share one, a frequent one has several, in each of which all its words are looked up. An index
returns one row a word (its near words counted, the best of them), never the pairs. The form of a word has at least `ratio`
times its occurrences, so a chain of forms is at most 20 long and is followed by doubling.

NULL texts have no words, a NULL id reads as empty in what the query plants. Empty texts and empty tables give no rows.
A run of letters of any length is one word; one longer than `block_chars` makes its index longer. Repeated rows count again.
Ties between near words of equal count go to the first in code-point order. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.llm.common import as_bytes, chunks, keyed, table, worker_state, written

#: Letters of words, code points and occurrences that a word needs, occurrences of a form by those of the word.
LETTERS = "a-zÀ-ÿ"
SHORTEST, LEAST, RATIO = 7, 2, 10
#: Code points by which words meet: no more than the shorter half of the shortest word.
GRAM = 3
#: Characters of one index, and words counted in a task before they are passed on.
BLOCK_CHARS = 60_000
COUNTED = 200_000
#: Forms have ten times the occurrences, which 64 bits count: chains are below 2 ** 5 long.
DOUBLINGS = 5


def word_counts(docs: DataFrame, edit: Callable[[object, str], str] | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: maximal runs of letters, A-Z lower-cased, as `edit(doc_id, run)` leaves them."""
    # No run below `shortest` can give a longer word, as edits never lengthen; a maximal run is matched whole.
    runs = f"[{LETTERS}]{{{shortest},}}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        find, held = re.compile(runs).findall, Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                    for w, n in Counter(find(text.lower().decode("utf-8", "replace"))).items():
                        if edit is not None:
                            w = edit(doc_id, w)
                        if len(w) >= shortest:
                            held[w] += n
                    if len(held) > COUNTED:
                        yield out(held)
                        held.clear()
        yield out(held)

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return keyed(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of every suffix, in order. The last symbol is 0 and stands nowhere else; symbols are below 128."""
    n, k = len(text), 8
    padded = np.concatenate([text, np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = key << 7 | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if ranks[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[:-k] = ranks[k:] + 1 if k < n else 0
        key, k = ranks * (n + 1) + later, 2 * k


class BothWays:
    """A bidirectional FM-index over words between marks.

    A match of a string is (at, back, size): its suffixes have ranks at ... at + size - 1 in the text, and those of the
    reversed string back ... back + size - 1 in the reversed text. Arguments and results are arrays, one entry a match.
    """

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.alphabet = np.unique(np.concatenate(points))
        self.symbols = len(self.alphabet) + 2  # 0 ends the text, 1 is the mark
        spans = np.array([len(p) + 1 for p in points])
        self.starts = np.concatenate([[0], np.cumsum(spans)[:-1]])
        text = np.ones(spans.sum() + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[[*self.starts, len(text) - 1]] = False
        text[inside] = np.searchsorted(self.alphabet, np.concatenate(points)) + 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])[: self.symbols] + 1
        self.first[0] = 0
        self.order, self.left = self.index(text)
        _, self.right = self.index(text[::-1])

    def index(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order, and how often each symbol stands before the first i suffixes."""
        whole = np.concatenate([text, [0]])
        order = suffix_order(whole)
        before = whole[order - 1]
        counts = np.zeros((len(whole) + 1, self.symbols), np.int32)
        counts[np.arange(1, len(whole) + 1), before] = 1
        return order, np.cumsum(counts, axis=0, out=counts, dtype=np.int32)

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The empty string's match."""
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)

    def branches(self, match: tuple, rightwards: bool) -> tuple[np.ndarray, ...]:
        """(first ranks on the side that grows, on the other side, sizes) for every symbol, as one row a match."""
        at, back, size = match
        table_, near, far = (self.right, back, at) if rightwards else (self.left, at, back)
        low = table_[near]
        sizes = table_[near + size] - low
        return self.first + low, far[:, None] + np.cumsum(sizes, axis=1) - sizes, sizes

    def extended(self, match: tuple, symbol: np.ndarray, rightwards: bool) -> tuple:
        """Matches with one symbol more on one side."""
        grown, other, sizes = self.branches(match, rightwards)
        rows = np.arange(len(symbol))
        grown, other, sizes = (x[rows, symbol].astype(np.int64) for x in (grown, other, sizes))
        return (other, grown, sizes) if rightwards else (grown, other, sizes)

    def coded(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length, -1 for those that no indexed word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, -1)

    def one_error(self, coded: np.ndarray, rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row of coded, indexed word) of each pair at one error, the half where the search starts being the same in both.

        Each near word comes once: of equal letters in a row the last is the one left out, and a letter put before its
        like is put after it.
        """
        n, length = coded.shape
        half = length // 2
        exact, rest = (coded[:, :half], coded[:, half:]) if rightwards else (coded[:, half:][:, ::-1], coded[:, :half][:, ::-1])
        mark = np.ones((n, 1), np.int64)
        rows, match = np.arange(n), self.whole(n)
        for symbol in np.concatenate([mark, exact], axis=1).T:
            rows, match = self.kept(rows, match, symbol[rows], rightwards)
        wrong, found = np.zeros(0, np.int64), self.whole(0)
        steps = rest.shape[1]
        for j in range(steps + 1):
            due = rest[:, j] if j < steps else np.ones(n, np.int64)  # the mark ends the word
            r, c, others = self.others(rows, match, due[rows], rightwards)
            if j < steps:
                more = rest[rows, j + 1] != due[rows] if j + 1 < steps else np.ones(len(rows), bool)
                wrong, found = joined((wrong, found), (r, others))  # one symbol more, then the one that is due
                wrong, found = self.kept(wrong, found, due[wrong], rightwards)
                wrong, found = joined((wrong, found), (r, others), (rows[more], tuple(x[more] for x in match)))  # another symbol; none
                rows, match = self.kept(rows, match, due[rows], rightwards)
            else:
                wrong, found = joined((wrong, found), (r, others))
                wrong, found = self.kept(wrong, found, due[wrong], rightwards)
        return wrong, np.searchsorted(self.starts, self.order[found[0]], side="right") - 1

    def kept(self, rows: np.ndarray, match: tuple, symbol: np.ndarray, rightwards: bool) -> tuple[np.ndarray, tuple]:
        known = symbol >= 0
        rows, match = rows[known], self.extended(tuple(x[known] for x in match), symbol[known], rightwards)
        left = match[2] > 0
        return rows[left], tuple(x[left] for x in match)

    def others(self, rows: np.ndarray, match: tuple, due: np.ndarray, rightwards: bool) -> tuple:
        """Matches that go on by a letter other than the one that is due."""
        grown, other, sizes = self.branches(match, rightwards)
        which, c = np.nonzero(sizes > 0)
        fit = (c > 1) & (c != due[which])
        which, c = which[fit], c[fit]
        grown, other, sizes = (x[which, c].astype(np.int64) for x in (grown, other, sizes))
        return rows[which], c, ((other, grown, sizes) if rightwards else (grown, other, sizes))

    def near(self, words: list[str], rightwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word asked, number of the word indexed) for near words that share the half the search starts from.

        Leftwards, words that share the first half too are left to the search rightwards.
        """
        lengths = np.array([len(w) for w in words])
        asked, got = [], []
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            coded = self.coded([words[i] for i in own])
            rows, found = self.one_error(coded, rightwards)
            if not rightwards:
                half = int(length) // 2
                theirs = self.beginnings(found, half)
                new = (theirs != coded[rows][:, :half]).any(axis=1)
                rows, found = rows[new], found[new]
            asked.append(own[rows])
            got.append(found)
        return np.concatenate(asked), np.concatenate(got)

    def beginnings(self, found: np.ndarray, n: int) -> np.ndarray:
        """First n symbols of indexed words; they are longer than that."""
        return self.text()[self.starts[found][:, None] + 1 + np.arange(n)]

    def text(self) -> np.ndarray:
        """The indexed text, from the first symbols of its suffixes in order."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.searchsorted(self.first, np.arange(len(self.order)), side="right") - 1
        return out


def joined(*parts: tuple[np.ndarray, tuple]) -> tuple[np.ndarray, tuple]:
    return np.concatenate([p[0] for p in parts]), tuple(np.concatenate([p[1][i] for p in parts]) for i in range(3))


def best_of(index: BothWays, own: list[str], counts: np.ndarray, words: list[str], rightwards: bool) -> tuple:
    """(near words, largest count of them, first word with that count) for each word asked."""
    asked, got = index.near(words, rightwards)
    many = np.bincount(asked, minlength=len(words))
    place = np.empty(len(own), np.int64)
    place[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
    order = np.lexsort((place[got], -counts[got], asked))
    asked, got = asked[order], got[order]
    lead = np.flatnonzero(np.diff(asked, prepend=-1))
    best, most = [None] * len(words), [None] * len(words)
    for a, g in zip(asked[lead].tolist(), got[lead].tolist()):
        best[a], most[a] = own[g], int(counts[g])
    return many, most, best


def near_words(words: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """word, n, n_near, best, best_n for every row of words (word, n; words once each, of `SHORTEST` code points at least)."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, GRAM).alias("gram")), F.struct(F.lit(1).alias("side"), F.substring("word", -GRAM, GRAM).alias("gram")))).alias("x")
    dealt = words.select("word", "n", sides).select("word", "n", "x.side", "x.gram")
    # One row for each beginning and ending: at most 2 * 93 ** 3 of them, and of those with a full index of their own
    # one for each `block_chars` characters.
    sizes = written(dealt.groupBy("side", "gram").agg(F.sum(F.length("word") + 1).alias("chars")), "grams")
    full = sizes.where(F.col("chars") > block_chars).select("side", "gram", F.ceil(F.col("chars") / block_chars).cast("int").alias("parts"))
    blocks = max(1, int(sizes.agg(F.sum(F.when(F.col("chars") <= block_chars, F.col("chars")))).first()[0] or 0) // block_chars)
    rows = dealt.join(F.broadcast(full), ["side", "gram"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    own = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    block = F.when(F.col("parts").isNull(), F.concat(F.lit("#"), F.pmod(F.xxhash64("gram"), F.lit(blocks)))).otherwise(F.concat("gram", F.lit("#"), "part"))
    rows = rows.select("side", block.alias("block"), (F.col("part") == own).alias("held"), "word", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        now, own, counts, index = None, [], [], None

        def found(words: list[str], ns: list[int]) -> pa.RecordBatch:
            many, most, best = best_of(index, own, np.array(counts), words, not now[0])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(many, pa.int64()), pa.array(best, pa.string()), pa.array(most, pa.int64())], ["word", "n", "n_near", "best", "best_n"])

        for batch in batches:
            side, block, held, word, n = (c.to_pylist() for c in batch.columns)
            keys = list(zip(side, block, held))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if keys[s][:2] != now:
                    if own and index is None:
                        index = BothWays(own)
                        yield found(own, counts)
                    now, own, counts, index = keys[s][:2], [], [], None
                if held[s]:
                    own += word[s:e]
                    counts += n[s:e]
                elif own:
                    if index is None:
                        index = BothWays(own)
                        yield found(own, counts)
                    yield found(word[s:e], n[s:e])
        if own and index is None:
            index = BothWays(own)
            yield found(own, counts)

    order = ["side", "block", F.desc("held")]
    got = rows.repartition("side", "block").sortWithinPartitions(*order).mapInArrow(search, "word string, n long, n_near long, best string, best_n long")
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best"))).alias("x")
    out = got.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first)
    return out.select("word", "n", "n_near", F.col("x.best").alias("best"), (-F.col("x.minus")).alias("best_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: the last word that forms lead to, by doubling the steps of each link."""
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        links = written(links, "roots")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("last"))
        moved = links.join(further, "root", "left")
        if moved.where("last is not null").isEmpty():
            break
        links = moved.select("word", F.coalesce("last", "root").alias("root"))
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, ratio: int = RATIO, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n)."""
    near = near_words(words, block_chars)
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    return with_roots(written(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def planted(doc_id: object, run: str) -> str:
    """The run with one code point deleted where the contract of the query says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(written(word_counts(table(spark, sf_dir, "documents"), planted), "words"))
