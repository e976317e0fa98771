"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text, and a document's windows of a few words are
compressed with either; the difference of lengths tells which kind of text explains a window better.

A label speaks of a whole document, most of whose windows are ordinary. Toxic text to train on is therefore what sets toxic
documents apart: of each, the words whose beginnings are many times more frequent in toxic documents than in
ordinary ones (`typical_beginnings`). The ordinary dictionary is trained on windows of ordinary documents, and in `HARD_ROUNDS`
further rounds on those ordinary windows that the toxic dictionary shortened wrongly. The toxic side holds the ordinary
content too, so a window is shorter there only by what toxic text alone explains.

A document's largest saving, how many windows save at least `NOTABLE` bytes (and one more) and the number of windows are calibrated
to a probability by logistic regression, placed so that 0.7 is the threshold that the training rows favour.

Fitting takes at most `fit_toxic` and `fit_ordinary` labelled rows (documented bounds, drawn by a hash of the id), read on the executors;
the driver gathers counts of beginnings, `FIT_WINDOWS` windows of at most `LONGEST_WINDOW` bytes at most, and each drawn row's measures. Every window of
every whole text is scored. NULL and empty texts have no windows and score as the calibration says for zero.
Without training rows of both kinds, or where toxic rows have nothing in common that sets them apart, every score is 0.
Texts are lower-cased (A-Z). Scores depend on the text alone, so repeated rows and ties score alike. An empty table gives no
rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.llm.common import as_bytes, crc_mod, keyed, labelled_rows, table, worker_state, written

FIT_TOXIC = 1_500
FIT_ORDINARY = 4_500
WORDS, STEP = 6, 5
FLAG_AT = 0.7
NOTABLE = 2
#: Sizes of the trained dictionaries, and the segments that each is made of.
ORDINARY_BYTES, ORDINARY_SEGMENT = 12_288, 64
TOXIC_BYTES, TOXIC_SEGMENT = 3_072, 16
HARD_BYTES, HARD_SEGMENT, HARD_ROUNDS = 4_096, 24, 2
#: Windows that train the ordinary dictionary at most, and the longest that takes part in training.
FIT_WINDOWS = 80_000
LONGEST_WINDOW = 512
#: Shortest word beginning (with the space before it) that can tell; one more than the compressor's shortest match.
BEGINNING = 5
LONGEST = 12
#: How many times more frequent a beginning must be in toxic documents, the share of them that must have it
#: (and three fifths of that share after different words).
RATIO, SHARE = 20.0, 0.03


def windows(text: bytes) -> list[bytes]:
    """Overlapping runs of a few words, each between single spaces."""
    words = text.lower().split()
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, max(len(words) - (WORDS - STEP), min(1, len(words))), STEP)]


def beginnings(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[:n] for n in range(BEGINNING, min(LONGEST, len(w)) + 1)]


def mapped(rows: DataFrame, schema: str, f) -> DataFrame:
    """mapInArrow of f: (texts, labels) of a batch -> columns, in the order of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(f(as_bytes(batch.column(0)), batch.column(1).to_pylist()), names)

    return rows.select("text", "y").mapInArrow(run, schema)


def typical_beginnings(rows: DataFrame, n: dict[int, int]) -> list[bytes]:
    """Word beginnings typical of toxic text, as short as they stay typical. rows: (text, y); n: rows of each y."""

    def counted(texts: list[bytes], labels: list[int]):
        seen: Counter = Counter()
        for text, y in zip(texts, labels):
            seen.update({(y, g) for w in set(text.lower().split()) for g in beginnings(w)})
        return [pa.array([g for _, g in seen], pa.binary()), pa.array([y for y, _ in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())]

    toxic, ordinary = (F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)) for y in (1, 0))
    least = max(3, SHARE * n[1])
    found = mapped(rows, "g binary, y int, n long", counted).groupBy("g").agg(toxic.alias("toxic"), ordinary.alias("ordinary"))
    found = found.where((F.col("toxic") >= least) & (F.col("toxic") / n[1] >= RATIO * (F.col("ordinary") + 0.5) / max(1, n[0]))).select("g").collect()
    several = {bytes(r.g) for r in found}

    def surrounded(texts: list[bytes], labels: list[int]):
        seen = set()
        for text, y in zip(texts, labels):
            words = text.lower().split() if y == 1 else []
            seen.update((g, before) for before, w in zip([b"", *words], words) for g in beginnings(w) if g in several)
        return [pa.array([g for g, _ in seen], pa.binary()), pa.array([b for _, b in seen], pa.binary())]

    # Near copies of one passage share the word before.
    around = mapped(rows, "g binary, before binary", surrounded).groupBy("g").agg(F.countDistinct("before").alias("n")).where(F.col("n") >= 0.6 * least).collect()
    kept = {bytes(r.g) for r in around}
    return sorted(g for g in kept if g[:-1] not in kept)


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary that zstandard trains on samples, without its header; empty where they are too few to train one."""
    samples = sorted(s for s in samples if len(s) >= 8)
    try:
        raw = zstandard.train_dictionary(size, samples, k=segment, d=8 if segment > 32 else 6, level=3).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""
    mark = b"".join(x.to_bytes(4, "little") for x in (1, 4, 8))  # the repeated offsets that end the header
    at = raw.find(mark)
    content = raw[at + 12 :] if at >= 0 else raw
    return content + b"\0" * (-len(content) % 24)


class Compressors:
    """The two compressors of a model, and the four measures of a text."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self.compressor(b"\0" * len(toxic) + ordinary), self.compressor(toxic + ordinary)

    @staticmethod
    def compressor(content: bytes):
        options = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )
        d = zstandard.ZstdCompressionDict(content or b"\0" * 24, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=options)
        return zstandard.ZstdCompressor(compression_params=options, dict_data=d).compress

    def savings(self, text: bytes) -> list[int]:
        a, b = self.ordinary, self.toxic
        return [len(a(w)) - len(b(w)) for w in windows(text)]

    def measures(self, text: bytes) -> tuple[float, ...]:
        s = self.savings(text)
        counts = [float(np.log1p(sum([x >= n for x in s]))) for n in (NOTABLE, NOTABLE + 1)]
        return float(max(s, default=0)), *counts, float(np.log1p(len(s)))


def tool(ordinary: bytes, toxic: bytes) -> Compressors:
    """A worker's compressors, made once for a model."""
    return worker_state(("toxicity", ordinary, toxic), lambda: Compressors(ordinary, toxic))


def collected(windows_: DataFrame, most: int = FIT_WINDOWS) -> list[bytes]:
    """At most `most` distinct windows (column w), drawn by their hash."""
    rows = windows_.where(F.length("w") <= LONGEST_WINDOW).distinct().orderBy(F.xxhash64("w"), "w").limit(most)
    return [bytes(x) for x in rows.toArrow().column("w").to_pylist()]


def dictionaries(rows: DataFrame, n: dict[int, int]) -> tuple[bytes, bytes]:
    """(ordinary content, toxic content), trained on (text, y) rows."""
    typical = typical_beginnings(rows, n)
    known = set(typical)

    def toxic_text(texts: list[bytes], labels: list[int]):
        out = []
        for text, y in zip(texts, labels):
            words = dict.fromkeys(text.lower().split()) if y == 1 else ()
            out.append(b"".join([b" " + w + b" " for w in words if len(w) <= LONGEST_WINDOW and any(g in known for g in beginnings(w))]))
        return [pa.array(out, pa.binary())]

    def every_window(texts: list[bytes], labels: list[int]):
        return [pa.array([w for t, y in zip(texts, labels) if y == 0 for w in windows(t)], pa.binary())]

    samples = mapped(rows, "w binary", toxic_text).where(F.length("w") > 0).toArrow().column("w").to_pylist() if typical else []
    toxic = trained([bytes(s) for s in samples], TOXIC_BYTES, TOXIC_SEGMENT)
    ordinary = trained(collected(mapped(rows, "w binary", every_window)), ORDINARY_BYTES, ORDINARY_SEGMENT)
    for _ in range(HARD_ROUNDS if toxic else 0):

        def wronged(texts: list[bytes], labels: list[int], pair=(ordinary, toxic)):
            c = Compressors(*pair)
            return [pa.array([w for t, y in zip(texts, labels) if y == 0 for w, s in zip(windows(t), c.savings(t)) if s >= NOTABLE], pa.binary())]

        ordinary = trained(collected(mapped(rows, "w binary", wronged)), HARD_BYTES, HARD_SEGMENT) + ordinary
    return ordinary, toxic


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (the last is the bias) with both kinds weighing the same."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(x: np.ndarray, y: np.ndarray, flag_at: float = FLAG_AT) -> np.ndarray:
    """Logistic weights whose bias puts the best training threshold (hits less three times the false alarms) at flag_at."""
    w = logistic(x, y)
    z = x @ w[:-1] + w[-1]
    order = np.argsort(-z, kind="stable")
    hits, alarms = np.cumsum(y[order] == 1) / (y == 1).sum(), np.cumsum(y[order] == 0) / (y == 0).sum()
    gain = np.where(np.append(np.diff(z[order]) != 0, True), hits - 3 * alarms, -np.inf)
    k = int(np.argmax(gain))
    below = z[order][z[order] < z[order][k]]
    cut = (z[order][k] + (below[0] if len(below) else z[order][k] - 1)) / 2
    w[-1] += np.log(flag_at / (1 - flag_at)) - cut
    return w


def fitted(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_ordinary: int = FIT_ORDINARY):
    """(ordinary content, toxic content, calibration weights), or None if a kind of row is missing or toxic rows have nothing of their own."""
    # Texts repeat; each is used once.
    rows = labelled_rows(keyed(docs), labels, label, train, {0: fit_ordinary, 1: fit_toxic}).distinct()
    rows = written(rows.repartition(24), "toxicity-fit")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    ordinary, toxic = dictionaries(rows, n)
    if not toxic:
        return None

    def measured(texts: list[bytes], labels: list[int]):
        c = Compressors(ordinary, toxic)
        x = np.asarray([c.measures(t) for t in texts]).reshape(-1, 4)
        return [pa.array(column) for column in x.T] + [pa.array(labels, pa.int32())]

    got = mapped(rows, "a double, b double, c double, d double, y int", measured).toArrow()
    table_ = np.asarray(sorted(zip(*(c.to_pylist() for c in got.columns))), np.float64)
    return ordinary, toxic, calibrated(table_[:, :4], table_[:, 4])


def score_column(docs: DataFrame, labels: DataFrame, train=None, label: str = "toxic"):
    """A function from a text column to its score, learned from the labelled rows that `train` (a column) admits."""
    model = fitted(docs, labels, F.lit(True) if train is None else train, label)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(text)))
        ordinary, toxic, w = model
        c = tool(ordinary, toxic)
        x = np.asarray([c.measures(t) for t in as_bytes(text)]).reshape(-1, 4)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500))))

    return score


def scores(docs: DataFrame, labels: DataFrame, train=None, label: str = "toxic", flag_at: float = FLAG_AT) -> DataFrame:
    """doc_id, score, predicted for every row."""
    score = score_column(docs, labels, train, label)
    return keyed(docs).select("doc_id", score("text").alias("score")).withColumn("predicted", (F.col("score") >= flag_at).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
