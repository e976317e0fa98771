"""Quality classifier: Bradley-Terry pairwise ranking of documents.

Each document gets a vector of surface measures of its whole text. Preference pairs, a document labelled 1
over one labelled 0, give a score w.x by logistic loss on the differences of their vectors. The threshold is the quantile of
the training scores, near the share of documents labelled 0, that errs least; scores are mapped to 0..1 by
a logistic curve that passes through `keep_at` at the threshold, so "score >= keep_at" keeps what lies above it.

Weights and threshold come from all labelled rows and from all pairs of a preferred and another row. The pairs are never made: a Newton
step adds up the rows of each label in cells of `CELL` of the score, and a pair's probability is taken at its cells' mean scores
(a relative error of some 1e-5). Steps add whole numbers, so neither order nor partitions matter. The threshold is exact: scores are counted
in cells between their least and largest, and only cells that may hold a better cut are cut up again. A task sends its non-empty cells;
their sums reach the driver, no rows do. Measures and scores cover every row and every whole
text. NULL and empty texts have measures of zero words and are scored like any other; very long texts too. Without
labels of both kinds all documents score `keep_at`'s side of keeping (1.0). Scores depend on the text alone, so repeated
rows and ties score alike; an id labelled twice counts once for each label, an id with several texts with each of them, and labels
without a document are left out. An empty table gives no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.llm.common import as_bytes, crc_mod, keyed, table, worker_state, written

#: What all pairs weigh together beside the ridge, whatever their number.
PAIRS = 200_000
#: Width of a cell of scores in a fit, and cells on either side of 0 (the outermost take what lies beyond).
CELL = 1 / 16
SIDE = 512
#: Measures are added up as whole multiples of FINE, their products as those of COARSE.
FINE, COARSE = 2.0**-20, 2.0**-12
#: Cells of all parts of the score that are cut up in one pass.
CUT_CELLS = 4_096
KEEP_AT = 0.3

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGIT = bytes(range(0x30, 0x3A))
STOP = b".,;:'\"()-"
MARK = b"!?"
SPACE = b" \t\n\r\x0b\x0c"
SYMBOL = bytes(b for b in range(0x21, 0x7F) if b not in UPPER + LOWER + DIGIT + STOP + MARK)
CLASSES = (UPPER, LOWER, DIGIT, STOP, MARK, SYMBOL)
N_MEASURES = 14


def measures(text: bytes) -> list[float]:
    """Surface measures of one text, each on a scale of a few units."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    upper, lower, digit, stop, mark, symbol = (len(text) - len(text.translate(None, c)) for c in CLASSES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, size - digit - stop - mark - symbol - (len(words) - 1 if words else 0))
    rate = lambda x, most: float(np.log1p(100.0 * x / most))
    return [
        1.0,
        rate(upper, upper + lower + 1),
        rate(digit, size),
        rate(stop, n),
        rate(mark, n),
        rate(symbol, n),
        rate(sum(map(eq, words, words[1:])), n),
        float(len(set(words)) / n),
        rate(len(lines) - len(set(lines)), max(1, len(lines))),
        rate(len(lines), n),
        float(np.log1p(letters / n)),
        float(np.log1p(len(words))),
        float(len(set(words)) / n) * float(np.log1p(len(words))),
        rate(lower, letters),
    ]


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 0) -> np.ndarray:
    """Weights from logistic loss on drawn differences of preferred minus other rows, by Newton steps: what `all_pairs` is held against.

    pairs: how many of all pairs of a preferred and another row are drawn, with replacement.
    """
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability of the wrong order
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, d.T @ p - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def scored(x: np.ndarray, v: np.ndarray, shift: float) -> np.ndarray:
    """x.v - shift of each row, column by column: a row's score does not depend on the rows beside it."""
    s = np.full(len(x), -shift)
    for k, vk in enumerate(v.tolist()):
        s += x[:, k] * vk
    return s


def cell_sums(x: np.ndarray, y: np.ndarray, v: np.ndarray, shift: float) -> dict[int, np.ndarray]:
    """By cell of the score and label: whole sums of (1, x) times (1, x) above the diagonal in COARSE, then of x in FINE."""
    cell = np.clip(np.floor(scored(x, v, shift) / CELL), -SIDE, SIDE - 1).astype(np.int64) * 2 + y
    order = np.argsort(cell, kind="stable")
    found, starts = np.unique(cell[order], return_index=True)
    x = x[order]
    one = np.concatenate([np.ones((len(x), 1), np.int64), np.rint(x / COARSE).astype(np.int64)], axis=1)
    i, j = np.triu_indices(one.shape[1])
    sums = np.concatenate([one[:, i] * one[:, j], np.rint(x / FINE).astype(np.int64)], axis=1)
    return dict(zip(found.tolist(), np.add.reduceat(sums, starts, axis=0))) if len(x) else {}


def cell_counts(x: np.ndarray, y: np.ndarray, v: np.ndarray, parts: np.ndarray, each: int) -> dict[int, tuple]:
    """(rows labelled 0, labelled 1, least, largest score) of each cell of the parts (least, largest score) that are cut into `each`."""
    s = scored(x, v, 0.0)
    part = np.searchsorted(parts[:, 0], s, side="right") - 1
    inside = (part >= 0) & (s <= parts[part, 1])
    s, y, part = s[inside], y[inside], part[inside]
    low, high = parts[part].T
    cell = part * each + np.minimum(each - 1, np.floor((s - low) / np.where(high > low, high - low, 1.0) * each)).astype(np.int64)
    order = np.lexsort((s, cell))
    cell, s, ones = cell[order], s[order], np.concatenate([[0], np.cumsum(y[order])])
    found, starts = np.unique(cell, return_index=True)
    ends = np.append(starts[1:], len(cell))
    n1 = ones[ends] - ones[starts]
    return {int(c): (int(e - b - k), int(k), float(s[b]), float(s[e - 1])) for c, b, e, k in zip(found, starts, ends, n1)}


def all_pairs(sums: Callable, width: int, steps: int = 30, ridge: float = 1.0) -> tuple | None:
    """(weights, mean, scale) from logistic loss on all differences of a preferred and another row; None if a kind of label is missing.

    sums: cell_sums of all rows of `width` measures, given weights and shift.
    """
    found, mean = sums(np.zeros(width), 0.0), None
    if {c % 2 for c in found} != {0, 1}:
        return None
    i, j = np.triu_indices(width + 1)
    w = np.zeros(width)
    for _ in range(steps):
        keys = sorted(found)
        rows = np.asarray([found[k] for k in keys], np.float64)
        square = np.zeros((len(keys), width + 1, width + 1))
        square[:, i, j] = square[:, j, i] = rows[:, : len(i)] * COARSE**2
        n, near, x = rows[:, 0], square[:, 0, 1:] / COARSE, rows[:, len(i) :] * FINE
        if mean is None:
            total = n.sum()
            mean, about = x.sum(axis=0) / total, near.sum(axis=0) / total
            scale = np.sqrt(np.maximum(0.0, np.diag(square[:, 1:, 1:].sum(axis=0)) / total - about**2)) + 1e-6
        z = (x - n[:, None] * mean) / scale
        # Products about the mean, from the coarse sums alone.
        zz = square[:, 1:, 1:] - near[:, :, None] * about - about[:, None] * near[:, None, :] + n[:, None, None] * np.outer(about, about)
        zz /= np.outer(scale, scale)
        y = np.asarray(keys) % 2 == 1
        s = z @ w / n
        wrong = 1 / (1 + np.exp(np.clip(s[y][:, None] - s[~y], -500, 500)))  # probability of the wrong order
        weight = PAIRS / (n[y].sum() * n[~y].sum())
        slope = wrong * (1 - wrong)
        down = (wrong @ n[~y]) @ z[y] - (n[y] @ wrong) @ z[~y]
        cross = z[y].T @ slope @ z[~y]
        hessian = np.tensordot(slope @ n[~y], zz[y], 1) + np.tensordot(n[y] @ slope, zz[~y], 1) - cross - cross.T
        step = np.linalg.solve(weight * hessian + ridge * np.eye(width), weight * down - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4 * max(1.0, np.abs(w).max()):
            break
        found = sums(w / scale, float(mean / scale @ w))
    return w, mean, scale


def least_wrong_cut(counts: Callable, around: float = 0.05) -> float:
    """The score between two rows, at a quantile within `around` of the share labelled 0, that errs least; ties go to the widest gap.

    counts: cell_counts of all rows, given the parts of the score to cut up and into how many cells.
    """
    known = [*counts(np.asarray([[-1e300, 1e300]]), 1).values()]
    n0, n1 = known[0][:2]
    n, share, reach = n0 + n1, n0 / (n0 + n1), max(around, 1 / (n0 + n1))
    while True:
        cells = np.asarray([c[:2] for c in known], np.int64)
        low, high = (np.asarray([c[k] for c in known]) for k in (2, 3))
        end = np.cumsum(cells, axis=0)
        start = end - cells
        wrong = end[:, 1] + n0 - end[:, 0]  # of a cut after the cell
        off = np.abs(end.sum(axis=1) / n - share)[:-1]
        edge = np.flatnonzero(off <= reach)
        least = wrong[edge].min() if len(edge) else n + 1
        meets = (start.sum(axis=1) / n <= share + reach) & (end.sum(axis=1) / n >= share - reach)
        better = start[:, 1] + n0 - end[:, 0] <= least
        open_ = np.flatnonzero((low < high) & meets & better)
        if not len(open_):
            break
        each = max(2, CUT_CELLS // len(open_))
        found = counts(np.column_stack([low[open_], high[open_]]), each)
        finer: dict[int, list] = {}
        for c in sorted(found):
            finer.setdefault(c // each, []).append(found[c])
        place = {int(k): p for p, k in enumerate(open_)}
        known = [c for k, old in enumerate(known) for c in (finer[place[k]] if k in place else [old])]
    if len(known) == 1:
        return float(low[0])
    if not len(edge):  # equal scores fill all of the reach
        edge = np.flatnonzero(off == off.min())
        least = wrong[edge].min()
    best = max(edge[wrong[edge] == least].tolist(), key=lambda k: low[k + 1] - high[k])
    return float((high[best] + low[best + 1]) / 2)


def model_of(sums: Callable, counts: Callable, width: int, keep_at: float) -> dict | None:
    """Weights, bias (minus the threshold) and shift; None if a kind of label is missing."""
    if (got := all_pairs(sums, width)) is None:
        return None
    w, mean, scale = got
    v = w / scale
    return {"w": v, "bias": -least_wrong_cut(lambda parts, each: counts(v, parts, each)), "shift": float(np.log(keep_at / (1 - keep_at)))}


def fitted(x: np.ndarray, y: np.ndarray, keep_at: float = KEEP_AT) -> dict | None:
    """The model of rows at hand."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.int64)
    return model_of(lambda v, shift: cell_sums(x, y, v, shift), lambda v, parts, each: cell_counts(x, y, v, parts, each), x.shape[1], keep_at)


def fitted_table(rows: DataFrame, keep_at: float = KEEP_AT) -> dict | None:
    """The model of a table (x array<double>, y int) that is read in each pass."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        worker_state()
        for batch in batches:
            if batch.num_rows:
                yield batch.column(0).flatten().to_numpy().reshape(-1, N_MEASURES), batch.column(1).to_numpy().astype(np.int64)

    def sums(v, shift):
        def run(batches):
            total: dict[int, np.ndarray] = {}
            for x, y in arrays(batches):
                for c, values in cell_sums(x, y, v, shift).items():
                    total[c] = total[c] + values if c in total else values
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.int64()))], ["cell", "sums"])

        def added(some: pa.Table) -> pa.Table:
            t = some.column("sums").combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1).sum(axis=0)
            return pa.table({"cell": some.column("cell")[:1], "sums": pa.array([t.tolist()], pa.list_(pa.int64()))})

        kinds = "cell int, sums array<long>"
        return {r.cell: np.asarray(r.sums, np.int64) for r in rows.mapInArrow(run, kinds).groupBy("cell").applyInArrow(added, kinds).collect()}

    def counts(v, parts, each):
        def run(batches):
            for x, y in arrays(batches):
                got = cell_counts(x, y, v, parts, each)
                columns = [list(got), *zip(*got.values())] if got else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cell", "n0", "n1", "low", "high"])

        cells = rows.mapInArrow(run, "cell long, n0 long, n1 long, low double, high double")
        whole = cells.groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("low").alias("low"), F.max("high").alias("high"))
        return {r.cell: (r.n0, r.n1, r.low, r.high) for r in whole.collect()}

    return model_of(sums, counts, N_MEASURES, keep_at)


def labelled_measures(docs: DataFrame, labels: DataFrame, label: str, train) -> DataFrame:
    """(x, y) of every row of documents that has a label: measured where it lies, so no text moves."""

    @F.arrow_udf("array<double>")
    def measured(text: pa.Array) -> pa.Array:
        return pa.array([measures(t) for t in as_bytes(text)], pa.list_(pa.float64()))

    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(train).where("doc_id is not null and y in (0, 1)").distinct()
    return written(keyed(docs).where(train).select("doc_id", measured("text").alias("x")).join(known, "doc_id").select("x", "y"), "measures")


def score_column(docs: DataFrame, labels: DataFrame, train=None, label: str = "quality", keep_at: float = KEEP_AT):
    """A function from a text column to its score, learned from all labelled rows that `train` (a column over doc_id) admits."""
    model = fitted_table(labelled_measures(docs, labels, label, F.lit(True) if train is None else train), keep_at)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.ones(len(text)))
        x = np.asarray([measures(t) for t in as_bytes(text)]).reshape(-1, N_MEASURES)
        return pa.array(1 / (1 + np.exp(-np.clip(scored(x, model["w"], -model["bias"]) + model["shift"], -500, 500))))

    return score


def scores(docs: DataFrame, labels: DataFrame, train=None, label: str = "quality", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, score, predicted for every row."""
    score = score_column(docs, labels, train, label, keep_at)
    return keyed(docs).select("doc_id", score("text").alias("score")).withColumn("predicted", (F.col("score") >= keep_at).cast("int"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
