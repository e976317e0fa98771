"""Gated recurrent language model with a class-factored output, in numpy.

Tokens are words, lower-cased A-Z, and one end mark for each document. Counts of all tokens of all training documents
come from Spark. The most frequent words form a shortlist dealt into equal classes by frequency; every other word,
seen or not, falls into a bucket (a class of its own) by its first two bytes. A token's probability is
P(class | state) * P(word | class, state) for the shortlist and P(bucket | state) * P(word | bucket) for the rest, where
P(word | bucket) is the smoothed share (c + 0.5) / (N_b + 0.5 (V_b + 1)) among the bucket's words, so the
probabilities of all words and one unknown word per bucket sum to one.

Weights are trained by truncated backpropagation (windows of `WINDOW` steps, state carried across windows, reset at a
document's start) in one pass over every training row. A hash deals the rows into `ROUNDS` parts; in each round
every partition trains on its rows of that part, from the weights of the round before, and the partitions' weights are averaged by
tokens. Partitions grow in number with the table; only partitions so small that they hold less than `SHARD` tokens on average are
joined. Counts, buckets and scores cover all rows. A document is scored whole, its state carried from window to window.

Words too rare for the broadcast table of `TABLE` counts meet their counts in a shuffled join by word.
NULL and empty texts are the end mark alone; repeated rows are returned as often as they come; without
training rows every word is unknown. A very long text is one lane of many windows. An empty table gives no rows. Extra columns
are left out, whatever their names.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provaudit.llm.common import chunks, crc_mod, keyed, table, worker_state, written

TABLE = 65_536
SHORTLIST = 1_024
CLASS_SIZE = 32
BUCKETS = 64
HIDDEN = 24
WINDOW = 16
LANES = 256
#: Least training tokens of a partition on average, and tokens held at once while training.
SHARD = 1_000_000
HELD = 500_000
ROUNDS = 3
#: Parts of the weights, each averaged by a task of its own.
PARTS = 32
#: Groups of partitions whose weights are averaged before those of all.
SALTS = 256
RATE = 0.02
#: Rows of states whose class probabilities are worked out at once.
SLAB = 512
#: Largest exponent taken as it is: exp(80) times the number of classes is still a float32.
FAR = 80
#: Documents scored side by side.
ABREAST = 1_024


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of a string column in their order, tokens of each text): lower-cased words, and the empty word as the end mark."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # White space at the end, or no text at all, leaves one empty word.
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), "", pc.binary_join_element_wise(trimmed, "", " ")))
    return lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy().astype(np.int64)


def bucket(word: bytes) -> int:
    return zlib.crc32(word[:2]) % BUCKETS


def word_counts(docs: DataFrame, name: str = "counts") -> DataFrame:
    """word, n: occurrences in all rows of (doc_id, text), counted within partitions before the shuffle.

    The empty word stands for the end mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for batch in batches:
            for part in chunks(batch, "text", 16_000_000):
                words, n = split(part.column(1))[0].value_counts().flatten()
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), n], ["word", "n"])

    return written(docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), name)


class Lexicon:
    """Counts of frequent words, classes of the shortlist and totals of the buckets; small enough to broadcast."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int, bucket_n: np.ndarray, bucket_v: np.ndarray):
        self.total, self.distinct = total, distinct
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        self.listed = pa.array(list(self.index), pa.binary())
        n = np.asarray([c for _, c in frequent], np.float64)
        self.n_short = min(SHORTLIST, len(frequent))
        self.n_classes = -(-self.n_short // CLASS_SIZE)
        self.log_count = np.log10(n + 0.5)
        self.log_total = float(np.log10(total + 0.5 * (distinct + 1)))
        self.input = np.asarray([i if i < self.n_short else SHORTLIST + bucket(w) for i, (w, _) in enumerate(frequent)], np.int64)
        self.log_bucket = np.log10(bucket_n + 0.5 * (bucket_v + 1))
        mass = np.zeros(self.n_classes + BUCKETS)
        np.add.at(mass, np.arange(self.n_short) // CLASS_SIZE, n[: self.n_short])
        mass[self.n_classes :] = bucket_n
        self.class_bias = np.log(mass + 1.0) - np.log(mass.sum() + len(mass))
        inner = np.full((self.n_classes, CLASS_SIZE), -30.0)
        inner.ravel()[: self.n_short] = np.log(n[: self.n_short] + 0.5)
        self.word_bias = inner - np.log(np.exp(inner).sum(axis=1, keepdims=True)) if self.n_classes else inner

    def target(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and place in the class of input ids (place -1 in a bucket)."""
        short = x < SHORTLIST
        return np.where(short, x // CLASS_SIZE, self.n_classes + x - SHORTLIST), np.where(short, x % CLASS_SIZE, -1)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table (-1 where unlisted) and input id of tokens."""
        at = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy()
        x = self.input[at] if len(self.input) else np.zeros(len(at), np.int64)
        miss = np.flatnonzero(at < 0)
        heads = pc.binary_slice(words.take(pa.array(miss)), 0, 2).dictionary_encode()
        x[miss] = SHORTLIST + np.asarray([bucket(w) for w in heads.dictionary.to_pylist()], np.int64)[heads.indices.to_numpy()]
        return at, x


class ClassGru:
    """Gated recurrent units over input ids, predicting class, then word within a shortlist class."""

    def __init__(self, lexicon: Lexicon, seed: int = 0):
        rng, h, c = np.random.default_rng(seed), HIDDEN, lexicon.n_classes + BUCKETS
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.lexicon = lexicon
        self.w = {
            "x": small(SHORTLIST + BUCKETS, 3 * h), "u": small(h, 3 * h), "c": small(h, c) * 0.1, "cb": lexicon.class_bias.astype(np.float32),
            "w": small(max(1, lexicon.n_classes), h, CLASS_SIZE) * 0.1, "wb": lexicon.word_bias.astype(np.float32).reshape(-1, CLASS_SIZE),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.steps = 0

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    def load(self, raw: bytes) -> ClassGru:
        self.w = {k: v for k, v in np.load(io.BytesIO(raw)).items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        return self

    def by_gate(self) -> tuple[np.ndarray, np.ndarray]:
        """Input and recurrent weights with the gates in front, so that a gate's values lie together; those of z and r negated."""
        gate = lambda v: np.ascontiguousarray(v.reshape(len(v), 3, HIDDEN).transpose(1, 0, 2))
        x, u = gate(self.w["x"]), gate(self.w["u"])
        for v in (x[:2], u[:2]):
            np.negative(v, out=v)
        return x, u

    @staticmethod
    def advance(gates: np.ndarray, u: np.ndarray, h: np.ndarray, a: np.ndarray, m: np.ndarray, new: np.ndarray) -> np.ndarray:
        """One step: a receives z, r and h @ u of the candidate, m the candidate, new the next state."""
        np.matmul(h, u, out=a)
        zr = a[:2]
        zr += gates[:2]
        np.exp(zr, out=zr)  # of the negated sum; infinity gives 0
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], a[2], out=m)
        m += gates[2]
        np.tanh(m, out=m)
        np.subtract(h, m, out=new)
        new *= zr[0]
        new += m
        return new

    def step(self, gates: np.ndarray, h: np.ndarray):
        """z, r, candidate, h @ u of the candidate and next state for rows of input weights."""
        signed = gates.reshape(len(gates), 3, HIDDEN).transpose(1, 0, 2) * np.asarray([-1, -1, 1], gates.dtype)[:, None, None]
        a, m, new = np.empty((3, *h.shape), h.dtype), np.empty_like(h), np.empty_like(h)
        with np.errstate(over="ignore"):
            self.advance(signed, self.by_gate()[1], h, a, m, new)
        return a[0], a[1], m, a[2], new

    def word_logs(self, h: np.ndarray, cls: np.ndarray, place: np.ndarray, gradient: bool = False):
        """Natural-log probability of each token given the state before it; with gradient, also d/dh and weight gradients."""
        w, n, kinds = self.w, len(h), self.w["c"].shape[1]
        out, total, grads = np.empty(n, h.dtype), np.empty(n, h.dtype), None
        wide = np.ones((n, HIDDEN + 1), h.dtype)  # biases are the weights of a last input of one
        wide[:, :-1] = h
        class_w, word_w = np.concatenate([w["c"], w["cb"][None]]), np.concatenate([w["w"][: len(w["wb"])], w["wb"][:, None]], axis=1)
        # Sums that cannot leave the range of exp need no maximum taken off.
        most = float(max(h.max(initial=0), -h.min(initial=0)))
        far = [most * float(np.abs(v).sum(axis=-2).max()) + float(np.abs(b).max(initial=0)) > FAR for v, b in ((w["c"], w["cb"]), (w["w"], w["wb"]))]
        if gradient:
            dh, class_g, word_g, back_w = np.empty_like(h), np.zeros_like(class_w.T), np.zeros_like(word_w), np.ascontiguousarray(w["c"].T)
        slab, ones, first = np.empty((SLAB, kinds), h.dtype), np.ones(kinds, h.dtype), np.arange(SLAB) * kinds
        for s in range(0, n, SLAB):  # what the class softmax works on stays in a core's cache
            hs = wide[s : s + SLAB]
            p = np.matmul(hs, class_w, out=slab[: len(hs)])
            if far[0]:
                p -= p.max(axis=1, keepdims=True)
            flat, at, sums = p.reshape(-1), first[: len(hs)] + cls[s : s + SLAB], total[s : s + SLAB]
            out[s : s + SLAB] = flat[at]
            np.exp(p, out=p)
            np.matmul(p, ones, out=sums)
            if gradient:
                p *= np.reciprocal(sums)[:, None]
                flat[at] -= 1
                class_g += p.T @ hs
                np.matmul(p, back_w, out=dh[s : s + SLAB])
        out -= np.log(total)
        short = np.flatnonzero(place >= 0)
        order = short[np.argsort(cls[short].astype(np.int16), kind="stable")]
        ends = np.cumsum(np.bincount(cls[short], minlength=1)).tolist()
        spans = [(k, s, e) for k, (s, e) in enumerate(zip([0, *ends], ends)) if e > s]
        hs, q, ones = wide[order], np.empty((len(order), CLASS_SIZE), h.dtype), np.ones(CLASS_SIZE, h.dtype)
        for k, s, e in spans:
            np.matmul(hs[s:e], word_w[k], out=q[s:e])
        if far[1] and len(q):
            q -= q.max(axis=1, keepdims=True)
        flat, at = q.reshape(-1), np.arange(len(q)) * CLASS_SIZE + place[order]
        more = flat[at]
        np.exp(q, out=q)
        sums = q @ ones
        more -= np.log(sums)
        out[order] += more
        if not gradient:
            return out
        q *= np.reciprocal(sums)[:, None]
        flat[at] -= 1
        back, back_w = np.empty((len(q), HIDDEN), h.dtype), np.ascontiguousarray(w["w"].transpose(0, 2, 1))
        for k, s, e in spans:
            word_g[k] = hs[s:e].T @ q[s:e]
            np.matmul(q[s:e], back_w[k], out=back[s:e])
        dh[order] += back
        grads = {"c": class_g[:, :-1].T, "cb": class_g[:, -1], "w": word_g[:, :-1], "wb": word_g[:, -1]}
        return out, dh, grads

    def scores(self, documents: list[np.ndarray], lanes: int = ABREAST) -> np.ndarray:
        """Log10 probability of classes and shortlist words of whole documents, in windows that carry the state."""
        out = np.zeros(len(documents))
        order = np.argsort([-len(d) for d in documents], kind="stable")
        for k in range(0, len(order), lanes):  # documents of like lengths side by side
            some = order[k : k + lanes]
            out[some] = self.side_by_side([documents[i] for i in some])
        return out / np.log(10.0)

    def side_by_side(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural-log probabilities of documents sorted by falling length, each a lane."""
        lengths, out = np.asarray([len(d) for d in documents]), np.zeros(len(documents))
        flat, first = np.concatenate(documents), np.cumsum(lengths) - lengths
        h, t, (table, u) = np.zeros((len(lengths), HIDDEN), np.float32), 0, self.by_gate()
        span = min(4 * WINDOW, int(lengths[0]))
        gates, a, m = (np.empty(k * h.size, h.dtype) for k in (3, 3, 1))
        while t < lengths[0]:
            span = min(span, int(lengths[0]) - t)
            wide = np.searchsorted(-lengths, -np.arange(t, t + span), side="left").tolist()  # lanes of each step
            ends = np.cumsum(wide).tolist()
            xs, states = np.empty(ends[-1], np.int64), np.empty((ends[-1], HIDDEN), h.dtype)
            for s, (lanes, e) in enumerate(zip(wide, ends)):
                x, state, size = xs[e - lanes : e], states[e - lanes : e], lanes * HIDDEN
                np.take(flat, first[:lanes] + (t + s), out=x, mode="clip")
                state[:] = h[:lanes]
                h, g = h[:lanes], gates[: 3 * size].reshape(3, lanes, HIDDEN)
                for k in range(3):
                    np.take(table[k], x, axis=0, out=g[k], mode="clip")
                with np.errstate(over="ignore"):
                    self.advance(g, u, state, a[: 3 * size].reshape(3, lanes, HIDDEN), m[:size].reshape(lanes, HIDDEN), h)
            cls, place = self.lexicon.target(xs)
            logs, e = self.word_logs(states, cls, place), 0
            for lanes in wide:
                out[:lanes] += logs[e : e + lanes]
                e += lanes
            t += span
        return out

    def train(self, documents: list[np.ndarray], rate: float = RATE, seed: int = 0) -> None:
        """One pass of truncated backpropagation over streams of documents, with Adam."""
        if not documents:
            return
        order = np.random.default_rng(seed).permutation(len(documents))
        flat = np.concatenate([documents[i] for i in order])
        first = np.cumsum([0, *[len(documents[i]) for i in order[:-1]]])
        # Lanes of equal length: one may begin inside a document, which it enters without a state.
        steps = -(-len(flat) // LANES)
        x, start = np.zeros(steps * LANES, np.int64), np.zeros(steps * LANES, bool)
        x[: len(flat)], start[first] = flat, True
        real = np.arange(steps * LANES) < len(flat)
        x, start, real = (np.ascontiguousarray(v.reshape(LANES, steps).T) for v in (x, start, real))
        h = np.zeros((LANES, HIDDEN), np.float32)
        for t in range(0, steps, WINDOW):
            h = self.window(x[t : t + WINDOW], start[t : t + WINDOW], real[t : t + WINDOW], h, rate)

    def window(self, x, start, real, h, rate):
        n, w, (steps, lanes) = HIDDEN, self.w, x.shape
        table, u = self.by_gate()
        gates, acts, da = (np.empty((3, steps, lanes, n), h.dtype) for _ in range(3))
        for g in range(3):
            np.take(table[g], x, axis=0, out=gates[g], mode="clip")
        before, m = np.empty((steps + 1, lanes, n), h.dtype), np.empty((steps, lanes, n), h.dtype)
        before[0], fresh = h, [np.flatnonzero(v) for v in start]
        with np.errstate(over="ignore"):
            for s in range(steps):
                before[s, fresh[s]] = 0
                self.advance(gates[:, s], u, before[s], acts[:, s], m[s], before[s + 1])
        last, before, (z, r, turned) = before[steps].copy(), before[:steps], acts
        every, mask = before.reshape(-1, n), real.ravel()
        cls, place = self.lexicon.target(x.ravel())
        rows = np.flatnonzero(mask)
        full = len(rows) == len(mask)
        _, dh_rows, grads = self.word_logs(every if full else every[rows], cls if full else cls[rows], place if full else place[rows], True)
        dh_out = dh_rows
        if not full:
            dh_out = np.zeros_like(every)
            dh_out[rows] = dh_rows
        dh_out = dh_out.reshape(before.shape)
        # What a step's gradient is multiplied by, for all steps at once, in the place of its gates.
        by_z, by_m, by_r = gates
        np.subtract(1, z, out=by_m)
        np.subtract(before, m, out=by_z)
        by_z *= z
        by_z *= by_m
        np.multiply(m, m, out=by_r)
        np.subtract(1, by_r, out=by_r)
        by_m *= by_r
        np.subtract(1, r, out=by_r)
        by_r *= r
        by_r *= turned
        dm, back, some = turned, np.zeros_like(h), np.empty((3, lanes, n), h.dtype)
        turn = np.ascontiguousarray(w["u"].T).reshape(3, n, n)
        for s in range(steps - 1, -1, -1):
            np.multiply(back, by_m[s], out=dm[s])
            np.multiply(back, by_z[s], out=da[0, s])
            np.multiply(dm[s], by_r[s], out=da[1, s])
            np.multiply(dm[s], r[s], out=da[2, s])
            back *= z[s]
            np.matmul(da[:, s], turn, out=some)
            for v in some:
                back += v
            back += dh_out[s]
            back[fresh[s]] = 0
        grads["u"] = np.matmul(every.T, da.reshape(3, -1, n)).transpose(1, 0, 2).reshape(n, 3 * n)
        at = x.ravel().astype(np.int16)
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=len(w["x"]))
        found = np.flatnonzero(counts)
        by_row = np.empty((len(at), 3, n), h.dtype)
        for g, v in enumerate((da[0], da[1], dm)):
            by_row[:, g] = v.reshape(-1, n)[order]
        grads["x"] = np.zeros_like(w["x"])
        grads["x"][found] = np.add.reduceat(by_row.reshape(-1, 3 * n), (np.cumsum(counts) - counts)[found], axis=0)
        self.adam({k: v / max(1, len(rows)) for k, v in grads.items()}, rate)
        return last

    def adam(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale, fix1, fix2 = min(1.0, 1.0 / (norm + 1e-9)), 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for k, g in grads.items():
            m, v = self.moments[k]
            g = g * scale
            by = g * 0.1
            m *= 0.9
            m += by
            np.multiply(g, g, out=by)
            by *= 0.001
            v *= 0.999
            v += by
            np.multiply(v, 1 / fix2, out=by)
            np.sqrt(by, out=by)
            by += 1e-8
            np.divide(m, by, out=by)
            by *= rate / fix1
            self.w[k] -= by


def lexicon_of(counts: DataFrame) -> Lexicon:
    """Totals and the most frequent words; at most TABLE rows and the small histograms reach the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # A histogram of some hundred levels, each in 256 parts by a hash, finds where to cut: words of one count fill the table too.
    level = (F.floor(F.log2("n") * 16) * 256 + F.pmod(F.xxhash64("word"), F.lit(256))).cast("int")
    sizes = sorted(counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.l)
    cut, room = None, TABLE
    for r in sizes:
        room -= r.k
        if room < 0:
            break
        cut = r.l
    top = counts.where(level >= cut).collect() if cut is not None else []
    top = sorted(top, key=lambda r: (-r.n, r.word))
    frequent = [(r.word.encode(), int(r.n)) for r in top]
    key = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), 1, 2)), F.lit(BUCKETS)).alias("b")
    n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r.b], v[r.b] = r.n, r.v
    for w, c in frequent[:SHORTLIST]:
        n[bucket(w)] -= c
        v[bucket(w)] -= 1
    return Lexicon(frequent, int(total), int(distinct), n, v)


def trained_weights(train_docs: DataFrame, lexicon) -> tuple[bytes, int]:
    """(weights, tokens trained on): one pass over all rows in rounds; partitions' weights are averaged by tokens.

    lexicon: a broadcast Lexicon.
    """
    shards = train_docs.coalesce(max(1, -(-lexicon.value.total // SHARD)))
    turns = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    model = ClassGru(lexicon.value)
    names, shapes = list(model.w), [v.shape for v in model.w.values()]
    kinds = "part int, salt int, w binary, n long"
    weights, seen = model.dump(), 0

    def one_round(shared, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state()
            words = lexicon.value
            own, held, size, total = ClassGru(words).load(shared.value), [], 0, 0
            rate = RATE / (1 + turn)
            for batch in batches:
                for part in chunks(batch, "text"):
                    found, n = split(part.column(1))
                    for ids in np.split(words.ids(found)[1], np.cumsum(n)[:-1]):
                        held.append(ids)
                        size += len(ids)
                        if size >= HELD:
                            own.train(held, rate, seed=turn)
                            held, size, total = [], 0, total + size
            own.train(held, rate, seed=turn)
            total += size
            if total:
                flat = np.concatenate([own.w[k].ravel() for k in names]).astype(np.float32)
                cut = [x.tobytes() for x in np.array_split(flat, PARTS)]
                salt = TaskContext.get().partitionId() % SALTS
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([salt] * PARTS, pa.int32()), pa.array(cut, pa.binary()), pa.array([total] * PARTS, pa.int64())], ["part", "salt", "w", "n"])

        return run

    def averaged(rows: pa.Table) -> pa.Table:
        found = sorted(zip(rows.column("n").to_pylist(), rows.column("w").to_pylist()))  # sums do not depend on the order of arrival
        n = sum(k for k, _ in found)
        w = sum(np.frombuffer(raw, np.float32).astype(np.float64) * k for k, raw in found) / n
        return pa.table({"part": rows.column("part")[:1], "salt": rows.column("salt")[:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    for turn in range(ROUNDS):
        shared = train_docs.sparkSession.sparkContext.broadcast(weights)
        fitted = shards.where(turns == turn).mapInArrow(one_round(shared, turn), kinds)
        some = fitted.groupBy("part", "salt").applyInArrow(averaged, kinds)  # a tree, so that no task meets all partitions
        got = sorted(some.groupBy("part").applyInArrow(averaged, kinds).collect(), key=lambda r: r.part)
        if not got:
            continue
        flat = np.frombuffer(b"".join(bytes(r.w) for r in got), np.float32)
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        model.w = {k: v.reshape(x) for k, v, x in zip(names, np.split(flat, ends[:-1]), shapes)}
        weights, seen = model.dump(), seen + got[0].n
    return weights, seen


ROWS = "doc_id long, h long, word string, tf long, docs long, n_tokens long, n_known long, base double, score double"


def scores(docs: DataFrame, is_train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; is_train: a column over doc_id."""
    docs = keyed(docs)
    spark = docs.sparkSession
    train = docs.where(is_train)
    counts = word_counts(train)
    lexicon = spark.sparkContext.broadcast(lexicon_of(counts))
    weights = spark.sparkContext.broadcast(trained_weights(train, lexicon)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        worker_state()
        model, names = ClassGru(words).load(weights.value), [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            for part in chunks(batch, "text", 16_000_000):
                ids, hashes, (found, lengths) = part.column(0), part.column(2), split(part.column(1))
                at, x = words.ids(found)
                n, first = len(lengths), np.cumsum(lengths) - lengths
                logs = model.scores(np.split(x, first[1:]))
                # What a token adds to the base score and within its bucket, but for counts that are not in the table.
                listed, in_bucket = at >= 0, x >= SHORTLIST
                base = np.where(listed, words.log_count[at], 0.0) if len(words.log_count) else np.zeros(len(at))
                rest = np.where(in_bucket, base - words.log_bucket[np.where(in_bucket, x - SHORTLIST, 0)], 0.0)
                of_text = lambda v: np.add.reduceat(v, first)
                # A document's own row joins no count: its word holds a space.
                own = pa.array([f" {d} {h}" for d, h in zip(ids.to_pylist(), hashes.to_pylist())], pa.string())
                of = lambda values, kind=np.int64: pa.array(np.asarray(values, kind))
                zero = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([ids, hashes, own, of(zero), of(zero + 1), of(lengths), of(of_text(listed.astype(np.int64))), of(of_text(base) - lengths * words.log_total, np.float64), of(logs + of_text(rest), np.float64)], names)
                unlisted = np.flatnonzero(~listed)
                rare = found.take(pa.array(unlisted)).dictionary_encode()
                kinds = max(1, len(rare.dictionary))
                pairs, times = np.unique(np.repeat(np.arange(n), lengths)[unlisted] * kinds + rare.indices.to_numpy(), return_counts=True)
                text, word = (pa.array(v) for v in np.divmod(pairs, kinds))
                zero = np.zeros(len(pairs), np.int64)
                none = of(zero, np.float64)
                yield pa.RecordBatch.from_arrays([ids.take(text), hashes.take(text), rare.dictionary.take(word).cast(pa.string()), of(times), of(zero), of(zero), of(zero), none, none], names)

    rows = docs.withColumn("h", F.xxhash64("text")).mapInArrow(run, ROWS)
    joined = rows.join(counts.withColumnRenamed("n", "c"), "word", "left")
    rare = F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    seen = F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(F.lit(0))
    by = joined.groupBy("doc_id", "h").agg(
        F.sum("docs").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + seen).alias("n_known"), F.sum(F.col("base") + rare).alias("base"), F.sum(F.col("score") + rare).alias("score")
    )
    each = by.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    share = lambda c: (F.col(c) / F.col("copies")).alias(c)
    return each.select(
        "doc_id", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(lexicon.value.total).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("score")
    )


def op4_gru_lm(spark, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    found = scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
