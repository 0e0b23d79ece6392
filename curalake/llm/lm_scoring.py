"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts the class of a token from the two tokens before it. Classes are the end, the most
frequent words one by one, and all other words by a hash of their last bytes:

    log P(class w | c1, c2) = (r[c1] A + r[c2] B) . q[w] + b[w] - log Z(c1, c2)

and a word of a shared class has the probability (count + 1) / (count of the class + words of the class + 1)
in it, which leaves one part for all unknown words of the class. Given the class matrices
M1 = r A q' and M2 = r B q', Z for all pairs of contexts is one product of matrices,
exp(M1) (exp(M2) exp(b))', so every log-probability is normalised exactly and is a sum of four look-ups.

Training: counts of all training words are aggregated (a table, joined where it is needed; only the
FREQUENT most frequent words are broadcast). All training tokens are then used once, in ROUNDS parts; in
a part each task starts from the same parameters, makes steps on batches with noise drawn from the class
frequencies, and the parameters of the tasks are averaged by their tokens.

The counts of words that aren't broadcast are found by a join on the word; those words have small counts, so
no key of the join is hot.

Defined results: a null text is empty and has the end as its one token; equal rows get equal scores, one
row each; without training documents N and all counts are 0 and the model is uniform over its classes. Long words are
counted like others but never broadcast. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import LOWER, id_crc32, saved, text_bytes

#: Classes of one word, and classes of all other words. Class 0 is the end, and stands before the first word.
TOP, SHARED = 767, 256
CLASSES = 1 + TOP + SHARED
WIDTH = 24
#: Most words broadcast, and the longest of them in bytes.
FREQUENT, LONGEST = 300_000, 64
ROUNDS = 2
BATCH, NOISE, RATE = 2048, 64, 0.05
#: Tokens scored together.
BLOCK = 500_000


def shared_class(word: bytes) -> int:
    return 1 + TOP + zlib.crc32(word[-3:]) % SHARED


class Codes(dict):
    """Word to code: the place of a frequent word, or FREQUENT + its class. Read through []; bounded."""

    def __init__(self, frequent: list[bytes], limit: int = 200_000):
        super().__init__(zip(frequent, range(len(frequent))))
        self.frequent, self.most = frequent, len(frequent) + limit

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(zip(self.frequent, range(len(self.frequent))))
        code = self[word] = FREQUENT + shared_class(word)
        return code


@dataclass
class Vocabulary:
    """Bounded by FREQUENT and CLASSES. frequent is in the order of count; the empty word is the end."""

    frequent: list[bytes]
    counts: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int

    def classes(self) -> np.ndarray:
        """The class of each code."""
        out = np.zeros(FREQUENT + CLASSES, np.int32)
        top = 0
        for k, w in enumerate(self.frequent):
            if not w:
                continue
            if top < TOP:
                top += 1
                out[k] = top
            else:
                out[k] = shared_class(w)
        out[FREQUENT:] = np.arange(CLASSES)
        return out


@dataclass
class Parameters:
    r: np.ndarray
    q: np.ndarray
    a: np.ndarray
    b: np.ndarray
    bias: np.ndarray

    def rows(self) -> np.ndarray:
        """All parameters as rows of WIDTH."""
        bias = np.zeros(-(-CLASSES // WIDTH) * WIDTH)
        bias[:CLASSES] = self.bias
        return np.concatenate([self.r, self.q, self.a, self.b, bias.reshape(-1, WIDTH)])

    @classmethod
    def of(cls, rows: np.ndarray) -> Parameters:
        r, q, a, b, bias = np.split(rows, np.cumsum([CLASSES, CLASSES, WIDTH, WIDTH]))
        return cls(r.copy(), q.copy(), a.copy(), b.copy(), bias.ravel()[:CLASSES].copy())


def tokens(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[list[bytes], list[int], pa.RecordBatch]]:
    """Blocks of documents: their tokens one after the other, where each document starts, and their rows."""
    for batch in batches:
        at, words, starts = 0, [], []
        for k, text in enumerate(batch.column(column)):
            starts.append(len(words))
            words += text.as_py().translate(LOWER).split()
            words.append(b"")
            if len(words) >= BLOCK or k + 1 == batch.num_rows:
                yield words, starts, batch.slice(at, k + 1 - at)
                at, words, starts = k + 1, [], []


def _contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the token before each token and of the one before that."""
    c1, c2 = np.zeros_like(classes), np.zeros_like(classes)
    c1[1:], c2[2:] = classes[:-1], classes[:-2]
    c1[starts] = c2[starts] = 0
    return c1, c2


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens of texts; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for words, _, _ in tokens(batches):
            held.update(words)
            if len(held) > FREQUENT:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # How many words have a count of at least each power of 2 ** (1 / 16): the least of these that few enough words reach.
    power = F.floor(F.log2("n") * 16)
    short = counts.where(F.octet_length("word") <= LONGEST)
    held, least = 0, 1 << 40
    for r in sorted(short.groupBy(power.alias("power")).count().collect(), key=lambda r: -r[0]):
        held += r[1]
        if held > FREQUENT:
            break
        least = r[0]
    rows = sorted((-r.n, r.word.encode()) for r in short.where(power >= least).collect())  # FREQUENT rows at most
    words, n = [w for _, w in rows], np.array([-c for c, _ in rows], np.int64)
    single = {b"", *[w for w in words if w][:TOP]}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = w.encode()
                if w not in single:
                    g = shared_class(w)
                    c[g] += k
                    v[g] += 1
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at]), pa.array(v[at])], ["g", "c", "v"])

    class_counts, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.mapInArrow(sums, "g long, c long, v long").groupBy("g").agg(F.sum("c"), F.sum("v")).collect():
        class_counts[r[0]], class_words[r[0]] = r[1], r[2]
    out = Vocabulary(words, n, class_counts, class_words, totals.n or 0, totals.v)
    classes = out.classes()
    for k in range(len(words)):
        if classes[k] <= TOP:
            class_counts[classes[k]] = n[k]
    return out


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of rows by index."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return index[first], np.add.reduceat(rows[order], first, axis=0)


def steps(p: Parameters, c1: np.ndarray, c2: np.ndarray, w: np.ndarray, noise: np.ndarray, rng: np.random.Generator, squares: list[np.ndarray]) -> None:
    """Noise-contrastive steps over the tokens, in place."""
    log_noise = np.log(noise * NOISE)
    cumulated = np.cumsum(noise)
    order = rng.permutation(len(w))
    for at in range(0, len(w), BATCH):
        k = order[at : at + BATCH]
        x1, x2, y = c1[k], c2[k], w[k]
        n = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), CLASSES - 1)
        r1, r2 = p.r[x1], p.r[x2]
        h = r1 @ p.a + r2 @ p.b
        data = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, p.q[y]) + p.bias[y] - log_noise[y]))  # 1 - P(from the text)
        false = -1 / (1 + np.exp(-(h @ p.q[n].T + p.bias[n] - log_noise[n])))
        dh = data[:, None] * p.q[y] + false @ p.q[n]
        index, dq = _summed(np.r_[y, n], np.r_[data[:, None] * h, false.T @ h])
        at_bias, db = _summed(np.r_[y, n], np.r_[data, false.sum(0)][:, None])
        at_r, dr = _summed(np.r_[x1, x2], np.r_[dh @ p.a.T, dh @ p.b.T])
        for held, square, rows, grad in ((p.q, squares[0], index, dq), (p.r, squares[1], at_r, dr), (p.bias[:, None], squares[2], at_bias, db), (p.a, squares[3], slice(None), r1.T @ dh), (p.b, squares[4], slice(None), r2.T @ dh)):
            square[rows] += grad**2
            held[rows] += RATE * grad / np.sqrt(square[rows])


def train(texts: DataFrame, vocab: Vocabulary) -> Parameters:
    """texts: text, part. Parameters after one pass over all texts."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    rng = np.random.default_rng(1)
    noise = (vocab.class_counts + 1) / (vocab.class_counts + 1).sum()
    p = Parameters(rng.normal(0, 0.1, (CLASSES, WIDTH)), rng.normal(0, 0.1, (CLASSES, WIDTH)), np.eye(WIDTH), np.eye(WIDTH) * 0.5, np.log(noise))
    for turn in range(ROUNDS):
        before = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = Parameters.of(before.value.rows())
            codes, classes = Codes(shared.value.frequent), shared.value.classes()
            rng = np.random.default_rng(TaskContext.get().partitionId())
            squares = [np.full(x.shape, 1.0) for x in (p.q, p.r, p.bias[:, None], p.a, p.b)]
            n = 0
            for words, starts, _ in tokens(batches):
                w = classes[np.fromiter(map(codes.__getitem__, words), np.int64, len(words))]
                steps(p, *_contexts(w, np.array(starts)), w, noise, rng, squares)
                n += len(w)
            if n:
                rows = p.rows()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(n))), *(pa.array(c) for c in rows.T)], ["row", "n", *(f"x{i}" for i in range(WIDTH))])

        schema = "row long, n double, " + ", ".join(f"x{i} double" for i in range(WIDTH))
        sums = [F.sum(F.col(f"x{i}") * F.col("n")) / F.sum("n") for i in range(WIDTH)]
        rows = sorted(texts.where(F.col("part") % ROUNDS == turn).select("text").mapInArrow(run, schema).groupBy("row").agg(*sums).collect())  # the size of the model
        if rows:
            p = Parameters.of(np.array([r[1:] for r in rows]))
    return p


class Tables:
    """What scoring looks up, made in each task from the parameters."""

    def __init__(self, p: Parameters, vocab: Vocabulary):
        self.m1, self.m2, self.bias = p.r @ p.a @ p.q.T, p.r @ p.b @ p.q.T, p.bias
        high = self.m1.max(1, keepdims=True), self.m2.max(1, keepdims=True)
        z = np.exp(self.m1 - high[0]) @ (np.exp(self.m2 - high[1]) * np.exp(p.bias)).T
        self.log_z = np.log(z) + high[0] + high[1].T
        self.codes, self.classes = Codes(vocab.frequent), vocab.classes()
        share = np.log10(vocab.class_counts + vocab.class_words + 1.0)
        self.log_count = np.zeros(FREQUENT + CLASSES)
        self.log_count[: len(vocab.counts)] = np.log10(vocab.counts + 1.0)
        self.inside = np.where(self.classes > TOP, self.log_count - share[self.classes], 0.0)
        self.base = np.log10(vocab.tokens + vocab.words + 1.0)

    def log10_p(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        return (self.m1[c1, w] + self.m2[c2, w] + self.bias[w] - self.log_z[c1, c2]) / np.log(10)


def _parts(rows: DataFrame, p: Parameters, vocab: Vocabulary) -> DataFrame:
    """For each document a row of sums over the tokens whose counts are broadcast, and a row for each other word of it."""
    shared = rows.sparkSession.sparkContext.broadcast((p, vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(*shared.value)
        row = TaskContext.get().partitionId() << 33
        for words, starts, docs in tokens(batches):
            codes = np.fromiter(map(t.codes.__getitem__, words), np.int64, len(words))
            at = np.array(starts)
            w = t.classes[codes]
            value = t.log10_p(w, *_contexts(w, at)) + t.inside[codes]
            n = np.diff(np.r_[at, len(words)])
            known = np.add.reduceat((codes < FREQUENT).astype(np.int64), at)
            base = np.add.reduceat(t.log_count[codes], at) - n * t.base
            ids = row + np.arange(len(at))
            other = np.flatnonzero(codes >= FREQUENT)
            tail = Counter(zip((np.searchsorted(at, other, side="right") - 1).tolist(), map(words.__getitem__, other.tolist())))
            row += len(at)
            none = lambda kind, k: pa.nulls(k, kind)
            k = len(at)
            columns = [pa.array(ids), docs.column("id"), docs.column("held_out"), pa.array(n), pa.array(known), pa.array(base), pa.array(np.add.reduceat(value, at)), none(pa.string(), k), none(pa.int64(), k)]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)
            if tail:
                k = len(tail)
                doc, word = zip(*tail)
                columns = [pa.array(ids[np.array(doc)]), none(pa.int64(), k), none(pa.bool_(), k), none(pa.int64(), k), none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k), pa.array(word, pa.binary()).cast(pa.string()), pa.array(tail.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return saved(rows.mapInArrow(run, _PARTS), "parts")


_PARTS = "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, word string, uses long"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (id_crc32(id_col) % folds == held).alias("held_out"), (id_crc32(id_col) / folds).cast("long").alias("part"), text_bytes(text_col).alias("text"))
    learn = rows.where("not held_out").select("text", "part")
    counts = saved(word_counts(learn.select("text")), "counts")
    vocab = vocabulary(counts)
    parts = _parts(rows.select("id", "held_out", "text"), train(learn, vocab), vocab)
    # A word that isn't in the counts adds log10(0 + 1) = 0.
    tail = parts.where("word is not null").select("row", "word", "uses").join(counts, "word")
    tail = tail.groupBy("row").agg(F.sum("uses").alias("known"), F.sum(F.col("uses") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"))
    out = parts.where("word is null").drop("word", "uses").join(tail, "row", "left")
    logs = F.coalesce(F.col("logs"), F.lit(0.0))
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("known"), F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
