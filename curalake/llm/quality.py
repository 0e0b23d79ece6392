"""Quality by positive-unlabelled learning.

A linear model on features of the text minimises the non-negative unbiased risk

    prior * R(P, +1) + max(0, R(U, -1) - prior * R(P, -1))

with the logistic loss: P are trusted positives, U is web text whose labels aren't looked at, prior is the
estimated share of positives. When the second part falls below zero, its gradient is followed upwards.
The prior is the share of positives among the labels that may be learned from, kept between 0.05 and 0.98: with
positive labels only it is 0.98, and every score is near that.

P and U are samples of at most POSITIVES and UNLABELLED rows, in the order of a hash of the id; every
document is scored. Features: counts of hashed byte trigrams, and shares of signs, capitals, repeats and
distinct words over the whole text.

Defined results: null and empty texts have the same features and score; labels that are null or of other
documents are not used; an id that repeats among the sampled ones is learned from once, by the smallest hash of its
texts; without trusted positives or web text every score is 0.5; very long texts are read whole; equal rows get equal
scores; an empty table gives no rows. Columns other than id and text are not read, so their names may clash with any here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import id_crc32, text_bytes

POSITIVES = 6000
UNLABELLED = 12000
BUCKETS = 512
THRESHOLD = 0.3
#: The prior stays between these, so that labels of one class alone don't decide every score.
LEAST_PRIOR, MOST_PRIOR = 0.05, 0.98
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b"\t", b".", b",", b"!", b"?", b"|", b"#$%&*~^", b"\"'`", b"()[]{}<>", b":;", b"-_=+/\\@", bytes(range(128, 256))]
_KIND = np.zeros((256, len(_KINDS)))
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes), _k] = 1
STATISTICS = len(_KINDS) + 8
SIZE = STATISTICS + BUCKETS


def features(text: bytes) -> np.ndarray:
    """Features of a whole text; zeros for the empty text."""
    out = np.zeros(SIZE, np.float32)
    n = len(text)
    words = text.split()
    if not words:
        return out
    b = np.frombuffer(text, np.uint8)
    out[: len(_KINDS)] = np.sqrt(np.bincount(b, minlength=256) @ _KIND / n)
    w = len(words)
    lines = text.split(b"\n")
    blocks = [len(set(words[i : i + 64])) / len(words[i : i + 64]) for i in range(0, w, 64)]
    own = out[len(_KINDS) : STATISTICS]
    own[0] = np.log1p(n) / 10
    own[1] = n / w / 10
    own[2] = sum(map(eq, words, words[1:])) / w
    own[3] = sum(map(eq, words, words[2:])) / w
    own[4] = sum(blocks) / len(blocks)
    own[5] = len(set(lines)) / len(lines)
    if n > 2:
        x = b.astype(np.uint32)
        h = (x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA6B + x[2:] * 0xC2B2AE35).astype(np.uint32) * np.uint32(0x27D4EB2F) >> np.uint32(23)
        p = np.bincount(h, minlength=BUCKETS) / (n - 2)
        out[STATISTICS:] = np.sqrt(p)
        own[6] = -(p[p > 0] * np.log(p[p > 0])).sum() / 6
        own[7] = p.max()
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risks(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of positives, and what is left of unlabelled rows as negatives (before it is cut at 0)."""
    zp, zu = p @ theta, u @ theta
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def gradients(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of both parts."""
    zp, zu = p @ theta, u @ theta
    return -prior * (_logistic(-zp) @ p) / len(p), (_logistic(zu) @ u) / len(u) - prior * (_logistic(zp) @ p) / len(p)


def minimise_risk(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, batch: int = 1024, rate: float = 0.01, decay: float = 1e-3, seed: int = 0) -> QualityModel:
    """The model of least non-negative risk, by Adam on batches."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = np.c_[(p - mean) / scale, np.ones(len(p))], np.c_[(u - mean) / scale, np.ones(len(u))]
    theta = np.zeros(p.shape[1])
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        up, down = gradients(theta, a, b, prior)
        grad = (up + down if risks(theta, a, b, prior)[1] >= 0 else -down) + decay * np.r_[theta[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, theta[:-1], float(theta[-1]))


def _features(rows: DataFrame) -> np.ndarray:
    """Features of the sampled rows (text), brought to the driver in the order of h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], ["h", "x"])

    got = sorted((r.h, bytes(r.x)) for r in rows.select("h", "text").mapInArrow(run, "h string, x binary").collect())
    return np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(-1, SIZE)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    learn = id_crc32(id_col) % 5 != 0
    key = F.col(id_col).cast("long")
    marked = labels.where(learn).select(key.alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    share = marked.agg(F.avg("y")).first()[0]
    h = F.md5(F.col("id").cast("string"))
    trusted = F.broadcast(marked.where("y = 1").select("id", h.alias("h")).orderBy("h", "id").limit(POSITIVES))  # POSITIVES rows at most
    ids = docs.where(learn).select(key.alias("id")).where("id is not null").select("id", h.alias("h")).orderBy("h", "id").limit(UNLABELLED)
    web = F.broadcast(ids.dropDuplicates(["id"]))  # UNLABELLED rows at most
    texts = docs.where(learn).select(key.alias("id"), text_bytes(text_col).alias("text"))
    # One row for an id that repeats, so that the bounds on ids hold for rows.
    one = lambda sample: texts.join(sample, "id").groupBy("id", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    p, u = _features(one(trusted)), _features(one(web))
    if not len(p) or not len(u):
        return None
    prior = min(max(share, LEAST_PRIOR), MOST_PRIOR)
    return minimise_risk(p.astype(np.float64), u.astype(np.float64), prior)


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if shared.value is None:
                    s = np.full(part.num_rows, 0.5)
                else:
                    s = shared.value.scores(np.stack([features(x.as_py()) for x in part.column(2)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_crc32(id_col) % 5 == 0).alias("held_out"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
