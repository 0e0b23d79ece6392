"""Exact top-k inner products over vectors sorted by norm.

Vectors are integers, floor(1024 * x). They are range-partitioned by descending norm and written to the
shared folder, with the matrix of their second moments; its eigenvectors (the right singular vectors of
the table) rotate vectors so that the first coordinates hold most of every product.

Queries are taken in blocks of bounded size, and each block is broadcast. The partition of the largest norms
gives every query a first k-th best score. Then every partition is processed in chunks of descending norm:

* a query is finished in a task when its norm times the largest norm left is below its k-th best score;
* otherwise the partial sum over the first rotated coordinates, plus the product of the norms of the rest
  (Cauchy-Schwarz), bounds each product from above, and only pairs whose bound reaches the k-th best score are
  multiplied out, in exact integers.

Each task gives at most k rows for a query; a window over them gives the result. A block is a pass over all vectors
that multiplies each of them with QUERIES queries, so reading is the small part of it; the hits of all blocks are one table.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; rows that repeat an id are candidates each, and as a query the id is
asked once, with its smallest vector; a null id is a candidate, after all others in a tie, and no query.
Scores beyond 64 bits are cut to the largest or smallest long; an empty table gives no rows. Columns other than id and
vector are not read, so their names may clash with any here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curalake.llm.common import LAST_ID, saved, shared_path

SCALE = 1024
#: Queries broadcast together.
QUERIES = 2048
#: Rotated coordinates of the partial sums.
FIRST = 16
CHUNK = 1024
#: Below this an integer is exact as a double, and so is each sum on the way to it.
_EXACT = float(1 << 53)


@dataclass
class Block:
    """Queries of one block, with the k-th best scores known so far."""

    ids: np.ndarray
    vectors: np.ndarray
    rotation: np.ndarray
    least: np.ndarray


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(n) and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    for row, at, k in zip(out, np.cumsum(n) - n, n):
        row[:k] = flat[at : at + k]
    return out


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each query are."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _products(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of the pairs (x[i], q[j])."""
    if largest < _EXACT:
        if len(i) * 4 > len(x) * len(q):
            return np.rint((x @ q.T)[i, j]).astype(np.int64)
        return np.concatenate([np.rint(np.einsum("ij,ij->i", x[i[a : a + 65536]], q[j[a : a + 65536]])).astype(np.int64) for a in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([max(low, min(high, sum(int(a) * int(b) for a, b in zip(x[m], q[n])))) for m, n in zip(i, j)], np.int64)


def _search(block: Block, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        least = b.least.copy()
        q, rotated = b.vectors, b.vectors @ b.rotation
        q_norm, q_rest = np.linalg.norm(q, axis=1), np.linalg.norm(rotated[:, FIRST:], axis=1)
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        step = 64
        for batch in batches:
            ids, x_all = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            at = 0
            while at < len(ids):
                x, own = x_all[at : at + step], ids[at : at + step]
                at, step = at + step, min(CHUNK, step * 2)
                norm = np.linalg.norm(x, axis=1)
                top = norm.max()
                slack = 1e-9 * top * q_norm + 1
                open_q = np.flatnonzero(top * q_norm + slack >= least)
                if not len(open_q):
                    continue
                turned = x @ b.rotation
                bound = turned[:, :FIRST] @ rotated[open_q, :FIRST].T + np.outer(np.linalg.norm(turned[:, FIRST:], axis=1), q_rest[open_q])
                i, j = np.nonzero((bound + slack[open_q] >= least[open_q]) & (own[:, None] != b.ids[open_q]))
                j = open_q[j]
                score = _products(x, q, i, j, top * q_norm.max())
                good = score >= least[j]
                kept = tuple(np.concatenate([a, c[good]]) for a, c in zip(kept, (j, score, own[i])))
                best = _best(*kept, k)
                kept = tuple(a[best] for a in kept)
                n = np.bincount(kept[0], minlength=len(q))
                full = np.flatnonzero(n >= k)
                worst = np.full(len(q), np.iinfo(np.int64).max)
                np.minimum.at(worst, kept[0], kept[1])
                least[full] = np.maximum(least[full], worst[full])
        yield pa.RecordBatch.from_arrays([pa.array(b.ids[kept[0]]), pa.array(kept[2]), pa.array(kept[1])], ["query_id", "key", "score"])

    return run


_HITS = "query_id long, key long, score long"


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            x = x / max(1.0, np.abs(x).max(initial=0) / 1e6)
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32))], ["key", "x", "norm", "part"])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by `every`, against all other rows."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # The whole part in doubles: floor() to a long would overflow for the largest floats.
    floor = lambda y: y - F.pmod(y, F.lit(1.0))
    scaled = F.transform(v, lambda x: floor(x.cast("double") * SCALE))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y))
    rows = vectors.where(v.isNotNull()).where(~bad & (F.size(v) > 0)).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("key"), scaled.alias("x")).withColumn("norm", norm)
    ordered = rows.repartitionByRange(F.desc("norm"), "key").sortWithinPartitions(F.desc("norm"), "key")
    table = saved(ordered.mapInArrow(_mark, "key long, x array<double>, norm double, part int"), "vectors")
    width = table.agg(F.max(F.size("x"))).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not width:
        return empty
    moments = np.zeros((width, width))
    for r in table.select("x").mapInArrow(_moments(width), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # width * width rows
        moments[r.i, r.j] = r.s
    rotation = np.linalg.eigh(moments)[1][:, ::-1].copy()
    first = table.agg(F.min("part")).first()[0]
    asked = table.where(F.col("key") != LAST_ID).where(F.pmod("key", F.lit(every)) == 0).groupBy("key").agg(F.min("x").alias("x"))
    n_blocks = -(-asked.count() // QUERIES)
    asked = saved(asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, n_blocks))).cast("int")), "queries")
    hits = shared_path(spark, "hits")
    for number in range(n_blocks):
        q = sorted((r.key, r.x) for r in asked.where(F.col("block") == number).collect())  # about QUERIES rows
        if not q:
            continue
        x = np.zeros((len(q), width))
        for row, (_, values) in zip(x, q):
            row[: len(values)] = values
        ids = np.array([key for key, _ in q], np.int64)
        block = Block(ids, x, rotation, np.full(len(q), -np.inf))
        head = table.where(F.col("part") == first).select("key", "x")
        found = head.mapInArrow(_search(spark.sparkContext.broadcast(block), k, width), _HITS)
        kth = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("query_id", F.element_at("s", k).alias("least")).collect()
        place = {key: n for n, key in enumerate(ids.tolist())}
        for r in kth:
            block.least[place[r.query_id]] = r.least
        table.select("key", "x").mapInArrow(_search(spark.sparkContext.broadcast(block), k, width), _HITS).write.mode("append").parquet(hits)
    if not n_blocks:
        return empty
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return spark.read.schema(_HITS).parquet(hits).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("key") != LAST_ID, F.col("key")).alias("vec_id"), "score")
