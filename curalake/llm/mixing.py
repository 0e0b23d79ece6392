"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, followed by as many repeats of the queue as the
cap allows. A copy starts at the words queued before it, divided by the target of its source, and finishes
at that plus its own size divided by the target: its virtual finish time. Copies are served in the order of
their virtual finish times over all sources (a global range sort) until the budget is spent; the copy that is
served then is cut at the word, and later ones get nothing.

When the virtual clock stands at 1, every source has been served its target but for the copy that it is at. So a source
is served its target to within one document, more or less: its copies that finish by 1 are at most one document short, and
what the sources lack there goes to the copies that finish next, of any source.

Running sums of a source are taken in two steps, inside range partitions and over the totals of partitions,
so that a source with most of the documents is spread over many tasks.

Targets: sources share the budget by weight; a target stops at `cap` times the size of its source, and what
is above is shared by weight among the others until none is above. That is the level at which the sources
in the order of cap to weight stop being full.

Defined results: a null text has no words; documents of a null source form the last source; a document
without words is never taken; equal rows are served one after the other; ids and texts that are in several sources
are served for each of them; a source without words has target 0; very long texts are counted whole; an empty table
gives no rows. Columns other than id, text and source are not read, so their names may clash with any here, and `mix`
returns the columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalake.llm.common import discard, give_back, id_key, saved, spare, text_bytes

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, h (of the text), shuffle and size, without the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(x.as_py().split()) for x in batch.column(4)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], n], ["id", "source", "h", "shuffle", "size"])
        give_back()

    text = text_bytes(text_col)
    shuffle = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("h"), shuffle.alias("shuffle"), text.alias("text"))
    return saved(rows.mapInArrow(count, "id long, source string, h long, shuffle string, size long"), "sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row for each source of rows (source, size): source, place, source_size, target. Its size is the number of sources."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", place)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    sources = sources.withColumn("limit", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sources.withColumn("turn", F.row_number().over(fill))
        .withColumn("full", F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
    )
    open_turn = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("turn", "level"))).over(everything)
    sources = sources.withColumn("open", open_turn)
    target = F.when(F.col("turn") >= F.col("open.turn"), F.col("open.level") * F.col("weight")).otherwise(F.col("limit").cast("double"))
    return sources.select("source", "place", "source_size", target.alias("target"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the words of the same source before each row in the partition."""
    part = TaskContext.get().partitionId()
    last, carry = None, 0
    for batch in batches:
        place, size = batch.column("place").to_numpy(), batch.column("size").to_numpy()
        if not len(place):
            continue
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        base = -before[first]
        if place[0] == last:
            base[0] += carry
        before = before + np.repeat(base, np.diff(np.r_[first, len(place)]))
        last, carry = place[-1], int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part, np.int32)), pa.array(before, pa.int64())], [*batch.schema.names, "part", "before"])


def queued(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """rows (id, source, h, shuffle, size), a saved table that this deletes, with place, source_size, target and before: the words of its source ahead of it."""
    goals = saved(targets(rows, weights, share, cap), "targets")
    same = rows["source"].eqNullSafe(goals["source"])
    placed = rows.join(goals, same).drop(goals["source"])
    placed = placed.repartitionByRange("place", "shuffle", "id", "h").sortWithinPartitions("place", "shuffle", "id", "h")
    schema = placed.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    local = saved(placed.mapInArrow(_running, schema + ", part int, before long"), "queues")
    discard(rows, goals)
    totals = local.groupBy("place", "part").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = saved(local.join(totals.select("place", "part", ahead.alias("ahead")), ["place", "part"]).withColumn("before", F.col("before") + F.col("ahead")).drop("ahead", "part"), "queued")
    discard(local)
    return out


def copies(queue: DataFrame, cap: int = CAP) -> DataFrame:
    """Every copy of a document with words: rows of `queued` with copy and finish, its virtual finish time."""
    out = queue.where("size > 0").withColumn("copy", F.explode(F.array(*map(F.lit, range(cap)))))
    start = F.col("before") + F.col("copy") * F.col("source_size")
    return out.withColumn("finish", (start + F.col("size")) / F.col("target"))


def _served(all_copies: DataFrame) -> DataFrame:
    """Rows of `copies` in the order of virtual finish time with served: the words of the copies ahead of each, over all sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), 0
        for batch in batches:
            words = batch.column("size").to_numpy()
            served = carry + np.cumsum(words) - words
            carry += int(words.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(words), part, np.int32)), pa.array(served, pa.int64())], [*batch.schema.names, "part", "served"])

    order = ("finish", "place", "copy", "before")
    sorted_copies = all_copies.select("place", "before", "copy", "finish", "size").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = sorted_copies.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    local = saved(sorted_copies.mapInArrow(run, schema + ", part int, served long"), "served")
    totals = local.groupBy("part").agg(F.sum("size").alias("words"))  # a row for each partition
    ahead = F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = local.join(F.broadcast(totals.select("part", ahead.alias("ahead"))), "part").withColumn("served", F.col("served") + F.col("ahead")).drop("ahead", "part")
    out.local = local
    return out


def takes(queue: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The copies that the mix takes, by place and before in the queue: copy, finish, and taken (words), cut off at the budget."""
    goals = queue.groupBy("place").agg(F.first("source_size").alias("source_size"))  # a row for each source
    served = _served(copies(queue, cap))
    budget = goals.agg(F.floor(F.sum("source_size") * F.lit(float(min(share, cap)))).alias("budget"))
    out = served.crossJoin(F.broadcast(budget)).withColumn("taken", F.least("size", F.col("budget") - F.col("served"))).where("taken > 0").drop("budget", "served", "size")
    out.local = served.local
    return out


def fair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    rows = queued(_sized(docs, id_col, text_col, source_col))
    # A source serves one document with words at a time, so its place in the queue tells it.
    taken = takes(rows).groupBy("place", "before").agg(F.sum("taken").alias("taken")).select("place", "before", F.lit(True).alias("sized"), "taken")
    out = rows.withColumn("sized", F.col("size") > 0).join(taken, ["place", "before", "sized"], "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))


def _source_key(column: str) -> Column:
    """A source as a key that is never null."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: rows of docs, repeated or cut as taken, in the order of virtual finish time.

    Rows that share id, text and source share their takes: the first of them, by a hash of all columns, gets the first take.
    """
    own, h, key, turn, take = (spare(docs, c) for c in ("own_id", "own_h", "own_source", "own_turn", "own_take"))
    rows = queued(_sized(docs, id_col, text_col, source_col))
    served = takes(rows).join(rows.where("size > 0"), ["place", "before"]).withColumn("key", _source_key("source"))
    served = saved(served.groupBy("id", "h", "key").agg(F.sort_array(F.collect_list(F.struct("finish", "place", "copy", "before", "size", "taken"))).alias("takes")), "takes")
    discard(rows)
    taken = served.select(id_key("id").alias(own), F.col("h").alias(h), F.col("key").alias(key), "takes")
    same = [own, h, key]
    keyed = docs.withColumns({own: id_key(id_col), h: F.xxhash64(text_bytes(text_col)), key: _source_key(source_col)})
    again = keyed.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")
    single = keyed.join(again, same, "left_anti").join(taken, same).withColumn(take, F.explode("takes")).drop("takes")
    if not again.isEmpty():
        order = Window.partitionBy(*same).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        several = keyed.join(again, same).withColumn(turn, F.row_number().over(order) - 1)
        several = several.join(taken, same).select("*", F.posexplode("takes").alias("at", take)).where(F.col("at") % F.col("n") == F.col(turn))
        single = single.unionByName(several.drop("takes", "n", "at", turn))
    parts = F.split(F.trim(F.regexp_replace(text_col, r"[\x20\x09-\x0D]+", " ")), " ")
    cut = F.when(F.col(f"{take}.taken") < F.col(f"{take}.size"), F.array_join(F.slice(parts, 1, F.col(f"{take}.taken").cast("int")), " ")).otherwise(F.col(text_col))
    order = [F.col(f"{take}.{c}") for c in ("finish", "place", "copy", "before")]
    return single.withColumn(text_col, cut).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
