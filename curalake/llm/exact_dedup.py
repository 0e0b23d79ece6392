"""Exact deduplication through a log-structured merge index of text digests.

Rows are buffered in memtables; each memtable is flushed as a run sorted by digest, written as
Parquet with a Bloom filter on the digest. Compaction merges the entries of all runs by digest (each task
reduces the runs that it reads before anything is shuffled, so a digest of a third of all rows is no hot key)
and keeps the smallest identifier, again sorted and with filters: a look-up of single texts opens only the
row groups whose filter has the digest. Rows whose digest is held more than once (hits, found with a bit filter
of fixed size) are read again and compared byte by byte, so that a digest collision splits a group.

Defined results: a null text counts as empty; a text of white space only equals any other such
text; a null id orders after every id; of rows that repeat both id and text, one stays; very long texts are
digested whole; an empty table gives no rows. Columns other than the id and the text are not read, so their names
may clash with any here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.llm.common import LAST_ID, SPACE, give_back, id_key, saved, shared_path, spare, text_bytes

#: Entries of a memtable before it is flushed as a run.
MEMTABLE = 50_000
#: Bits of the filter of repeated digests; its size doesn't depend on the data. A full one only means more rows compared.
FILTER_BITS = 1 << 24

_ENTRY = "digest string, sha256 string, id long, row_id long"


def normalise(text: bytes) -> bytes:
    """Each run of white space as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * (text[:1] in SPACE) + b" ".join(words) + b" " * (text[-1:] in SPACE)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_key(id_col).alias("id"), text_bytes(text_col).alias("text"))


def _flush(digest_chars: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        table: list[tuple[str, str, int, int]] = []

        def run() -> pa.RecordBatch:
            table.sort()
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["digest", "sha256", "id", "row_id"])
            table.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sha = hashlib.sha256(normalise(text.as_py())).hexdigest()
                table.append((sha[:digest_chars], sha, key, row))
                row += 1
                if len(table) >= MEMTABLE:
                    yield run()
        if table:
            yield run()
        give_back()

    return runs


class DigestIndex:
    """The index in one shared folder: level 0 holds a folder of runs for each append, level 1 the compacted entries."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest_chars: int = 64):
        self.spark, self.path, self.digest_chars = spark, path or shared_path(spark, "digests"), digest_chars
        self.appended: list[DataFrame] = []
        self.runs: list[str] = []

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush docs as sorted runs."""
        docs = _keyed(docs, id_col, text_col)
        path = f"{self.path}/level0/{len(self.runs):06d}"
        docs.mapInArrow(_flush(self.digest_chars), _ENTRY).write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        self.appended.append(docs)
        self.runs.append(path)

    def entries(self) -> DataFrame:
        """One row for each row appended."""
        out = None
        for k, path in enumerate(self.runs):
            run = self.spark.read.schema(_ENTRY).parquet(path).withColumn("run", F.lit(k))
            out = run if out is None else out.unionByName(run)
        return out

    def compact(self) -> DataFrame:
        """Merge all runs: for each digest the smallest identifier, the row that has it, and how many rows share the digest."""
        merged = self.entries().groupBy("digest").agg(F.min(F.struct("id", "run", "row_id")).alias("first"), F.count("*").alias("group_size"))
        path = f"{self.path}/level1/{len(self.runs):06d}"
        merged.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        return self.spark.read.schema(merged.schema).parquet(path)

    def find(self, level1: DataFrame, texts: list[str]) -> dict[str, int]:
        """The smallest identifier under the digest of each text that is held; the reader probes the filters of the compacted level."""
        digests = {hashlib.sha256(normalise(t.encode())).hexdigest()[: self.digest_chars]: t for t in texts}
        rows = None
        for digest in digests:
            part = level1.where(F.col("digest") == digest).select("digest", F.col("first.id").alias("id"))
            rows = part if rows is None else rows.unionByName(part)
        return {} if rows is None else {digests[r.digest]: r.id for r in rows.collect()}  # a row for each text asked for

    def _hits(self, level1: DataFrame) -> DataFrame:
        """Digest, id and normalised bytes of the rows whose digest is held more than once."""
        repeated = level1.where("group_size > 1").select("digest")
        bit = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % FILTER_BITS
        words = repeated.select(bit.alias("bit")).groupBy(F.expr("bit div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        bits = self.spark.sparkContext.broadcast({r[0]: r[1] & (1 << 64) - 1 for r in words.collect()})  # FILTER_BITS / 64 words at most
        chars = self.digest_chars

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = bits.value
            for batch in batches:
                out: list[tuple[str, int, bytes]] = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    norm = normalise(text.as_py())
                    digest = hashlib.sha256(norm).hexdigest()[:chars]
                    at = int(digest[:8], 16) % FILTER_BITS
                    if held.get(at >> 6, 0) >> (at & 63) & 1:
                        out.append((digest, key, norm))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], ["digest", "id", "norm"])
            give_back()

        hits = None
        for docs in self.appended:
            part = docs.mapInArrow(read, "digest string, id long, norm binary")
            hits = part if hits is None else hits.unionByName(part)
        return hits.join(repeated, "digest", "left_semi")

    def collisions(self, level1: DataFrame) -> DataFrame:
        """The byte verification: digests under which there are different texts."""
        texts = self._hits(level1).groupBy("digest", "norm").agg(F.lit(1).alias("one"))
        return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")

    def resolve(self) -> DataFrame:
        """For each row appended: id, row_id, run, keep_id, group_size, kept, sha256."""
        level1 = self.compact()
        collided = saved(self.collisions(level1), "collided")
        rows = self.entries()
        if collided.isEmpty():
            out = rows.join(level1, "digest")
        else:  # the full digest tells the texts of these apart; those that share it too were compared above
            apart = rows.join(collided.withColumn("collided", F.lit(True)), "digest", "left")
            apart = apart.withColumn("digest", F.when(F.col("collided"), F.concat("digest", F.lit(":"), "sha256")).otherwise(F.col("digest"))).drop("collided")
            firsts = apart.groupBy("digest").agg(F.min(F.struct("id", "run", "row_id")).alias("first"), F.count("*").alias("group_size"))
            out = apart.join(firsts, "digest")
        same = (F.col("first.row_id") == F.col("row_id")) & (F.col("first.run") == F.col("run"))
        return out.select("id", "run", "row_id", F.col("first.id").alias("keep_id"), "group_size", same.alias("kept"), "sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(docs.sparkSession, digest_chars=digest_chars)
    index.append(docs, id_col, text_col)
    null = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return index.resolve().select(null("id").alias("doc_id"), null("keep_id").alias("keep_id"), "group_size", "kept", F.col("sha256").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    index = DigestIndex(docs.sparkSession)
    index.append(docs, id_col, text_col)
    out = index.resolve()
    # Rows to leave out, by id and how many of its rows stay; almost all ids have one row, which stays or goes.
    fate = saved(out.groupBy("id").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept")).where("n_kept < n"), "fate")
    own, sha = spare(docs, "own_id"), spare(docs, "own_sha")
    keyed = docs.withColumn(own, id_key(id_col))
    single = keyed.join(fate.where("n_kept = 0").select(F.col("id").alias(own)), own, "left_anti")
    mixed = fate.where("n_kept > 0").select(F.col("id").alias(own))
    if mixed.isEmpty():
        return single.select(*docs.columns)
    # An id that repeats: of its rows with one text, keep one if that text stays here.
    texts = out.where("kept").select(F.col("id").alias(own), F.col("sha256").alias(sha))
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    again = single.join(mixed, own, "left_semi").withColumn(sha, F.sha2(normal, 256)).join(texts, [own, sha], "left_semi")
    return single.join(mixed, own, "left_anti").select(*docs.columns).unionByName(again.dropDuplicates([own, sha]).select(*docs.columns))
