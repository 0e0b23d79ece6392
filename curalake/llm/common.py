"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.sources.shared import shared_folder

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: bytes.split() without an argument splits at exactly these: space, \t, \n, \v, \f, \r.
SPACE = b" \t\n\x0b\x0c\r"

#: Stands for a null id wherever ids are ordered: a null comes after every id.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors share."""
    return shared_folder(spark, tag)


#: For tables of hashes, which don't get smaller: a compressor's buffers outside the heap are only freed when the heap is collected.
PLAIN = {"compression": "uncompressed"}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of Spark SQL for what is run inside, put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def co_partitioned(spark: SparkSession):
    """What is run inside joins tables on several keys where they are, if both are dealt by some of these keys."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def saved(df: DataFrame, tag: str, lean: bool = True, **options: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and losing an executor loses nothing. If lean, its shuffle files go when it is written."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true") if lean else nullcontext():
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more: what was made from them is a saved table itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary"))


def id_key(name: str = "doc_id") -> Column:
    """The id for ordering: a null id comes last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def id_crc32(name: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


class Memo(dict):
    """A bounded memo of a function of one argument with a length, read through [].

    Holds at most 2 * limit entries with keys of 2 * LENGTH letters together: those used since the last turn, and those of the turn before.
    """

    #: Letters of the keys of a turn, and of the longest key that is kept.
    LENGTH, LONGEST = 1 << 24, 1 << 10

    def __init__(self, function, limit: int = 300_000):
        super().__init__()
        self.function, self.limit, self.length, self.old = function, limit, 0, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.function(key)
        if len(self) >= self.limit or self.length >= self.LENGTH:
            self.old, self.length = dict(self), 0
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        self.length += len(key)
        return value


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Spark keeps its Python workers, and the next stage needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bits of a bit filter; fixed, so a filter stays at 2 MB for any input. A full one only lets more rows through.
FILTER_BITS = 1 << 24


def filter_bit(*columns: str | Column) -> Column:
    """The bit of a row in a bit filter."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).cast("int")


def bit_filter(bits: DataFrame):
    """A broadcast bit set of the one column of bits; at most FILTER_BITS / 64 words come to the driver."""
    name = bits.columns[0]
    words = bits.groupBy(F.expr(f"`{name}` div 64").cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, `{name}` % 64)")).alias("bits")).collect()
    packed = bytearray(FILTER_BITS // 8)
    for word, value in words:
        packed[word * 8 : word * 8 + 8] = (value & (1 << 64) - 1).to_bytes(8, "little")
    return bits.sparkSession.sparkContext.broadcast(bytes(packed))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, label) for each node; the label is the smallest node.

    Each round takes the smallest label around every node and then the label of that label. Labels are a table in the shared folder.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", **PLAIN)
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels", **PLAIN)
    while True:
        held = labels.select("node", "label")
        near = both.join(held, both["b"] == held["node"]).groupBy("a").agg(F.min("label").alias("near"))
        mine = held.withColumnRenamed("label", "before").join(near, F.col("node") == F.col("a")).select("node", "before", F.least("before", "near").alias("mid"))
        far = held.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = saved(mine.join(far, "mid").select("node", "before", F.least("mid", "far").alias("label")), "labels", **PLAIN)
        discard(labels)
        labels = after
        if after.where("label < before").isEmpty():
            discard(both)
            return labels
