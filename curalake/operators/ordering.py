"""Sorts, pages and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalake.sources.shared import stored


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page of rows; the order must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def capped(array: Column, cap: int) -> Column:
    """A list with its first `cap` items, how many are shown and how many there are."""
    return F.struct(F.least(F.size(array), F.lit(cap)).alias("shown"), F.size(array).alias("total"), F.slice(array, 1, cap).alias("items"))


def numbered(df: DataFrame, order: Sequence[str | Column], out: str, after: int = 0) -> DataFrame:
    """df with its rows numbered in the order given, from after + 1 on. The order must be total.

    Numbers come from sorted range partitions and their sizes, so no task holds all rows. The partitions are a table
    in the shared folder: planned again, they could be others.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = stored(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", ahead.alias("_ahead"))
    number = (F.col("_ahead") + F.col("_at") + 1 + after).cast("long")
    return placed.join(F.broadcast(starts), "_part").select(*(F.col(c) for c in df.columns if c != out), number.alias(out))


def confidence_order(confidence: Column, *ties: Column) -> list[Column]:
    """The surest first, rows without a confidence last."""
    return [F.desc_nulls_last(confidence), *ties]


def flagged_first(flag: Column, *order: Column) -> list[Column]:
    """Rows that have the flag first, each part in its own order."""
    return [F.desc(F.coalesce(flag, F.lit(False))), *order]


def listed(c: Column, names: Sequence[str]) -> Column:
    """The place of a value in a list, behind all of them if it isn't there."""
    place = F.array_position(F.array(*map(F.lit, names)), c)
    return F.when(place > 0, place).otherwise(F.lit(len(names) + 1))


#: The collation in which letters are equal whatever their case and accents.
LOCALE = "UNICODE_CI_AI"


def locale_order(c: str | Column, descending: bool = False) -> list[Column]:
    """Texts by letters whatever their case and accents, numbers inside them by value; null is last both ways.

    Numbers are padded, so that one collated text is the key: up to 20 digits go by value.
    """
    parts = F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(r"\d+|\D+"), F.lit(0))
    key = F.collate(F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, F.greatest(F.length(x), F.lit(20)), F.lit("0"))).otherwise(x)), ""), LOCALE)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last()]


def spellings(df: DataFrame, column: str) -> DataFrame:
    """Groups of texts equal in the locale: their most frequent spelling (of ties the first by code point), rows and spellings; nulls are in none.

    Spellings are counted before groups are made, so a frequent one is reduced where it stands.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("spelling")).agg(F.count("*").alias("n"))
    usual = F.min_by("spelling", F.struct(-F.col("n"), "spelling"))
    return counted.groupBy(F.collate("spelling", LOCALE).alias("_k")).agg(usual.alias("spelling"), F.sum("n").alias("rows"), F.count("*").alias("spellings")).drop("_k")


#: Rows of either side in a block of pairs.
BLOCK = 1_000


def locale_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows whose texts are equal in the locale; nulls match nothing.

    The pairs of a text are dealt in blocks of about BLOCK x BLOCK, so a frequent one isn't the work of one task. A row goes to a
    block by its hash, once for each block of the other side. The number of pairs is the product of both sides: the result itself
    grows with the square of a group.
    """
    key = lambda c: F.collate(F.col(c), LOCALE)
    counts = lambda df, c, n: df.where(F.col(c).isNotNull()).groupBy(key(c).alias("_k")).agg(F.ceil(F.count("*") / BLOCK).alias(n), F.min(c).alias("_t"))
    blocks = counts(left, left_on, "_nl").join(counts(right, right_on, "_nr").drop("_t").hint("merge"), "_k")
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def placed(df: DataFrame, c: str, own: str, other: str) -> DataFrame:
        rows = df.join(blocks.hint("merge"), key(c) == F.col("_k"))
        block = F.pmod(F.xxhash64(*df.columns), F.col(f"_n{own}")).alias(f"_{own}")
        return rows.select(*df.columns, "_t", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1)).alias(f"_{other}")).repartition(tasks, "_t", "_l", "_r")

    pairs = placed(left, left_on, "l", "r").join(placed(right, right_on, "r", "l").hint("merge"), ["_t", "_l", "_r"])
    return pairs.drop("_t", "_l", "_r")
