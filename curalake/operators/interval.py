"""Interval placement and range joins.

Range conditions get an equality on a bucket of the range, so that Spark hashes rows to buckets instead of
comparing every row with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, starts: DataFrame, keys: list[str], at: str, start: str, value: str) -> DataFrame:
    """Each row with the value of the last start of its keys at or before it.

    Both sides are put into one order and the last value is carried forward: one shuffle, no range join.
    """
    tagged = rows.withColumns({"_t": F.col(at), "_row": F.lit(1), "_v": F.lit(None).cast(starts.schema[value].dataType)})
    marks = starts.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_row"), F.col(value).alias("_v"))
    both = tagged.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_row = 1").drop("_t", "_row", "_v")


def in_band(rows: DataFrame, bands: DataFrame, x: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with the band [low, high) that x is in; bands are spread over buckets of the given width."""
    spread = bands.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    placed = rows.withColumn("_bucket", F.floor(F.col(x) / width).cast("long"))
    return placed.join(spread, "_bucket").where((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("_bucket")


def span(rows: DataFrame, bands: DataFrame, group: str, first: str, last: Column, name: str, low: str, high: str) -> DataFrame:
    """Rows that name one band or two with the range that these cover; rows that name an unknown band go."""
    a = bands.select(group, F.col(name).alias("_first"), F.col(low).alias("_al"), F.col(high).alias("_ah"))
    b = bands.select(group, F.col(name).alias("_last"), F.col(low).alias("_bl"), F.col(high).alias("_bh"))
    out = rows.withColumns({"_first": F.col(first), "_last": F.coalesce(last, F.col(first))}).join(a, [group, "_first"]).join(b, [group, "_last"])
    start, end = F.least("_al", "_bl"), F.greatest("_ah", "_bh")
    return out.withColumns({"start": start, "end": end, "midpoint": (start + end) / 2}).drop("_first", "_last", "_al", "_ah", "_bl", "_bh")


def expand(df: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """A row for each whole number of a range."""
    return df.withColumn(out, F.explode(F.sequence(low, high)))


def overlaps(df: DataFrame, group: str, key: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of rows of one group whose ranges overlap, each once; compared only where they share a bucket."""
    spread = df.select(group, key, low, high, F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))).alias("_bucket"))
    a, b = spread.alias("a"), spread.alias("b")
    meet = (F.col(f"a.{low}") < F.col(f"b.{high}")) & (F.col(f"b.{low}") < F.col(f"a.{high}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    first = F.col("a._bucket") == F.greatest(F.floor(F.col(f"a.{low}") / width), F.floor(F.col(f"b.{low}") / width))
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a._bucket") == F.col("b._bucket")) & meet & first)
    return pairs.select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("left_key"), F.col(f"b.{key}").alias("right_key"))
