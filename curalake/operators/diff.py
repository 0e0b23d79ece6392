"""Comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*columns: Column, length: int = 16) -> Column:
    """The first digits of the SHA-256 of the values, each behind its length, a null as a hyphen: different rows have different texts."""
    cells = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat(*cells), 256), 1, length)


def diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key that was added, removed or changed, with the names of the fields that differ; a null key is a key."""
    o, n = old.withColumn("_in_o", F.lit(True)).alias("o"), new.withColumn("_in_n", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    in_o, in_n = F.col("_in_o").isNotNull(), F.col("_in_n").isNotNull()
    changed = F.concat_ws(",", *(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns))
    kind = F.when(~in_o, "added").when(~in_n, "removed").otherwise("changed")
    fields = F.when(in_o & in_n, changed).otherwise("")
    out = both.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), kind.alias("kind"), fields.alias("fields"), F.when(in_n, digest(*(F.col(f"n.{c}") for c in columns))).alias("version"))
    return out.where("kind <> 'changed' or fields <> ''")


def stale(changes: DataFrame, current: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Changes whose version isn't that of the current row; an added key must still be absent."""
    now = current.select(key, digest(*(F.col(c) for c in columns)).alias("_now"))
    joined = changes.join(now, key, "left")
    bad = F.when(F.col("kind") == "added", F.col("_now").isNotNull()).otherwise(~F.col("_now").eqNullSafe(F.col("base_version")))
    return joined.where(bad).drop("_now")


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each key on both sides, on the left only and on the right only, counted."""
    a = left.select(key, value).distinct().withColumn("_l", F.lit(1))
    b = right.select(key, value).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, [key, value], "full_outer")
    counts = both.groupBy(key).agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))
    kind = F.when((F.col("left_only") == 0) & (F.col("right_only") == 0), "same").when(F.col("right_only") == 0, "left has more").when(F.col("left_only") == 0, "right has more").otherwise("differ")
    return counts.withColumn("verdict", kind)


def gained(before: Column, after: Column, sentinels: Sequence[str]) -> Column:
    """What after has and before hasn't, repeats kept, sentinels left out."""
    return F.filter(after, lambda x: ~F.array_contains(before, x) & ~x.isin(*sentinels))


def grew_from(before: Column, after: Column) -> Column:
    """A50, U8."""
    return F.size(F.array_except(before, after)) == 0
