"""Checks of a batch, corrections and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, measures: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row for each check with its value, its limit and whether it is beyond; one pass over df."""
    row = df.agg(*(c.cast("double").alias(n) for n, (c, _) in measures.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("value"), F.lit(float(limit)).alias("limit_value")) for n, (_, limit) in measures.items()))
    return row.select(F.explode(pairs).alias("c")).select("c.*", (F.coalesce(F.col("c.value"), F.lit(0.0)) > F.col("c.limit_value")).alias("beyond"))


def failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules that a row breaks, in one array; rows that break none are left out."""
    return df.withColumn("failures", F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(n)) for n, broken in rules.items())), lambda x: x.isNotNull())).where(F.size("failures") > 0)


def cells(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each cell: keys, name, value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(*keys, F.explode(pairs).alias("_c")).select(*keys, "_c.name", "_c.value")


def apply_corrections(df: DataFrame, key: str, columns: list[str], corrections: DataFrame) -> DataFrame:
    """Corrections (key, name, old, new) that match the value as it is, all at once; others change nothing.

    Two different new values for one cell are an error of the corrections.
    """
    new = corrections.groupBy(key, "name", "old").agg(F.min("new").alias("_new"), F.max("new").alias("_other"))
    new = new.withColumn("_new", F.when(F.col("_new").eqNullSafe(F.col("_other")), F.col("_new")).otherwise(F.raise_error(F.lit("a cell has two corrections")))).drop("_other")
    long = cells(df, [key], columns).join(new.withColumnRenamed("old", "_old"), [key, "name"], "left")
    hit = F.max(F.when(F.col("_old").eqNullSafe(F.col("value")), F.col("_new")))
    fixed = long.groupBy(key, "name").agg(F.coalesce(hit, F.first("value")).alias("value"))
    return fixed.groupBy(key).pivot("name", columns).agg(F.first("value"))


def not_kept(findings: DataFrame, kept: DataFrame, keys: list[str], always: Column) -> DataFrame:
    """Findings that nobody has reviewed, and those that can't be kept."""
    return findings.where(~always).join(kept.select(*keys), keys, "left_anti").unionByName(findings.where(always))


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
