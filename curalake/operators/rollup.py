"""Grouped reductions with the tie-breaks and orders that curated tables need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arg_max(df: DataFrame, keys: Sequence[str], value: str, score: str, pos: str) -> DataFrame:
    """A10: the value with the best score; the earliest of equal ones."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(value, score), F.struct(F.col(score), -F.col(pos))).alias("_b")).select(*keys, f"_b.{value}", f"_b.{score}")


def mode(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The most frequent value; the alphabetically first of equal ones."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out), F.max("_n").alias("n"))


def majority_spelling(df: DataFrame, value: str) -> DataFrame:
    """For each spelling the spelling that most rows with the same letters have, and how many spellings there are."""
    counts = df.groupBy(value).agg(F.count("*").alias("n")).withColumn("_fold", F.lower(value))
    best = counts.groupBy("_fold").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("spelling"), F.count("*").alias("spellings"))
    return counts.join(best, "_fold").select(value, "n", "spelling", "spellings")


def histogram(dimension: DataFrame, all_rows: DataFrame, shown_rows: DataFrame, key: str) -> DataFrame:
    """Total and shown rows of each bucket of the dimension; buckets without rows are left out."""
    total = all_rows.groupBy(key).agg(F.count("*").alias("total"))
    shown = shown_rows.groupBy(key).agg(F.count("*").alias("shown"))
    return dimension.select(key).join(total, key).join(shown, key, "left").select(key, "total", F.coalesce("shown", F.lit(0)).alias("shown"))


def union_of_parts(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, separator: str = ";") -> DataFrame:
    """The distinct values of a group as one text, in the order in which they first come."""
    firsts = df.groupBy(*keys, value).agg(F.min(pos).alias("_pos"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pos", value))), lambda x: x[value])
    return firsts.groupBy(*keys).agg(F.array_join(ordered, separator).alias(out))


def traffic(df: DataFrame, keys: Sequence[str], ok: Column, missing: Column, millis: Column, size: Column) -> DataFrame:
    """Calls, outcomes, time and bytes of each key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.count_if(missing).alias("not_found"), (F.count("*") - F.count_if(ok | missing)).alias("errors"),
        F.sum(millis).alias("millis"), F.sum(size).alias("bytes"),
    )


def refold(rollup: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Stored rollups folded to coarser keys."""
    return rollup.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))


def ratio(a: Column, b: Column) -> Column:
    """Zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def recall(gold: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """How many of the gold keys are matched."""
    hits = gold.select(key).distinct().join(matched.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hits.agg(F.count("*").alias("gold"), F.count("_hit").alias("matched"), (F.count("*") - F.count("_hit")).alias("missed"), F.try_divide(F.count("_hit"), F.count("*")).alias("recall"))


def worst(statuses: Sequence[str], c: Column) -> Column:
    """An aggregate, the last of the ordered statuses that occurs."""
    code = F.lit(None).cast("int")
    for n, s in enumerate(statuses):
        code = F.when(c == s, n).otherwise(code)
    return F.element_at(F.array(*map(F.lit, statuses)), F.max(code) + 1)


def duplicates(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Rows that repeat an earlier row's value, whatever its case, and where that one is."""
    w = Window.partitionBy(F.lower(value)).orderBy(pos)
    return df.withColumns({"_n": F.row_number().over(w), "first_pos": F.first(pos).over(w)}).where("_n > 1").drop("_n")


def fold_codes(df: DataFrame, keys: Sequence[str], pos: str, value: str, exact: str) -> DataFrame:
    """The first value of each key, unless a later one is marked exact; then the last exact one."""
    return df.groupBy(*keys).agg(F.coalesce(F.max_by(F.when(F.col(exact), F.col(value)), F.when(F.col(exact), F.col(pos))), F.min_by(value, pos)).alias(value))


def disease_pivot(rows: DataFrame, keys: Sequence[str], sources: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key with, for each relation, the value of the source that comes first in `sources`,
    the sorted set of all values, and the version of each source. rows: keys, source, relation, value, version.
    """
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    ranked = rows.where(F.col("source").isin(*sources)).withColumn("_rank", rank)
    best = [F.min_by(F.when(F.col("relation") == c, F.col("value")), F.when((F.col("relation") == c) & F.col("value").isNotNull(), F.struct("_rank", "value"))).alias(c) for c in columns]
    versions = F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", "version"))))
    return ranked.groupBy(*keys).agg(*best, F.array_sort(F.collect_set("value")).alias("related"), versions.alias("versions"))
