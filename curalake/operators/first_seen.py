"""Results in the order in which their keys were first seen, and keys that a review holds back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.functions.sentinel import strip

#: Fixed value: the shape of a symbol: capitals, digits and hyphens, or one with `orf` in it.
SYMBOL = r"^[A-Z0-9-]+(orf[0-9]+[A-Z0-9-]*)?$"


def collapsed(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], position: str) -> DataFrame:
    """Of the rows of a key the one that ranks first, with `first_seen`, where its key was first seen.

    Ties go to the row that was seen first. Null keys are equal to each other; null ranks come before others. Rows of a key are
    reduced where they are read, so a key with most of the rows is no more work for one task than any other.
    """
    row = F.struct(*(F.col(c) for c in df.columns))
    best = F.min_by(row, F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), F.col(position).alias("p")))
    out = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(best.alias("_row"), F.min(position).alias("first_seen"))
    return out.select("_row.*", "first_seen")


def pairs_in_order(df: DataFrame, key: str, code: str, other: str, position: str, prefix: str = "") -> DataFrame:
    """For each key its distinct pairs of code and other, in the order in which they were first seen; codes lose their prefix, those without it go.

    Pairs are made distinct before they are gathered: a list is as long as a key has different pairs.
    """
    rows = df.where(F.col(code).startswith(prefix)).select(key, F.substr(F.col(code), F.lit(len(prefix) + 1)).alias("code"), F.col(other).alias("other"), position)
    firsts = rows.groupBy(key, "code", "other").agg(F.min(position).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "code", "other")))
    return firsts.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x["code"].alias("code"), x["other"].alias("other"))).alias("pairs"))


def _canonical(df: DataFrame, symbol: str, aliases: DataFrame) -> DataFrame:
    """df with `_key`, the key of its symbol: its alias' name if it has one, in capitals; the empty text for null and blank."""
    names = aliases.select(F.upper(strip(F.col("alias"))).alias("_key"), F.upper(strip(F.col("name"))).alias("_name")).groupBy("_key").agg(F.min("_name").alias("_name"))
    keyed = df.withColumn("_key", F.coalesce(F.upper(strip(F.col(symbol))), F.lit("")))
    return keyed.join(names, "_key", "left").withColumn("_key", F.coalesce("_name", "_key")).drop("_name")


def held(rows: DataFrame, holds: DataFrame, symbol: str, aliases: DataFrame) -> DataFrame:
    """Rows with `held`, whether their key is one that is held back; both sides by aliases (alias, name). Holds without a symbol hold nothing."""
    keys = _canonical(holds.select(symbol), symbol, aliases).where("_key <> ''").select("_key").distinct().withColumn("held", F.lit(True))
    return _canonical(rows, symbol, aliases).join(keys, "_key", "left").withColumn("held", F.coalesce("held", F.lit(False))).drop("_key")


def symbol_suspects(df: DataFrame, row: str, columns: Mapping[str, Column]) -> DataFrame:
    """One row for each cell that is there and has no symbol's shape: row, column, value, kind, detail."""
    cells = F.array(*(F.struct(F.lit(name).alias("column"), c.alias("value")) for name, c in columns.items()))
    rows = df.select(F.col(row).alias("row"), F.inline(cells)).where(F.col("value").isNotNull() & ~F.col("value").rlike(SYMBOL))
    return rows.select("row", "column", "value", F.lit("gene_symbol").alias("kind"), F.lit("not a gene symbol").alias("detail"))
