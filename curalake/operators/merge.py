"""Upserts as functions of (target, source); the result replaces the target.

Each is one full outer join on the key, so both sides move once, and each column has a rule of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalake.operators.ordering import numbered

Rule = Callable[[Column, Column], Column]


def newest(old: Column, new: Column) -> Column:
    """M3: the new value, whatever it is."""
    return new


def coalesce_new(old: Column, new: Column) -> Column:
    """M5: the new value unless it is null."""
    return F.coalesce(new, old)


def fill_blank(old: Column, new: Column) -> Column:
    """M1, M9: the new value only where the old one is null or blank."""
    return F.coalesce(F.nullif(F.trim(old), F.lit("")), new)


def either(old: Column, new: Column) -> Column:
    """M1: once true, always true; null is false."""
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def union_in_order(separator: str = ";") -> Rule:
    """The distinct parts of both lists, old ones first."""

    def rule(old: Column, new: Column) -> Column:
        parts = F.concat(*(F.split(F.coalesce(c, F.lit("")), separator) for c in (old, new)))
        return F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")), separator), F.lit(""))

    return rule


def upsert(target: DataFrame, source: DataFrame, key: str, rules: dict[str, Rule], frozen: Column | None = None, frozen_columns: tuple[str, ...] = ()) -> DataFrame:
    """M1-M6: target with source merged in; `change` says insert, update or keep.

    frozen is a condition on the target (as `t`); where it holds, frozen_columns keep their values. A null key is a key like any other.
    """
    t, s = target.withColumn("_in_t", F.lit(True)).alias("t"), source.withColumn("_in_s", F.lit(True)).alias("s")
    both = t.join(s, F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}")), "full_outer")
    in_t, in_s = F.col("_in_t").isNotNull(), F.col("_in_s").isNotNull()
    out = [F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key)]
    for c, rule in rules.items():
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        value = F.when(in_t & in_s, rule(old, new)).when(in_t, old).otherwise(new)
        if frozen is not None and c in frozen_columns:
            value = F.when(in_t & frozen, old).otherwise(value)
        out.append(value.alias(c))
    change = F.when(in_t & in_s, "update").when(in_s, "insert").otherwise("keep")
    return both.select(*out, change.alias("change"))


def replace_scoped(target: DataFrame, rows: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """M4: all target rows of the scoped keys go, and rows take their place; a scoped key may have none."""
    return target.join(scope.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def append_ordered(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Incoming (parent, pos, value) behind existing (parent, ordinal, value), each value of a parent once.

    Run again with the same input it adds nothing. Neither side is broadcast, however few bytes its shuffle has: both grow with the parents.
    """
    firsts = incoming.groupBy(parent, "value").agg(F.min("pos").alias("pos")).join(existing.hint("merge"), [parent, "value"], "left_anti")
    start = existing.groupBy(parent).agg(F.max("ordinal").alias("_last"))
    number = F.row_number().over(Window.partitionBy(parent).orderBy("pos", "value"))
    added = firsts.join(start.hint("merge"), parent, "left").select(parent, (F.coalesce("_last", F.lit(0)) + number).cast("long").alias("ordinal"), "value", F.lit(True).alias("added"))
    return existing.select(parent, F.col("ordinal").cast("long"), "value", F.lit(False).alias("added")).unionByName(added)


def new_ids(existing: DataFrame, incoming: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Incoming rows with ids that follow the largest stored one, in the order given, which must be total."""
    last = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"]
    return numbered(incoming, order, id_col, last).select(id_col, *(c for c in incoming.columns if c != id_col))
