"""Routing, sweeps, full replacement and checks of stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_rows(target: DataFrame, source: DataFrame, key: str, pos: str) -> DataFrame:
    """M3: source rows replace target rows of their key; of several the last by position counts."""
    rest = [c for c in target.columns if c != key]
    last = source.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest))
    return target.join(last, key, "left_anti").select(key, *rest).unionByName(last)


def filled(target: DataFrame, source: DataFrame, key: Column, source_key: str, columns: Sequence[str]) -> DataFrame:
    """Null or blank columns of target from the source row of the key; of several source rows the smallest value."""
    values = source.groupBy(F.upper(source_key).alias("_key")).agg(*(F.min(c).alias(f"_{c}") for c in columns))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    out = target.withColumn("_own", F.upper(key)).join(values, F.col("_own") == F.col("_key"), "left")
    return out.withColumns({c: F.when(blank(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*target.columns)


def routed(target: DataFrame, source: DataFrame, id_column: str, pos: str) -> DataFrame:
    """M7: source rows with their route: one refresh for each known id (the last row), an insert for others; a null id is skipped.

    Of several last rows the one with the largest other values. Rows without an id meet no join, so they don't meet in one task.
    """
    known = target.select(id_column).where(F.col(id_column).isNotNull()).distinct()
    named = source.where(F.col(id_column).isNotNull())
    rest = [c for c in source.columns if c not in (id_column, pos)]
    last = named.groupBy(id_column).agg(F.max(F.struct(pos, *rest)).alias("_r")).join(known.hint("merge"), id_column, "left_semi")
    refresh = last.select(id_column, "_r.*").select(*source.columns, F.lit("refresh").alias("route"))
    insert = named.join(known.hint("merge"), id_column, "left_anti").select(*source.columns, F.lit("insert").alias("route"))
    skip = source.where(F.col(id_column).isNull()).withColumn("route", F.lit("skip"))
    return refresh.unionByName(insert).unionByName(skip)


def status_sweep(target: DataFrame, statuses: DataFrame, id_column: str, status: str) -> tuple[DataFrame, DataFrame]:
    """M8: target with the new statuses, and the ids of which any stored value differs."""
    new = statuses.select(id_column, F.col(status).alias("_new"), F.lit(True).alias("_given"))
    both = target.join(new, id_column, "left")
    differs = F.coalesce(F.col("_given"), F.lit(False)) & ~F.col(status).eqNullSafe(F.col("_new"))
    changed = both.where(differs).select(id_column).distinct()
    return both.withColumn(status, F.when(F.col("_given"), F.col("_new")).otherwise(F.col(status))).drop("_new", "_given"), changed


def replaced(old: DataFrame, new: DataFrame, id_column: str, carried: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows are replaced; carried columns come from the last stored row of the id."""
    first = F.row_number().over(Window.partitionBy(id_column).orderBy(*order))
    kept = old.withColumn("_n", first).where("_n = 1").select(id_column, *(F.col(c).alias(f"_{c}") for c in carried))
    return new.join(kept, id_column, "left").select(*new.columns, *(F.col(f"_{c}").alias(c) for c in carried))


def backfilled(df: DataFrame, parent: str, cell: str, separator: str) -> DataFrame:
    """(parent, ordinal, value) of a delimited cell, ordinals from 1, blanks left out."""
    parts = F.filter(F.transform(F.split(cell, separator), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(parent, F.posexplode(parts).alias("_pos", "value")).select(parent, (F.col("_pos") + 1).alias("ordinal"), "value")


def migrated(df: DataFrame, version: int, steps: Mapping[int, Mapping[str, Column]]) -> DataFrame:
    """Rows of an older version brought to the newest one, step by step; a step adds or replaces columns."""
    for n in sorted(steps):
        if n > version:
            df = df.withColumns(dict(steps[n]))
    return df


def offset_union(old: Column, new: Column, separator: str) -> Column:
    """The parts of both cells with their ordinals, new ones behind all old ones, each part once, in order."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda a, after: F.transform(a, lambda x, i: F.struct((i + after).alias("ord"), x.alias("v")))
    pairs = F.array_sort(F.concat(number(split(old), 0), number(split(new), 100_000)))
    return F.array_join(F.array_distinct(F.transform(pairs, lambda x: x["v"])), separator)


def patched(cells: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells (keys, value) with the corrections (keys, old, new) that name them and their value; corrections that disagree fail.

    An empty cell is null: a correction may name one as its old value, or set a cell to it.
    """
    # Nulls are counted as a value of their own: corrections to x and to empty disagree.
    answers = F.count_distinct(F.struct("new"))
    plan = corrections.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("old").alias("_old")).agg(F.min("new").alias("_new"), answers.alias("_n"))
    disagree = F.raise_error(F.concat(F.lit("corrections disagree: "), F.concat_ws(" ", *(F.col(f"_{k}").cast("string") for k in keys))))
    plan = plan.withColumn("_hit", F.when(F.col("_n") > 1, disagree.cast("boolean")).otherwise(F.lit(True)))
    same = F.col("value").eqNullSafe(F.col("_old"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    hit = F.coalesce("_hit", F.lit(False))
    return cells.join(plan, same, "left").select(*keys, F.when(hit, F.col("_new")).otherwise(F.col("value")).alias("value"), hit.alias("corrected"))


def rectangle(df: DataFrame, top: str, bottom: str, left: str, right: str) -> DataFrame:
    """One row for each cell of a rectangle, with its value."""
    spans = df.withColumn("row", F.explode(F.sequence(top, bottom))).withColumn("col", F.explode(F.sequence(left, right)))
    return spans.drop(top, bottom, left, right)


def cache_aside(keys: DataFrame, cache: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """How many keys are cached, fetched, and not found anywhere."""
    cached, fetched = cache.select(key).distinct().withColumn("_c", F.lit(True)), source.select(key).distinct().withColumn("_f", F.lit(True))
    both = keys.select(key).distinct().join(cached, key, "left").join(fetched, key, "left")
    return both.agg(F.count("_c").alias("cached"), F.count_if(F.col("_c").isNull() & F.col("_f").isNotNull()).alias("fetched"), F.count_if(F.col("_c").isNull() & F.col("_f").isNull()).alias("failed"))


def failures(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break rules, with the names of all of them, in order."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("failures", broken).where(F.size("failures") > 0)


def unsettled(suspects: DataFrame, kept: DataFrame, keys: Sequence[str], rule: str, never_kept: Sequence[str]) -> DataFrame:
    """Suspects that no review has kept, null keys equal; suspects of some rules can't be kept."""
    own = suspects.alias("s")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}"))
    return own.join(kept.alias("k"), same & ~F.col(f"s.{rule}").isin(*never_kept), "left_anti")


def table_extent(rows: DataFrame, sheet: str, number: str, empty: Column) -> DataFrame:
    """Rows of each sheet above its first empty row."""
    end = rows.where(empty).groupBy(sheet).agg(F.min(number).alias("_end"))
    return rows.join(end, sheet, "left").where(F.col("_end").isNull() | (F.col(number) < F.col("_end"))).drop("_end")


def clamped(desired: Column, height: float, top: float, bottom: float) -> Column:
    """Sorted positions pushed apart: forward so that none overlaps the one before, then backward from the bottom."""
    push = F.aggregate(desired, F.array().cast("array<double>"), lambda out, x: F.concat(out, F.array(F.greatest(x, F.when(F.size(out) > 0, F.element_at(out, -1) + height).otherwise(F.lit(float(top)))))))
    back = F.aggregate(F.reverse(push), F.array().cast("array<double>"), lambda out, x: F.concat(out, F.array(F.least(x, F.when(F.size(out) > 0, F.element_at(out, -1) - height).otherwise(F.lit(float(bottom)))))))
    return F.reverse(back)


def disposition(facts: Sequence[tuple[str, Column]], other: str) -> Column:
    """The first answer whose condition holds."""
    out = F.lit(other)
    for name, holds in reversed(facts):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out
