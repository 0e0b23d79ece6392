"""Completion and alias joins over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """A3: of rows with one key the last by position."""
    rest = [c for c in df.columns if c not in (key, pos)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))


def first_per_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows with one key the first by position."""
    rest = [c for c in df.columns if c not in (key, pos)]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))


def complete(requested: DataFrame, rows: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """One row for each requested (pos, key), in request order, with defaults where a key isn't there."""
    known = rows.select(key, *defaults, F.lit(True).alias("_known"))
    filled = [F.when(F.col("_known"), F.col(c)).otherwise(d).alias(c) for c, d in defaults.items()]
    return requested.join(known, key, "left").select("pos", key, *filled, F.coalesce("_known", F.lit(False)).alias("found"))


def fan_out(keys: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Each key with its members (key, member, ord), or with itself if it has none."""
    return keys.join(members, key, "left").withColumn("member", F.coalesce("member", F.col(key).cast("string")))


def first_claim(members: DataFrame, key: str) -> DataFrame:
    """Member to key, the first key by position wins."""
    w = Window.partitionBy("member").orderBy("ord", key)
    return members.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fresh(cache: DataFrame, keys: DataFrame, key: str, at: str, now: Column, max_age_days: int | None, complete_columns: tuple[str, ...] = ()) -> DataFrame:
    """Cached rows of the keys that are whole and young enough; without an age all are."""
    out = cache.join(keys.select(key).distinct(), key, "left_semi")
    for c in complete_columns:
        out = out.where(F.col(c).isNotNull())
    return out if max_age_days is None else out.where(F.col(at) > now - F.make_dt_interval(F.lit(max_age_days)))


def misses(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache doesn't have."""
    return keys.select(key).distinct().join(cache, key, "left_anti")


def ordered_values(df: DataFrame, key: str, pos: str, value: str, out: str) -> DataFrame:
    """The distinct values of each key in the order of position."""
    firsts = df.groupBy(key, value).agg(F.min(pos).alias("_pos"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", value))), lambda x: x[value]).alias(out))
