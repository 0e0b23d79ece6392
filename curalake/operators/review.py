"""Votes on proposed changes.

A voter's latest answer to the current version counts. Members who abstain don't count; two thirds of the
others, rounded up, accept; a change that can no longer reach that is rejected. A ruling by a chair stands above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def needed(of: Column) -> Column:
    return F.ceil(2 * of / 3)


def standing(accept: Column, reject: Column, abstain: Column, outstanding: Column) -> Column:
    """The first rule that holds."""
    of = accept + reject + outstanding
    return F.when(of == 0, "undecided").when(accept >= needed(of), "accepted").when(accept + outstanding < needed(of), "rejected").otherwise("open")


def latest(events: DataFrame, keys: list[str], at: str, pos: str) -> DataFrame:
    """The last event of each key; of events at one time the later in position."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, pos)).alias("_e")).select(*keys, *(F.col("_e")[c].alias(c) for c in rest))


def tally(changes: DataFrame, voters: DataFrame, events: DataFrame) -> DataFrame:
    """Changes (subject, version) with votes; voters (actor); events (subject, version, actor, answer, at, pos)."""
    current = events.join(changes.select("subject", "version"), ["subject", "version"], "left_semi")
    answers = latest(current, ["subject", "actor"], "at", "pos").join(voters, "actor", "left_semi")
    of = voters.agg(F.count("*").alias("voters"))
    counts = answers.groupBy("subject").agg(*(F.count_if(F.col("answer") == a).alias(a) for a in ("accept", "reject", "abstain")))
    out = changes.join(counts, "subject", "left").fillna(0, ["accept", "reject", "abstain"]).crossJoin(of)  # of is one row
    out = out.withColumn("outstanding", F.col("voters") - F.col("accept") - F.col("reject") - F.col("abstain"))
    return out.withColumn("standing", standing(*map(F.col, ("accept", "reject", "abstain", "outstanding")))).drop("voters")


def matrix(tallied: DataFrame, kind: str) -> DataFrame:
    """How many changes of each kind have each standing."""
    return tallied.groupBy(kind).pivot("standing", ["accepted", "rejected", "open", "undecided"]).agg(F.count(F.lit(1))).fillna(0)


def last_activity(events: DataFrame, actor: str, at: str) -> DataFrame:
    """How many events each member made, and the last of them."""
    return events.groupBy(actor).agg(F.count("*").alias("n_events"), F.max(at).alias("last_at"), F.max_by("subject", F.struct(at, "pos")).alias("last_subject"))


def order_of_events(keys: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy("at", "pos"))
