"""Merge groups, run reports and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalake.operators.rollup import ratio


def firsts(df: DataFrame, key: str, pos: str, lists: Mapping[str, Column]) -> DataFrame:
    """For each key the distinct values of each list that aren't null, in the order of their first positions; empty if there are none.

    A value is reduced to its first position where its rows are read, so a key's rows never meet, only its distinct values do.
    """
    item = lambda n: F.struct(F.lit(n).alias("_name"), *(F.when(F.lit(m == n), v).alias(m) for m, v in lists.items()))
    held = df.select(F.col(key).alias("_k"), F.struct(pos).alias("_pos"), F.explode(F.array(*map(item, lists))).alias("_i")).select("_k", "_pos", "_i.*")
    first = held.where(F.greatest(F.lit(False), *(F.col(n).isNotNull() for n in lists))).groupBy("_k", "_name", *lists).agg(F.min("_pos").alias("_pos"))
    in_order = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("_name") == n, F.struct("_pos", n)))), lambda x: x[n])
    return first.groupBy("_k").agg(*(in_order(n).alias(n) for n in lists))


def merged_entries(entries: DataFrame, key: str, pos: str, confidence: str, floor: float, claims: Sequence[str], always: Sequence[str], names: Sequence[str], flags: Sequence[str], longest: int = 255) -> DataFrame:
    """One row for each key: claims of entries at or above the floor in order, other lists of all entries,
    the first name that fits, whether any entry has a flag, and the best confidence (the earliest of equal ones).
    """
    sure = F.col(confidence) >= floor
    lists = {c: F.when(sure, F.col(c)) for c in claims} | {c: F.col(c) for c in always}
    fits = lambda c: (F.trim(c) != "") & (F.length(c) <= longest)
    out = [F.min_by(F.when(fits(F.col(c)), F.col(c)), F.when(fits(F.col(c)), F.col(pos))).alias(c) for c in names]
    out += [F.coalesce(F.bool_or(F.when(sure, F.col(c))), F.lit(False)).alias(c) for c in flags]
    rows = entries.groupBy(key).agg(*out, F.max(confidence).alias(confidence), F.count("*").alias("entries"))
    both = rows.join(firsts(entries, key, pos, lists).hint("merge"), F.col(key).eqNullSafe(F.col("_k")), "left")
    return both.select(key, *(F.coalesce(c, F.array()).alias(c) for c in lists), *names, *flags, confidence, "entries")


def masked(df: DataFrame, only: Column, columns: Sequence[str]) -> DataFrame:
    """Rows that only bring citations lose their other claims."""
    return df.withColumns({c: F.when(~only, F.col(c)) for c in columns})


def trait_groups(records: DataFrame, key: str, trait: str, label: str, xrefs: str) -> DataFrame:
    """Records of a trait: how many, its usual label, all cross-references; ranked by count, then name."""
    labels = records.groupBy(key, trait, label).agg(F.count("*").alias("_n"))
    usual = labels.groupBy(key, trait).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label), F.sum("_n").alias("n"))
    refs = records.groupBy(key, trait).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(xrefs)))).alias(xrefs))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), trait))
    return usual.join(refs, [key, trait]).withColumn("rank", rank)


def rename_plan(rows: DataFrame, group: Sequence[str], curated: Sequence[str], id_column: str) -> DataFrame:
    """Of rows that become one name, the smallest id is kept and others go; if their curated values differ all are in conflict."""
    own = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in curated))
    kinds = rows.groupBy(*group).agg(F.count_distinct(own).alias("_kinds"), F.min(id_column).alias("_first"))
    action = F.when(F.col("_kinds") > 1, "conflict").when(F.col(id_column) == F.col("_first"), "keep").otherwise("delete")
    return rows.join(kinds, list(group)).withColumn("action", action).drop("_kinds", "_first")


def usage(attempts: DataFrame, keys: Sequence[str], billed: Column, measures: Sequence[str]) -> DataFrame:
    """Sums over billed attempts, and over those that a fallback made."""
    return attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), *(F.coalesce(F.sum(F.when(billed, F.col(m))), F.lit(0)).alias(m) for m in measures), *(F.coalesce(F.sum(F.when(~billed, F.col(m))), F.lit(0)).alias(f"fallback_{m}") for m in measures))


def cost(df: DataFrame, prices: Mapping[str, float], out: str, per: float = 1e6) -> DataFrame:
    """The cost of measures at their prices."""
    return df.withColumn(out, sum((F.col(m) * F.lit(p) for m, p in prices.items()), F.lit(0.0)) / per)


def routed(entries: DataFrame, verdict: Column, papers: Sequence[str], cap: int) -> DataFrame:
    """Entries by paper and verdict: how many, and the first of them up to a cap."""
    rows = entries.withColumn("verdict", verdict)
    rank = F.row_number().over(Window.partitionBy(*papers, "verdict").orderBy("id"))
    rows = rows.withColumn("_rank", rank)
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= cap, F.struct("_rank", "id")))), lambda x: x["id"])
    return rows.groupBy(*papers, "verdict").agg(F.count("*").alias("n"), items.alias("shown"))


def step_records(visits: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row for each known step in order: revisits added up, the first error kept, steps that nothing reached as skipped.

    visits: step, at, seconds, error, notes.
    """
    spark = visits.sparkSession
    known = spark.createDataFrame([(n, s) for n, s in enumerate(steps)], "ord int, step string")
    notes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "notes"))), lambda x: x["notes"]))
    held = visits.groupBy("step").agg(F.min("at").alias("started"), F.sum("seconds").alias("seconds"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error"), notes.alias("notes"))
    status = F.when(F.col("started").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("completed")
    return F.broadcast(known).join(held, "step", "left").withColumn("status", status)


def by_kind(rows: DataFrame, kind: str, order: Sequence[str], capped: Column) -> DataFrame:
    """How many of each kind, in the declared order; unknown where the list was cut."""
    from curalake.operators.ordering import listed

    return rows.groupBy(kind).agg(F.when(~F.bool_or(capped), F.count("*")).alias("n")).withColumn("ord", listed(F.col(kind), order))


def provenance(quotes: DataFrame, keys: Sequence[str], key: str, verbatim: Column, cited: Column) -> DataFrame:
    """Distinct keys, and how many quotes are verbatim, and cited."""
    return quotes.groupBy(*keys).agg(F.count_distinct(key).alias("keys"), F.count_if(verbatim).alias("verbatim"), F.count_if(cited).alias("cited"), ratio(F.count_if(verbatim), F.count("*")).alias("share"))


def replayed(logs: DataFrame, key: str, run: str, items: str) -> DataFrame:
    """The outcome of each key in the latest run that names it. logs: run, items (array of structs with the key)."""
    rows = logs.select(run, F.explode(items).alias("_i")).select(run, "_i.*")
    rest = [c for c in rows.columns if c not in (key, run)]
    return rows.groupBy(key).agg(F.max_by(F.struct(run, *rest), run).alias("_l")).select(key, "_l.*")


def merged_precision(fine: DataFrame, coarse: DataFrame, at: str, columns: Sequence[str]) -> DataFrame:
    """Rows of two logs, matched at the second; the finer time and values win."""
    a = fine.select(F.date_trunc("second", at).alias("_s"), F.col(at).alias("_fine"), *(F.col(c).alias(f"_f_{c}") for c in columns))
    b = coarse.select(F.date_trunc("second", at).alias("_s"), *(F.col(c).alias(f"_c_{c}") for c in columns))
    return a.join(b, "_s", "full_outer").select(F.coalesce("_fine", "_s").alias(at), *(F.coalesce(f"_f_{c}", f"_c_{c}").alias(c) for c in columns))


def numbered_parts(df: DataFrame, cell: str, text: str, separator: str) -> DataFrame:
    """The distinct parts of a cell with their number in it."""
    parts = df.select(cell, F.posexplode(F.split(text, separator)).alias("_pos", "part")).withColumn("part", F.trim("part")).where("part <> ''")
    firsts = parts.groupBy(cell, "part").agg(F.min("_pos").alias("_pos"))
    return firsts.withColumn("n", F.row_number().over(Window.partitionBy(cell).orderBy("_pos"))).drop("_pos")


def keyed_records(df: DataFrame, key: str, pos: str, columns: Sequence[str], separator: str) -> DataFrame:
    """The rows of a record as one row, the values that are there joined in order."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(pos, c)))), lambda x: x[c]), separator)
    return df.groupBy(key).agg(*(joined(c).alias(c) for c in columns))


def first_identifiers(df: DataFrame, name: str, identifier: str, pos: str) -> DataFrame:
    """Names in the order in which they first come, each with its first identifier that is there, and how many rows have one."""
    has = F.col(identifier).isNotNull()
    return df.groupBy(name).agg(F.min(pos).alias("first_pos"), F.min_by(identifier, F.when(has, F.col(pos))).alias(identifier), F.count_if(has).alias("with_id"), F.count("*").alias("rows"))


def attached(findings: DataFrame, changes: DataFrame, papers: DataFrame, key: str, paper: str) -> tuple[DataFrame, DataFrame]:
    """Findings with the change of their key and, if it is known, their paper; and how many findings have no change."""
    rows = findings.join(changes, key).join(papers, paper, "left")
    return rows, findings.join(changes, key, "left_anti").agg(F.count("*").alias("unmatched"))


def moved(a: DataFrame, b: DataFrame, key: str, at: str) -> DataFrame:
    """Keys of b, and whether a is newer there; a key that a doesn't have hasn't moved."""
    newer = a.groupBy(key).agg(F.max(at).alias("_a"))
    return b.groupBy(key).agg(F.max(at).alias("_b")).join(newer, key, "left").select(key, F.coalesce(F.col("_a") > F.col("_b"), F.lit(False)).alias("moved"))


def claimed(items: DataFrame, holders: DataFrame, key: str, digest: str, pos: str, holder: str) -> DataFrame:
    """Each item by the first holder that has its content; holders that claim nothing don't come."""
    return holders.join(items, [key, digest]).groupBy(key).agg(F.min_by(holder, F.struct(pos, holder)).alias(holder))


def windows(days: int, step: int) -> list[int]:
    """Look-backs that grow by a step up to all days."""
    return [*range(step, days, step), days] if days > 0 else []


def greedy_chunks(df: DataFrame, group: str, pos: str, size: str, most: int, limit: int) -> DataFrame:
    """The number of the chunk of each row of a group: a chunk ends before it has more than `most` rows or more than `limit` in size.

    A fold over the sorted sizes of a group; a row that is larger than the limit is a chunk of its own.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(size).alias("size"))))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).cast("double").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        cut = (s["n"] > 0) & ((s["n"] >= most) | (s["sum"] + x["size"] > limit))
        chunk = s["chunk"] + cut.cast("int")
        return F.struct(chunk.alias("chunk"), (F.when(cut, 0).otherwise(s["n"]) + 1).cast("int").alias("n"), (F.when(cut, 0.0).otherwise(s["sum"]) + x["size"]).cast("double").alias("sum"), F.concat(s["out"], F.array(chunk)).alias("out"))

    held = df.groupBy(group).agg(rows.alias("_rows")).withColumn("_chunks", F.aggregate("_rows", start, step, lambda s: s["out"]))
    return held.select(group, F.explode(F.arrays_zip("_rows", "_chunks")).alias("_z")).select(group, F.col("_z._rows.pos").alias(pos), F.col("_z._chunks").alias("chunk"))
