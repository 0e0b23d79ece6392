"""Rows from nested records and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions.evidence import in_order, is_comparator
from curalake.functions.sentinel import fill, key, strip


def scan(spark: SparkSession, folder: str, name: str, allowed: Sequence[str], order: Sequence[str], hidden: Sequence[str] = ()) -> DataFrame:
    """A table that may be published, in the order of its key, without its own bookkeeping columns."""
    if name not in allowed:
        raise ValueError(f"{name} is not a table that is published")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.orderBy(*order).select(*(c for c in df.columns if c not in hidden))


def with_placeholders(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """List columns that are filled later, null so far."""
    return df.withColumns({c: F.lit(None).cast("array<string>") for c in lists})


def of_keys(df: DataFrame, keys: DataFrame, column: str, key_column: str) -> DataFrame:
    """Rows whose column, as text, is one of the keys."""
    wanted = keys.select(F.col(key_column).cast("string").alias("_key")).distinct()
    return df.join(wanted, df[column].cast("string") == F.col("_key"), "left_semi")


def relevant(conditions: Column, any_of: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> Column:
    """a condition has one of the words, or both of a pair; a study without conditions stays."""

    def one(x: Column) -> Column:
        hit = F.lit(False)
        for w in any_of:
            hit = hit | F.contains(key(x), F.lit(w.lower()))
        for a, b in pairs:
            hit = hit | (F.contains(key(x), F.lit(a.lower())) & F.contains(key(x), F.lit(b.lower())))
        return hit

    return F.coalesce(F.size(conditions) == 0, F.lit(True)) | F.coalesce(F.exists(conditions, one), F.lit(False))


def interventional(c: Column) -> Column:
    """a type that isn't stated counts."""
    return F.coalesce(F.upper(strip(c)) == "INTERVENTIONAL", F.lit(True))


def agents(interventions: Column, kinds: Sequence[str]) -> Column:
    """Distinct names of interventions (kind, name, other_names) of the kinds, comparators left out, in order."""
    used = F.filter(interventions, lambda x: F.upper(x["kind"]).isin(*kinds) & ~is_comparator(x["name"], x["other_names"]))
    return in_order(F.transform(used, lambda x: x["name"]))


def widest(spans: Column) -> Column:
    """The largest distance of (start, stop) texts; bad ones are skipped, none is 0."""
    return F.coalesce(F.array_max(F.transform(spans, lambda x: F.abs(x["stop"].try_cast("long") - x["start"].try_cast("long")))), F.lit(0).cast("long"))


def describes(symbols: Column, kinds: Column, spans: Column, most_symbols: int, barred: Sequence[str], most_span: int) -> Column:
    """a record of few symbols, of no barred kind, and short."""
    return (F.size(symbols).between(1, most_symbols)) & ~F.arrays_overlap(kinds, F.array(*map(F.lit, barred))) & (widest(spans) <= most_span)


def referenced(rows: DataFrame, links: DataFrame, key_column: str, array: str) -> DataFrame:
    """rows that a list of links names."""
    return rows.join(links.select(F.explode(array).alias(key_column)).distinct(), key_column, "left_semi")


def normalised(df: DataFrame, texts: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """the kept columns and the texts with their sentinels."""
    return df.select(*keep, *(fill(F.col(c), absent).alias(c) for c, absent in texts.items()))


def stored_form(df: DataFrame, texts: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """The inverse of normalised: sentinels become null again."""
    return df.select(*keep, *(F.nullif(F.col(c), F.lit(absent)).alias(c) for c, absent in texts.items()))


def agent_rows(studies: DataFrame, kinds: Sequence[str], id_column: str = "id") -> DataFrame:
    """F32: one row for each agent of a study; a study without agents gives none."""
    return studies.withColumn("agent", F.explode(agents(F.col("interventions"), kinds))).drop("interventions")


def facility_rows(studies: DataFrame, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """one row for each facility with coordinates on the globe; and how many each study had dropped."""
    rows = studies.select(id_column, F.explode("locations").alias("l")).select(id_column, "l.*")
    good = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    dropped = rows.groupBy(id_column).agg(F.count_if(~good).alias("dropped"))
    return rows.where(good), dropped


def edges(targets: DataFrame, relations: Mapping[str, str], id_column: str) -> DataFrame:
    """(id, relation, value) of each list column, each edge once."""
    out = None
    for relation, column in relations.items():
        part = targets.select(id_column, F.lit(relation).alias("relation"), F.explode(in_order(F.col(column))).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def best_hit(hits: DataFrame, id_column: str, exact: Column, pos: str, value: str, only_exact: bool = False) -> DataFrame:
    """The first hit that is exact, else (unless only exact ones count) the first one."""
    rows = hits.withColumn("_exact", F.coalesce(exact, F.lit(False)))
    rows = rows.where("_exact") if only_exact else rows
    return rows.groupBy(id_column).agg(F.min_by(value, F.struct(~F.col("_exact"), F.col(pos))).alias(value))


def fallback(requested: DataFrame, registries: Sequence[DataFrame], key_column: str, value: str) -> DataFrame:
    """The value of the first registry that has the key, and which one that was (from 1; null if none)."""
    out = requested
    for n, r in enumerate(registries):
        out = out.join(r.select(key_column, F.col(value).alias(f"_v{n}")), key_column, "left")
    found = F.lit(None).cast("int")
    for n in reversed(range(len(registries))):
        found = F.when(F.col(f"_v{n}").isNotNull(), F.lit(n + 1)).otherwise(found)
    return out.select(*requested.columns, F.coalesce(*(F.col(f"_v{n}") for n in range(len(registries)))).alias(value), found.alias("registry"))


def checked_settings(settings: Mapping[str, object], version: int, needed: Sequence[str]) -> dict[str, object]:
    """Settings of the version that is understood, with all that is needed; fails with every fault at once."""
    faults = [] if settings.get("version") == version else [f"version {settings.get('version')} instead of {version}"]
    faults += [f"{n} is missing" for n in needed if n not in settings]
    if faults:
        raise ValueError("; ".join(faults))
    return dict(settings)
