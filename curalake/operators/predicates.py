"""Selection algebra, gates and search over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.functions.sentinel import is_absent, key, shown, strip
from curalake.functions.text import roman_tokens

ALL = "all"


def active(selected: Sequence[str], mode: str = "showAll") -> list[str] | None:
    """the normalised choices of an active filter, None for one that lets everything through."""
    on = len(selected) == 1 if mode == "binary" else len(selected) > 0 and ALL not in selected
    return [s.strip().lower() for s in selected] if on else None


def matches(c: Column, selected: Sequence[str], mode: str = "showAll") -> Column:
    """F3."""
    wanted = active(selected, mode)
    return F.lit(True) if wanted is None else F.coalesce(key(c).isin(*wanted), F.lit(False))


def matches_any(array: Column, selected: Sequence[str]) -> Column:
    """F4."""
    wanted = active(selected)
    return F.lit(True) if wanted is None else F.coalesce(F.exists(array, lambda x: key(x).isin(*wanted)), F.lit(False))


def matches_phase(c: Column, selected: Sequence[str]) -> Column:
    """any phase number of the text, or the whole text if it has none."""
    wanted = active(selected)
    if wanted is None:
        return F.lit(True)
    tokens = roman_tokens(c)
    return F.coalesce(F.when(F.size(tokens) > 0, F.arrays_overlap(tokens, F.array(*map(F.lit, wanted)))).otherwise(key(c).isin(*wanted)), F.lit(False))


def matches_prefix(c: Column, selected: Sequence[str], word: str = "industry") -> Column:
    """F8: equal, or the chosen word at the start with a word end behind it."""
    wanted = active(selected)
    if wanted is None:
        return F.lit(True)
    return F.coalesce(key(c).isin(*wanted) | (F.lit(word in wanted) & key(c).rlike(rf"^{word}\b")), F.lit(False))


def matches_status(c: Column, selected: Sequence[str], not_stated: str = "UNKNOWN") -> Column:
    """an absent status counts as not stated."""
    return matches(F.when(is_absent(c), F.lit(not_stated)).otherwise(c), selected)


def curated(c: Column) -> Column:
    """F14."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def not_denied(c: Column, denied: Sequence[str]) -> Column:
    """lets null and unknown values through."""
    return F.coalesce(~F.upper(strip(c)).isin(*denied), F.lit(True))


def search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """rows of which any column's shown text has the searched text; an absent value matches nothing."""
    wanted = F.lit(text.strip().lower())
    hit = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.coalesce(F.contains(F.lower(shown(F.col(c).cast("string"))), wanted), F.lit(False))
    return df.where(hit)


def gates(df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """F16: rows that pass all gates, and how many each gate in turn rejects, in one pass over df; a gate that is null rejects."""
    reason, open_ = F.lit(None).cast("string"), F.lit(True)
    for name, gate in conditions.items():
        condition = F.coalesce(gate, F.lit(False))
        reason = F.coalesce(reason, F.when(~condition, F.lit(name)))
        open_ = open_ & condition
    rejected = df.select(reason.alias("gate")).where("gate is not null").groupBy("gate").agg(F.count("*").alias("rejected"))
    return df.where(open_), rejected


def in_range(c: Column, low: float, high: float) -> Column:
    """null outside the range."""
    return F.when(c.between(low, high), c)


def confidence_verdict(confidence: Column, known: Column, update_floor: float, insert_floor: float) -> Column:
    """Where an entry goes by its score and by whether its key is stored."""
    return F.when(known & (confidence >= update_floor), "update").when(~known & (confidence >= insert_floor), "insert").otherwise("hold")


def first_of(**reasons: Column) -> Column:
    """the reasons that hold, in the order given."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in reasons.items())), lambda x: x.isNotNull())


def grouped(df: DataFrame, groups: Sequence[tuple]) -> DataFrame:
    """rows that every group lets through; a group is (column, rule, choices, options)."""
    condition = F.lit(True)
    for column, rule, chosen, options in groups:
        condition = condition & rule(F.col(column), chosen, **options)
    return df.where(condition)


def visible(status: Column, hidden: Sequence[str], not_stated: str = "UNKNOWN") -> Column:
    """whether a row is shown at first: its status, an absent one as not stated, is none of the hidden ones."""
    return ~F.when(is_absent(status), F.lit(not_stated)).otherwise(F.upper(strip(status))).isin(*hidden)


def summary(chosen: dict[str, Sequence[str]]) -> str:
    """the active filters in words."""
    return "; ".join(f"{name}: {', '.join(values)}" for name, values in chosen.items() if active(values) is not None)
