"""Absence as a value: trimming, filling and ordering of sentinel-carrying columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that stand for an absent value.
NONE = "(none)"
NONE_FOUND = "(none found)"
UNKNOWN = "(unknown)"
NOT_YET_EXTRACTED = "(not yet extracted)"
REFERENCE_NEEDED = "(reference needed)"
SENTINELS = (NONE, NONE_FOUND, UNKNOWN, NOT_YET_EXTRACTED, REFERENCE_NEEDED)
MISSING = ("NA", "N/A")

_EDGES = r"^[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides; trim() only knows the space."""
    return F.regexp_replace(c, _EDGES, "")


def key(c: Column) -> Column:
    """the form in which texts are compared."""
    return F.lower(strip(c))


def blank_to_null(c: Column) -> Column:
    """X1."""
    return F.nullif(strip(c), F.lit(""))


def fill(c: Column, fallback: str, missing: tuple[str, ...] = MISSING) -> Column:
    """Null, blank and missing-value words become the fallback; anything else stays as it is."""
    return F.when(c.isNull() | F.upper(strip(c)).isin("", *(m.upper() for m in missing)), F.lit(fallback)).otherwise(c)


def is_absent(c: Column) -> Column:
    return F.coalesce(strip(c).isin(*SENTINELS), F.lit(True))


def shown(c: Column) -> Column:
    """The sort and search form: null where the value is absent, so that it comes last in both directions."""
    return F.when(is_absent(c), F.lit(None)).otherwise(c)


def yes_no(c: Column) -> Column:
    """X3."""
    u = F.upper(strip(c))
    return F.when(u.isin("Y", "YES"), "Yes").when(u.isin("N", "NO"), "No").otherwise(c)


def to_boolean(c: Column) -> Column:
    """A text column as boolean; null stays null."""
    u = F.upper(strip(c))
    return F.when(u.isin("Y", "YES", "TRUE", "T", "1"), F.lit(True)).when(u.isNotNull(), F.lit(False))


def has_real_values(array: Column) -> Column:
    """F24."""
    return F.exists(array, lambda x: x != NONE_FOUND)
