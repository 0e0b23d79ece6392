"""Stored documents of several versions as VARIANT, read by type and brought to today's shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each version of a run document says otherwise than the next one.
#: 1: findings are texts, and the window is told by a sentence. 2: findings are objects of kind and text; the window is a number.
#: 3: the window has a unit; `paper` is what was `article` in texts.
NEWEST = 3


def parsed(text: Column) -> Column:
    """The document as VARIANT; null where the text is no JSON."""
    return F.try_parse_json(text)


def at(document: Column, path: str, kind: str, default: Column | None = None) -> Column:
    """The value at a path in the type asked for; null, or the default, where it isn't there or is of another type."""
    value = F.try_variant_get(document, path, kind)
    return value if default is None else F.coalesce(value, default)


def one_of(document: Column, paths: Sequence[str], kind: str) -> Column:
    """The value at the first of the paths that has one."""
    return F.coalesce(*(F.try_variant_get(document, p, kind) for p in paths))


def items(document: Column, path: str, read: Callable[[Column], Column]) -> Column:
    """The items of an array as read gives them, items that it gives null for left out; no array is none."""
    found = F.coalesce(F.try_variant_get(document, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(found, read), lambda x: x.isNotNull())


def reworded(c: Column, wordings: Sequence[tuple[str, str]]) -> Column:
    """Patterns of older wordings replaced in turn."""
    for pattern, text in wordings:
        c = F.regexp_replace(c, pattern, text)
    return c


def run_document(text: Column, wordings: Sequence[tuple[str, str]]) -> Column:
    """A run document of any version in today's shape; null if it is no JSON, or has no id or no version that is known.

    days is the window: `window.days`, or `window_days` before version 3, or what the sentence of version 1 tells. Findings
    of version 1 are of the kind `note`. A finding without a text is left out; a kind that isn't text is `note`.
    """
    d = parsed(text)
    version = at(d, "$.version", "int")
    told = F.regexp_extract(at(d, "$.search", "string", F.lit("")), r"last (\d+) days?", 1).try_cast("int")
    days = F.coalesce(one_of(d, ["$.window.days", "$.window_days"], "int"), F.when(version == 1, told))

    def finding(x: Column) -> Column:
        own = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.text", "string"))
        said = F.nullif(F.trim(F.when(version < 3, reworded(own, wordings)).otherwise(own)), F.lit(""))
        return F.when(said.isNotNull(), F.struct(at(x, "$.kind", "string", F.lit("note")).alias("kind"), said.alias("text")))

    counts = F.struct(*(F.greatest(at(d, f"$.counts.{c}", "long", F.lit(0).cast("long")), F.lit(0)).alias(c) for c in ("read", "kept")))
    shape = F.struct(at(d, "$.id", "string").alias("id"), F.lit(NEWEST).alias("version"), version.alias("written_as"), days.alias("days"), items(d, "$.findings", finding).alias("findings"), counts.alias("counts"))
    known = version.between(1, NEWEST) & (F.trim(at(d, "$.id", "string")) != "")
    return F.when(F.coalesce(known, F.lit(False)), shape)
