"""Evidence entries in their stored form `Type;biomarker: item, item*`.

A star marks an item that colocalized; `[?]` stands where a term is to be confirmed, and is printed as `?`. Colons, commas and
the rest count outside parentheses only. A null entry stays null; an empty one has an empty type, no biomarker and no items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalake.functions.sentinel import strip
from curalake.functions.text import given, is_balanced, top_level

ITEM = "struct<text:string,colocalized:boolean>"


def _plain(c: Column) -> Column:
    return strip(F.replace(c, F.lit("*"), F.lit("")))


def printed(c: Column) -> Column:
    """A stored text as people read it."""
    return F.replace(c, F.lit("[?]"), F.lit("?"))


def entry(c: Column) -> Column:
    """An entry as a struct of type, biomarker (null if there is none) and items with their marks."""

    def items(listed: Column) -> Column:
        pairs = F.transform(top_level(listed, ","), lambda x: F.struct(_plain(x).alias("text"), F.contains(x, F.lit("*")).alias("colocalized")))
        return F.filter(pairs, lambda x: x["text"] != "")

    def detailed(detail: Column) -> Column:
        def cut(parts: Column) -> Column:
            several = F.size(parts) > 1
            biomarker = F.when(several, F.nullif(_plain(parts[0]), F.lit("")))
            listed = F.when(several, F.substr(detail, F.length(parts[0]) + 2)).otherwise(detail)
            return F.struct(_plain(F.substring_index(c, ";", 1)).alias("type"), biomarker.alias("biomarker"), items(listed).alias("items"))

        return given(top_level(detail, ":"), cut)

    behind = F.when(F.contains(c, F.lit(";")), F.substr(c, F.instr(c, ";") + 1)).otherwise(F.lit(""))
    return F.when(c.isNotNull(), given(strip(behind), detailed))


def label(e: Column) -> Column:
    """An entry's struct as `Type (biomarker: item, item)`."""
    items = F.nullif(F.array_join(F.transform(e["items"], lambda x: x["text"]), ", "), F.lit(""))
    detail = F.nullif(F.concat_ws(": ", e["biomarker"], items), F.lit(""))
    return printed(F.when(detail.isNull(), e["type"]).otherwise(F.concat(e["type"], F.lit(" ("), detail, F.lit(")"))))


def colocalized(e: Column) -> Column:
    """The items that colocalized, as printed."""
    return F.transform(F.filter(e["items"], lambda x: x["colocalized"]), lambda x: printed(x["text"]))


def safe(c: Column) -> Column:
    """A text that an entry can hold: no stars, no semicolons, no parentheses if one is unmatched, single blanks."""

    def paired(x: Column) -> Column:
        return F.when(is_balanced(x), x).otherwise(F.translate(x, "()", ""))

    bare = F.translate(F.coalesce(c, F.lit("")), ";*", ",")
    return strip(F.regexp_replace(given(bare, paired), r"\s+", " "))


def _parts(c: Column, separator: str) -> Column:
    return F.filter(F.transform(top_level(safe(c), separator), strip), lambda x: x != "")


def to_wire(kind: Column, biomarker: Column, items: Column) -> Column:
    """Type, biomarker and items (text, colocalized) as an entry that `entry` reads back.

    A biomarker's own colons become commas. An item that names several is written as several, each with its mark. Items with a
    colon of their own follow an empty biomarker, or their first colon would end one. Null items count as none.
    """

    def marked(x: Column) -> Column:
        star = F.when(x["colocalized"], F.lit("*")).otherwise(F.lit(""))
        return F.transform(_parts(x["text"], ","), lambda part: F.concat(part, star))

    def joined(pair: Column) -> Column:
        name, listed = pair["name"], pair["listed"]
        bare = (name == "") & (F.size(top_level(listed, ":")) > 1)
        both = F.concat_ws(": ", F.nullif(name, F.lit("")), F.nullif(listed, F.lit("")))
        return F.when(bare, F.concat(kind, F.lit(";: "), listed)).when(both == "", kind).otherwise(F.concat(kind, F.lit(";"), both))

    name = F.array_join(_parts(biomarker, ":"), ", ")
    listed = F.array_join(F.flatten(F.transform(F.coalesce(items, F.array().cast(f"array<{ITEM}>")), marked)), ", ")
    return given(F.struct(name.alias("name"), listed.alias("listed")), joined)


def stored(entries: Column) -> Column:
    """Entries as one JSON array whose semicolons are escaped, so that a cell split at semicolons keeps it whole."""
    quoted = F.transform(entries, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.replace(F.array_join(quoted, ", "), F.lit(";"), F.lit("\\u003b")), F.lit("]"))


def cell_entries(c: Column) -> Column:
    """The entries of a cell: the pieces between semicolons in order, each once; a piece that is a JSON array gives its own.

    A piece that only looks like an array stays a text. Null gives no entries.
    """

    def opened(piece: Column) -> Column:
        inside = F.when(piece.startswith("["), F.from_json(piece, "array<string>", {"mode": "PERMISSIVE"}))
        return F.when(inside.isNotNull() & ~F.exists(inside, lambda x: x.isNull()), inside).otherwise(F.array(piece))

    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip)
    return F.array_distinct(F.filter(F.flatten(F.transform(pieces, opened)), lambda x: x != ""))
