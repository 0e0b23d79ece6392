"""Evidence entries in the printed form `Type (detail)`, traits and names (X12, X13, X19, X21, X30-X33, F19, F27); omics.py has the stored form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalake.functions.sentinel import key, strip


def lookup(c: Column, words: Mapping[str, str], default: Column | None = None) -> Column:
    """A value by the key of a text; without one the default, or the text as it is."""
    pairs = [F.lit(x) for pair in ((k.strip().lower(), v) for k, v in words.items()) for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key(c)), c if default is None else default)


def in_order(array: Column) -> Column:
    """Values that are there and not blank, each at its first place."""
    return F.array_distinct(F.filter(F.transform(array, strip), lambda x: x.isNotNull() & (x != "")))


def rewritten(array: Column, synonyms: Sequence[tuple[str, str]], tracked: Sequence[str] | None = None) -> Column:
    """Each synonym in turn replaced wherever it stands in a trait; untracked traits go; ordered distinct."""

    def one(x: Column) -> Column:
        for old, new in synonyms:
            x = F.replace(x, F.lit(old), F.lit(new))
        return x

    out = in_order(F.transform(array, one))
    return out if tracked is None else F.filter(out, lambda x: x.isin(*tracked))


def folded(array: Column, names: Mapping[str, str], tracked: Sequence[str]) -> Column:
    """Whole traits by their key, then only tracked ones."""
    return F.filter(in_order(F.transform(array, lambda x: lookup(x, names))), lambda x: x.isin(*tracked))


def balanced(c: Column) -> Column:
    """Closing parentheses that are missing at the end are added; ones too many at the end go."""
    depth = F.length(F.regexp_replace(c, r"[^(]", "")) - F.length(F.regexp_replace(c, r"[^)]", ""))
    return F.when(depth > 0, F.concat(c, F.repeat(F.lit(")"), depth))).when(depth < 0, F.regexp_replace(c, r"\)+$", "")).otherwise(c)


def parse(c: Column) -> Column:
    """An entry as a struct of type and detail; an entry without parentheses is all type."""
    c = strip(c)
    kind = F.trim(F.substring_index(c, "(", 1))
    inside = F.regexp_extract(c, r"^[^(]*\((.*)\)\s*$", 1)
    return F.struct(kind.alias("type"), F.nullif(F.trim(inside), F.lit("")).alias("detail"))


def to_wire(entry: Column) -> Column:
    """The struct as an entry."""
    return F.when(entry["detail"].isNull(), entry["type"]).otherwise(F.concat(entry["type"], F.lit(" ("), balanced(entry["detail"]), F.lit(")")))


def leading_type(c: Column, types: Sequence[str]) -> Column:
    """`Type: detail` or `Type detail` as a struct; null if no type leads. Longer types are tried first."""
    names = "|".join(sorted(types, key=lambda t: (-len(t), t)))
    pattern = rf"(?i)^\s*({names})\b[\s:;,-]*(.*)$"
    kind = F.regexp_extract(c, pattern, 1)
    return F.when(kind != "", F.struct(lookup(kind, {t: t for t in types}).alias("type"), F.nullif(F.trim(F.regexp_extract(c, pattern, 2)), F.lit("")).alias("detail")))


def coerced(array: Column, spellings: Mapping[str, str]) -> Column:
    """Entries whose type has a known spelling, in that spelling; others go."""

    def one(x: Column) -> Column:
        e = parse(x)
        kind = lookup(e["type"], spellings, F.lit(None).cast("string"))
        return F.when(kind.isNotNull(), to_wire(F.struct(kind.alias("type"), e["detail"].alias("detail"))))

    return in_order(F.transform(array, one))


def publishable(array: Column, types: Sequence[str]) -> Column:
    """entries of a known type as they are; others if a known type leads them, as `Type (detail)`; else they go."""

    def one(x: Column) -> Column:
        lead = leading_type(x, types)
        return F.when(parse(x)["type"].isin(*types), strip(x)).when(lead.isNotNull(), to_wire(lead))

    return in_order(F.transform(array, one))


def evidence_cell(c: Column, types: Sequence[str]) -> Column:
    """A cell of entries, cleaned in this order: blanks, separators outside parentheses, balance, known types, ordered distinct."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    parts = F.split(c, r"\s*[,;]\s*(?![^(]*\))")
    return publishable(F.transform(parts, lambda x: balanced(strip(x))), types)


def trade_stem(c: Column) -> Column:
    """A name without the code behind it."""
    return F.regexp_replace(strip(c), r"\s+[A-Z]{1,4}-?\d+$", "")


def is_comparator(name: Column, synonyms: Column) -> Column:
    """whether the name or a synonym says placebo, saline or standard care."""
    return F.exists(F.concat(F.array(name), F.coalesce(synonyms, F.array().cast("array<string>"))), lambda x: F.coalesce(x.rlike(r"(?i)\b(?:placebo|saline|standard of care|sham)\b"), F.lit(False)))


def acronyms(c: Column, known: Sequence[str]) -> Column:
    """Known acronyms of a text, the longest that fits at each place, each once."""
    names = "|".join(sorted(known, key=lambda t: (-len(t), t)))
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?<![A-Za-z0-9])(?:{names})(?![A-Za-z0-9])"), F.lit(0)))


def uncovered(c: Column, known: Sequence[str]) -> Column:
    """Tokens of capitals that no known acronym covers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b[A-Z][A-Z0-9]+\b"), F.lit(0)), lambda x: ~x.isin(*known)))


def chain(c: Column) -> Column:
    """The steps of a chain `a >> b < c`."""
    return in_order(F.split(c, r"<<|>>|<|>"))


def trailing_group(c: Column) -> Column:
    """`name (group)` as a struct; the group is the last pair of parentheses."""
    pattern = r"^(.*?)\s*\(([^()]*)\)\s*$"
    return F.struct(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(F.trim(c)).alias("name"), F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")).alias("group"))
