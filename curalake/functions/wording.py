"""Texts for people: citations, labels, links, dates and amounts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curalake.functions.sentinel import strip
from curalake.functions.text import given


def missing_to_null(c: Column, words: Sequence[str]) -> Column:
    """Words for a missing value, and blanks, become null."""
    return F.when(~F.upper(strip(c)).isin("", *(w.upper() for w in words)), c)


def strip_bullets(c: Column) -> Column:
    """Without the bullet that leads the text."""
    return F.regexp_replace(strip(c), r"^[•*·-]\s+", "")


def registry(c: Column, names: Mapping[str, str]) -> Column:
    """The registry that the letters of an id stand for; null for others."""
    prefix = F.upper(F.regexp_extract(strip(c), r"^([A-Za-z]+)", 1))
    out = F.lit(None).cast("string")
    for p, name in names.items():
        out = F.when(prefix == p, F.lit(name)).otherwise(out)
    return out


def registry_link(c: Column, links: Mapping[str, str]) -> Column:
    """The address of an id; {} stands for the id."""
    prefix = F.upper(F.regexp_extract(strip(c), r"^([A-Za-z]+)", 1))
    out = F.lit(None).cast("string")
    for p, link in links.items():
        out = F.when(prefix == p, F.replace(F.lit(link), F.lit("{}"), F.url_encode(strip(c)))).otherwise(out)
    return out


def phase_label(codes: Column, names: Mapping[str, str]) -> Column:
    """Phase codes as one label, with a slash between; codes that aren't known go; null if none is left."""
    one = lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x)
    return F.nullif(F.array_join(F.filter(F.transform(codes, lambda x: F.when(x.isin(*names), one(x))), lambda x: x.isNotNull()), "/"), F.lit(""))


def sponsor_class(c: Column, folds: Mapping[str, str], other: str) -> Column:
    """The class of a sponsor; null stays null."""
    out = F.lit(other)
    for name, label in folds.items():
        out = F.when(F.upper(strip(c)) == name, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def first_author(authors: Column) -> Column:
    """Who leads a list `Smith J, Doe A`, as `Smith, J.`; a name without initials behind it stays whole; null for none."""
    name = F.regexp_replace(strip(F.element_at(F.split(authors, ","), 1)), r"(?U)\s+", " ")
    initials = F.replace(F.substring_index(name, " ", -1), F.lit("."), F.lit(""))
    surname = F.regexp_replace(name, r" [^ ]*$", "")
    shown = F.concat(surname, F.lit(", "), F.substring(F.substring_index(name, " ", -1), 1, 1), F.lit("."))
    return F.nullif(F.when(name.contains(" ") & initials.rlike(r"^\p{Lu}{1,4}(-\p{Lu}{1,2})?$"), shown).otherwise(name), F.lit(""))


def citation_year(date: Column) -> Column:
    """The first year from 1800 to 2099 that stands alone in a date; null for none."""
    return F.nullif(F.regexp_extract(date, r"\b(1[89]\d{2}|20\d{2})\b", 1), F.lit(""))


def short_citation(authors: Column, date: Column, pmid: Column) -> Column:
    """`Smith, J., et al. (2022)`; without a year, the name; without a name, the id."""
    several = F.size(F.filter(F.split(authors, ","), lambda x: strip(x) != "")) > 1
    who = F.concat(first_author(authors), F.when(several, F.lit(", et al.")).otherwise(F.lit("")))
    year = F.coalesce(F.concat(F.lit(" ("), citation_year(date), F.lit(")")), F.lit(""))
    return F.coalesce(F.concat(who, year), F.concat(F.lit("PMID "), pmid.cast("string")))


def doi_link(c: Column) -> Column:
    """The address of a DOI, each segment encoded; null for what is none."""
    parts = F.transform(F.split(strip(c), "/"), F.url_encode)
    return F.when(strip(c).rlike(r"^10\.[0-9]{4,9}/\S+$"), F.concat(F.lit("https://doi.org/"), F.array_join(parts, "/")))


def escaped(c: Column) -> Column:
    """HTML's own signs as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def author_list(names: Column, most: int = 3) -> Column:
    """The names, or the first of them and et al.; null for none."""
    rest = F.when(F.size(names) > most, F.lit(", et al.")).otherwise(F.lit(""))
    return F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, most), ", "), rest))


def sentence_case(c: Column) -> Column:
    """Single blanks, and a capital in front; later letters stay as they are."""
    words = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def formatted_citation(authors: Column, title: Column, journal: Column, date: Column, doi: Column) -> Column:
    """Authors in bold, the title in italics, the journal with its date, the DOI, with breaks between; null and empty ones are left out."""
    there = lambda c: escaped(F.nullif(c, F.lit("")))
    when = F.coalesce(F.concat(F.lit(" ("), there(date), F.lit(")")), F.lit(""))
    what = there(F.when(title != "", sentence_case(title)))
    what = F.when(title != "", F.concat(F.lit("<i>"), F.coalesce(what, F.lit("")), F.lit("</i>")))
    return F.concat_ws("<br>", F.concat(F.lit("<b>"), there(authors), F.lit("</b>")), what, F.concat(there(journal), when), F.concat(F.lit("DOI: "), there(doi)))


#: The labels of a whole citation's lines, and the entities that are read back.
CITATION_LABELS = ("Authors", "Title", "Journal", "DOI")
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " "}


def plain_line(c: Column) -> Column:
    """A line without tags, its entities as signs; each entity is read once, so `&amp;lt;` is `&lt;`."""
    c = F.regexp_replace(c, "<[^>]*>", "")
    for entity, sign in sorted(ENTITIES.items(), key=lambda e: e[0] == "&amp;"):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return strip(c)


def citation_lines(c: Column) -> Column:
    """The lines of a formatted citation as structs of label and value; of other than four lines one row, `Reference`; null stays null."""

    def labelled(lines: Column) -> Column:
        whole = F.transform(lines, lambda x, i: F.struct(F.element_at(F.array(*map(F.lit, CITATION_LABELS)), i + 1).alias("label"), F.when(i == 3, F.regexp_replace(x, r"(?i)^DOI:\s*", "")).otherwise(x).alias("value")))
        one = F.array(F.struct(F.lit("Reference").alias("label"), F.array_join(lines, " ").alias("value")))
        return F.when(F.size(lines) == len(CITATION_LABELS), whole).otherwise(one)

    lines = F.filter(F.transform(F.split(c, r"(?i)<br\s*/?>"), plain_line), lambda x: x != "")
    return F.when(c.isNotNull(), given(lines, labelled))


def located(text: Column, quote: Column) -> Column:
    """Where a quote stands among the words of a text, whatever the white space and signs; 0 if it doesn't."""
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.when(F.trim(words(quote)) == "", F.lit(0)).otherwise(F.call_function("locate", words(quote), words(text)))


def without_back_matter(c: Column, heading: str) -> Column:
    """Cut at the first heading in the latter half of a text."""
    half = F.floor(F.length(c) / 2).cast("int")
    at = F.instr(F.substr(c, half + 1), heading)
    return F.when(at > 0, F.substr(c, F.lit(1), half + at - 1)).otherwise(c)


def error_kind(c: Column, kinds: Mapping[str, str], other: str) -> Column:
    """The first kind whose pattern an error or reason has."""
    out = F.lit(other)
    for name, pattern in reversed(list(kinds.items())):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def bytes_label(n: Column) -> Column:
    """B, KB or MB, with one place from KB on."""
    one = lambda x: F.format_string("%.1f", x)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / 1048576), F.lit(" MB")))


def percent_label(part: Column, whole: Column) -> Column:
    """A whole percentage; only none and all are 0 and 100; without a whole it is absent."""
    p = F.round(100 * part / whole)
    return F.when(whole > 0, F.concat(F.when(part == 0, 0).when(part == whole, 100).otherwise(F.greatest(F.lit(1), F.least(F.lit(99), p))).cast("int").cast("string"), F.lit("%")))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """`1 paper`, `2 papers`."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def truncation_note(shown: Column, total: Column) -> Column:
    """How many of a capped list are shown; null if all are."""
    return F.when(shown < total, F.concat(F.lit("first "), shown.cast("string"), F.lit(" of "), total.cast("string")))


def query_text(terms: Column, field: str, extra: str = "") -> Column:
    """The terms as one disjunction, in order, with what every hit must have."""
    either = F.array_join(F.transform(terms, lambda x: F.concat(F.lit('"'), x, F.lit(f'"[{field}]'))), " OR ")
    return F.concat(F.lit("("), either, F.lit(")" + (f" AND {extra}" if extra else "")))


def field_issues(c: Column) -> Column:
    """The rules that a text breaks, in order."""
    rules = {"blank": F.length(strip(c)) == 0, "edge blanks": c != strip(c), "double blank": c.rlike("  "), "control character": c.rlike(r"[\x00-\x08\x0e-\x1f]"), "not ASCII": c.rlike(r"[^\x00-\x7f]"), "no letter": ~c.rlike(r"[A-Za-z]")}
    return F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())


def noted_month(month: Column, note: Column) -> Column:
    """Y2: `YYYY-MM` as M/YYYY with its note behind it."""
    label = F.regexp_replace(month, r"^(\d{4})-0?(\d{1,2})$", "$2/$1")
    return F.concat(label, F.when(F.length(strip(note)) > 0, F.concat(F.lit(" ("), strip(note), F.lit(")"))).otherwise(""))


def headline(kind: Column, added: Column, removed: Column) -> Column:
    """What a change proposes."""
    both = F.concat_ws(", ", F.when(added > 0, F.concat(F.lit("adds "), counted(added, "value"))), F.when(removed > 0, F.concat(F.lit("drops "), counted(removed, "value"))))
    return F.when(kind == "added", "new row").when(kind == "removed", "row goes").otherwise(F.when(both == "", "no value changes").otherwise(both))
