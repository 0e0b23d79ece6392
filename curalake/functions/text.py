"""Text parsers as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curalake.functions.sentinel import strip

#: Words that stay small in a title, and words with a spelling of their own.
SMALL_WORDS = "a an and are as at be but by en for if in is nor not of on or per so the to v via vs from into than that with".split()
#: Words that name no target.
NO_TARGET = ("", "NA", "N/A", "-", "(NONE)", "(UNKNOWN)")
#: Authorities of identifiers, the shape of their ids, and the width to which some are padded.
AUTHORITIES = {
    "efo": ("EFO", r"\d{1,7}", 7),
    "ensembl": ("Ensembl", r"ENSG\d+", 0),
    "hgnc": ("HGNC", r"\d+", 0),
    "go": ("GO", r"\d{1,7}", 7),
    "hp": ("HP", r"\d{1,7}", 7),
    "medgen": ("MedGen", r"CN?\d+", 0),
    "mesh": ("MeSH", r"[CD]\d+", 0),
    "mondo": ("MONDO", r"\d{1,7}", 7),
    "omim": ("OMIM", r"(?:PS)?\d{6}", 0),
    "orphanet": ("Orphanet", r"\d+", 0),
    "umls": ("UMLS", r"C\d+", 0),
}
#: Entities of HTML and what they stand for; the ampersand's own comes last.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·", "bull": "•", "laquo": "«", "raquo": "»", "euro": "€", "times": "×", "amp": "&"}
AUTHORITY_ALIASES = {"orpha": "orphanet", "orphacode": "orphanet", "mim": "omim"}


def distinct_matches(c: Column, pattern: str, group: int = 0) -> Column:
    """X10 with U2: all matches, the first of equal ones kept, in order; null gives an empty array."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group)))


def clean_text(c: Column) -> Column:
    """No-break spaces and line ends normalised, runs of blanks collapsed, lines and ends trimmed."""
    c = F.regexp_replace(F.translate(c, "\u00a0", " "), r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return strip(c)


def snake_case(c: Column) -> Column:
    """X6."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def title_label(name: str) -> str:
    """A column name as its label."""
    words = name.replace("_", " ").split()
    return " ".join(w.lower() if len(w) == 1 or (i and w.lower() in SMALL_WORDS) else w.capitalize() for i, w in enumerate(words))


def camel(label: str) -> str:
    """A label as its wire key."""
    words = re.findall(r"[A-Za-z0-9]+", label)
    return "".join(w.lower() if i == 0 else w[:1].upper() + w[1:].lower() for i, w in enumerate(words))


def pmids(c: Column) -> Column:
    """Article ids of a cell, in order, once each.

    A cell is read as items: links, DOIs, labelled numbers, numbers with thousands separators, plain numbers and other
    words. An id is the number of a labelled item or of a link to an article, and a plain number that is long, or any
    plain number in a cell of nothing but plain numbers.
    """
    link, label, doi = r"https?://\S+", r"PMID\s*:?\s*\d+", r"(?:doi:\s*\S+|\b10\.\d{4,9}/\S+)"
    grouped, plain, word = r"\b\d{1,3}(?:,\d{3})+\b", r"\b\d+\b", r"[^\s,;\d]+"
    items = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)" + "|".join((link, rf"\b{label}\b", doi, grouped, plain, word))), F.lit(0))
    article = r"(?i)^https?://(?:www\.)?(?:pubmed\.ncbi\.nlm\.nih\.gov/|ncbi\.nlm\.nih\.gov/pubmed/)([1-9]\d*)"

    def read(x: Column) -> Column:
        number = F.when(x.rlike(article), F.regexp_extract(x, article, 1)).when(x.rlike(rf"(?i)^{label}$"), F.regexp_extract(x, r"(\d+)$", 1)).when(x.rlike(r"^\d+$"), x)
        return F.struct(F.when(number.rlike("^[1-9]"), number).alias("number"), x.rlike(r"^\d+$").alias("bare"))

    read_items = F.transform(items, read)
    only_bare = F.forall(read_items, lambda x: x["bare"])
    used = F.filter(read_items, lambda x: x["number"].isNotNull() & (~x["bare"] | only_bare | (F.length(x["number"]) >= 7)))
    return F.array_distinct(F.transform(used, lambda x: x["number"]))


def is_doi(c: Column) -> Column:
    """F23."""
    return strip(c).rlike(r"^10\.[0-9]{4,9}/\S+$")


def is_pmid(c: Column) -> Column:
    """F23."""
    return strip(c).rlike(r"^[1-9]\d*$")


def is_symbol(c: Column) -> Column:
    """Capitals, digits and hyphens, with an open reading frame in small letters allowed."""
    return strip(c).rlike(r"^[A-Z][A-Z0-9-]*(?:orf\d+[A-Z0-9-]*)?$")


def is_series(c: Column) -> Column:
    """F23."""
    return strip(c).rlike(r"^PS\d{6}$")


def targets(c: Column) -> Column:
    """X11: the symbols of a target cell, pair shorthand spelled out, leading labels dropped.

    The word N/A goes before anything is cut, as it has a slash itself. The cell is cut at commas and semicolons, and each
    part at slashes; behind a slash, digits alone take the stem of the symbol before it, which is two letters or digits at least.
    """
    cell = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\bN/A\b", "")

    def spelled(part: Column) -> Column:
        start = F.struct(F.lit("").alias("stem"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            pair = x.rlike(r"^\d+$") & (state["stem"] != "")
            stem = F.when(pair, state["stem"]).otherwise(F.regexp_extract(x, r"([A-Z][A-Z0-9]*[A-Z0-9])\d$", 1))
            return F.struct(stem.alias("stem"), F.concat(state["out"], F.array(F.when(pair, F.concat(state["stem"], x)).otherwise(x))).alias("out"))

        return F.aggregate(F.transform(F.split(part, "/"), strip), start, step, lambda s: s["out"])

    named = F.transform(F.flatten(F.transform(F.split(cell, "[,;]"), spelled)), lambda x: strip(F.substring_index(x, ": ", -1)))
    return F.array_distinct(F.filter(named, lambda x: ~F.upper(x).isin(*NO_TARGET)))


def given(value: Column, then) -> Column:
    """then(value), with value computed once however often it is named there."""
    return F.transform(F.array(value), then)[0]


def _open_ends(c: Column) -> Column:
    """What the parentheses of a text leave when pairs are gone: `down` closing ones, then `up` opening ones."""

    def step(s: Column, sign: Column) -> Column:
        opens, closes = sign == "(", (sign == ")") & (s["up"] > 0)
        up = s["up"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct((s["down"] + F.when((sign == ")") & ~closes, 1).otherwise(0)).alias("down"), up.alias("up"))

    return F.aggregate(F.split(F.regexp_replace(c, "[^()]", ""), ""), F.struct(F.lit(0).alias("down"), F.lit(0).alias("up")), step)


def is_balanced(c: Column) -> Column:
    """Whether every parenthesis has its other one."""
    return given(_open_ends(c), lambda s: (s["down"] == 0) & (s["up"] == 0))


def top_level(c: Column, separator: str) -> Column:
    """A text cut at a separator outside parentheses, as it is. A closing parenthesis without an opening one counts for nothing.

    Cuts at every separator, then a fold over the pieces keeps the depth and where parts start; pieces of a part are joined.
    """

    def step(s: Column, ends: Column) -> Column:
        starts = F.when(s["depth"] == 0, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"])
        depth = F.greatest(s["depth"] - ends["down"], F.lit(0)) + ends["up"]
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), starts.alias("starts"))

    def parts(pieces: Column) -> Column:
        none = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("starts"))

        def cut(starts: Column) -> Column:
            end = lambda i: F.coalesce(F.try_element_at(starts, i + 2), F.size(pieces) + 1)
            return F.transform(starts, lambda at, i: F.array_join(F.slice(pieces, at, end(i) - at), separator))

        return given(F.aggregate(F.transform(pieces, _open_ends), none, step, lambda s: s["starts"]), cut)

    return given(F.split(c, re.escape(separator), -1), parts)


def split_top_level(c: Column, separator: str = ",") -> Column:
    """At separators outside nested parentheses, each part without its blanks."""
    return F.transform(top_level(c, separator), strip)


def canonical_xref(source: Column, reference: Column) -> Column:
    """PREFIX:LOCAL, or null for an authority or a shape that isn't known.

    The authority is a lookup in a map of prefix, shape and width; the local id is what follows the last separator.
    """
    entry = lambda own: F.struct(*(F.lit(v).alias(n) for n, v in zip(("prefix", "shape", "width"), AUTHORITIES[own])))
    names = {own: own for own in AUTHORITIES} | AUTHORITY_ALIASES
    known = F.create_map(*(x for name, own in names.items() for x in (F.lit(name), entry(own))))
    found = F.try_element_at(known, F.lower(strip(source)))
    local = F.regexp_extract(strip(reference), r"([^:_]*)$", 1)
    padded = F.when(found["width"] > F.length(local), F.concat(F.repeat(F.lit("0"), found["width"] - F.length(local)), local)).otherwise(local)
    return F.when(F.regexp_like(local, F.concat(F.lit("^(?:"), found["shape"], F.lit(")$"))), F.concat(found["prefix"], F.lit(":"), padded))


#: The phase numbers, and the letters of sub-phases.
PHASES = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
SUB_PHASES = ("a", "b")


def roman_tokens(c: Column) -> Column:
    """The phase numbers among the words of a phase text, the letter of a sub-phase dropped."""
    words = F.split(F.lower(c), r"[^a-z0-9_]+")
    split_up = [n + s for n in PHASES[:4] for s in SUB_PHASES]
    plain = F.transform(words, lambda x: F.when(x.isin(*split_up), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.filter(plain, lambda x: x.isin(*PHASES))


def month_year(c: Column) -> Column:
    """O1: months since year 0 of an M/YYYY text, else null."""
    month, year = (F.try_to_number(F.nullif(F.regexp_extract(strip(c), r"^(0?[1-9]|1[0-2])/(\d{4})$", k), F.lit("")), F.lit("9999")) for k in (1, 2))
    return (year * 12 + month - 1).cast("int")


def completion_label(c: Column) -> Column:
    """An ISO month or day as M/YYYY; anything else as it is."""
    return F.regexp_replace(c, r"^(\d{4})-0?(\d{1,2})(-\d{2})?$", "$2/$1")


def to_month(c: Column) -> Column:
    """An ISO day cut to its month."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(c, 1, 7)).otherwise(c)


def chromosome_rank(c: Column) -> Column:
    """O3: 0-21, X 22, Y 23; a location that can't be placed 24.

    What stands before the first arm is the chromosome; each end of what follows must be an arm with a band.
    """
    place = F.lower(strip(c))
    name = F.regexp_replace(place, "[pq].*$", "")
    ends = F.split(F.substr(place, F.length(name) + 1), "-")
    good = (F.length(name) == F.length(place)) | ((F.size(ends) <= 2) & F.forall(ends, lambda x: x.rlike(r"^[pq]\d+(?:\.\d+)?$")))
    order = F.array_position(F.array(*(F.lit(str(n)) for n in range(1, 23)), F.lit("x"), F.lit("y")), F.regexp_replace(name, r"^0+(?=\d)", ""))
    return F.when(good & (order > 0), order - 1).otherwise(24).cast("int")


def natural_key(c: Column) -> Column:
    """Texts with numbers in the order of the numbers; case doesn't count."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))


def path_template(path: Column) -> Column:
    """Segments with a digit become :id, but for version markers; a DOI runs to the end."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    doi = F.array_position(F.transform(segments, lambda x: x.rlike(r"^10\.\d{4,9}$")), F.lit(True)).cast("int")
    head = F.when(doi > 0, F.slice(segments, F.lit(1), F.greatest(doi - 1, F.lit(0)))).otherwise(segments)
    named = F.transform(head, lambda x: F.when(x.rlike(r"\d") & ~x.rlike(r"^v\d+$"), ":id").otherwise(x))
    return F.concat(F.lit("/"), F.array_join(F.when(doi > 0, F.concat(named, F.array(F.lit(":id")))).otherwise(named), "/"))


def plain_html(c: Column) -> Column:
    """The text of an HTML page: scripts, styles and tags cut, entities of the markup read, blanks collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, text in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{entity};"), F.lit(text))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def count_of(c: Column) -> Column:
    """A count, with thousands separators or without; anything else null."""
    c = strip(c)
    return F.when(c.rlike(r"^\d{1,3}(,\d{3})+$|^\d+$"), F.regexp_replace(c, ",", "").try_cast("long"))


def decimal_of(c: Column) -> Column:
    """A decimal number; anything else null."""
    c = strip(c)
    return F.when(c.rlike(r"^-?\d+(\.\d+)?([eE]-?\d+)?$"), c.try_cast("double"))


def interval_of(c: Column) -> Column:
    """`low-high` or `low, high` as a struct; null if it is neither or runs backwards."""
    low, high = (F.regexp_extract(strip(c), r"^\(?(\d+(?:\.\d+)?)(?:\s*(?:-|to)\s*|,\s+)(\d+(?:\.\d+)?)\)?$", k).try_cast("double") for k in (1, 2))
    return F.when(low <= high, F.struct(low.alias("low"), high.alias("high")))


def sentence_like(c: Column) -> Column:
    """four words or more."""
    return F.size(F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")) >= 4


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    def fold(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return texts.map(fold)


def fold_accents(c: Column) -> Column:
    """Letters decomposed and without their marks, in lower case, everything else as single spaces; null stays null.

    Decomposition is a batch function, as Spark has none; texts of ASCII alone pass it as they are.
    """
    return F.regexp_replace(F.lower(_folded(c)), r"[^a-z0-9]+", " ")


def fingerprint(*columns: Column) -> Column:
    """Eight hexadecimal digits of a row's text; each cell has its length before it, so no two rows have one text."""
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.substring(F.md5(F.concat(*(x for c in cells for x in (F.length(c).cast("string"), F.lit(":"), c))).cast("binary")), 1, 8)


def place(*parts: Column) -> Column:
    """The parts that are there, with commas."""
    return F.concat_ws(", ", *(F.nullif(strip(p), F.lit("")) for p in parts))


def publishable_error(c: Column) -> Column:
    """An error text without links, paths and long secrets."""
    c = F.regexp_replace(c, r"https?://\S+", "<url>")
    return F.regexp_replace(F.regexp_replace(c, r"(?:/[\w.-]+){2,}", "<path>"), r"\b[A-Za-z0-9_-]{24,}\b", "<redacted>")


def duration_label(seconds: Column) -> Column:
    """1h 2m, 3m 4s or 5s."""
    s = F.floor(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes)).when(minutes > 0, F.format_string("%dm %ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))
