"""Article records as archives send them: citations by a declared XML schema, full texts by their blocks."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DATE = "PubDate STRUCT<Year: STRING, Month: STRING, MedlineDate: STRING>"
_AUTHORS = "AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, Initials: STRING, CollectiveName: STRING>>>"
_IDS = "ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_IdType: STRING, _VALUE: STRING>>>"
#: What is read of a record set. Element names are those of the archive.
CITATION = f"""
    PubmedArticle STRUCT<
        MedlineCitation: STRUCT<
            PMID: STRING,
            Article: STRUCT<
                Journal: STRUCT<Title: STRING, ISOAbbreviation: STRING, JournalIssue: STRUCT<{_DATE.replace("PubDate ", "PubDate: ")}>>,
                ArticleTitle: STRING, {_AUTHORS}, ELocationID: ARRAY<STRUCT<_EIdType: STRING, _VALUE: STRING>>>>,
        PubmedData: STRUCT<{_IDS}>>,
    PubmedBookArticle STRUCT<
        BookDocument: STRUCT<PMID: STRING, {_IDS}, Book: STRUCT<BookTitle: STRING, {_DATE.replace("PubDate ", "PubDate: ")}, {_AUTHORS}>, ArticleTitle: STRING, {_AUTHORS}>>,
    _broken STRING
"""


def _plain(c: Column) -> Column:
    """Text without the markup that titles carry; null if nothing is left."""
    for entity, text in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c if entity != "lt" else F.regexp_replace(c, r"<[^>]*>", ""), F.lit(f"&{entity};"), F.lit(text))
    return F.nullif(F.trim(c), F.lit(""))


def _names(authors: Column) -> Column:
    """`Last Initials` of people, the name of a group; authors without either are skipped."""

    def one(a: Column) -> Column:
        last = F.nullif(F.trim(a["LastName"]), F.lit(""))
        group = F.nullif(F.trim(F.regexp_replace(a["CollectiveName"], r"\s+", " ")), F.lit(""))
        return F.coalesce(F.when(last.isNotNull(), F.concat_ws(" ", last, F.nullif(F.trim(a["Initials"]), F.lit("")))), group)

    return F.nullif(F.array_join(F.filter(F.transform(authors, one), lambda x: x.isNotNull()), ", "), F.lit(""))


def _date(d: Column) -> Column:
    """Month and year, the year, or the range that stands in their place."""
    year = F.nullif(F.trim(d["Year"]), F.lit(""))
    return F.when(year.isNull(), F.nullif(F.trim(d["MedlineDate"]), F.lit(""))).otherwise(F.concat_ws(" ", F.nullif(F.trim(d["Month"]), F.lit("")), year))


def _first(ids: Column, kind: str) -> Column:
    """The first id that is a DOI."""
    own = F.filter(ids, lambda x: (x[kind] == "doi") & (F.coalesce(F.trim(x["_VALUE"]), F.lit("")) != ""))
    return F.trim(F.try_element_at(own, F.lit(1))["_VALUE"])


def citation(xml: Column) -> Column:
    """State, pmid, title, journal, authors, date and doi of a record in XML.

    state is `article`, `book` (a chapter: the book is its journal, and stands in for a missing title; the editors for missing
    authors), `none` for a set without a record, or `broken` for text that is no XML; null and empty texts are broken. A DOI
    is the record's own: those of the papers that it cites have other paths. What isn't there is null.
    """
    r = F.from_xml(F.coalesce(xml, F.lit("")), CITATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreSurroundingSpaces": "true"})
    article, meta = r["PubmedArticle"]["MedlineCitation"]["Article"], r["PubmedArticle"]["PubmedData"]
    book = r["PubmedBookArticle"]["BookDocument"]
    whole = F.coalesce(F.trim(xml), F.lit("")).endswith(">")
    state = F.when(r.isNull() | r["_broken"].isNotNull() | ~whole, "broken").when(r["PubmedArticle"].isNotNull(), "article").when(book.isNotNull(), "book").otherwise("none")
    pick = lambda one, other: F.when(state == "article", one).when(state == "book", other)
    book_title = _plain(book["Book"]["BookTitle"])
    return F.struct(
        state.alias("state"),
        pick(r["PubmedArticle"]["MedlineCitation"]["PMID"], book["PMID"]).alias("pmid"),
        pick(_plain(article["ArticleTitle"]), F.coalesce(_plain(book["ArticleTitle"]), book_title)).alias("title"),
        pick(F.coalesce(_plain(article["Journal"]["Title"]), _plain(article["Journal"]["ISOAbbreviation"])), book_title).alias("journal"),
        pick(_names(article["AuthorList"]["Author"]), F.when(book["AuthorList"].isNotNull(), _names(book["AuthorList"]["Author"])).otherwise(_names(book["Book"]["AuthorList"]["Author"]))).alias("authors"),
        pick(_date(article["Journal"]["JournalIssue"]["PubDate"]), _date(book["Book"]["PubDate"])).alias("date"),
        pick(F.coalesce(_first(meta["ArticleIdList"]["ArticleId"], "_IdType"), _first(article["ELocationID"], "_EIdType")), _first(book["ArticleIdList"]["ArticleId"], "_IdType")).alias("doi"),
    )


#: Elements that are a block of text each, and what is left out with all that it holds.
BLOCKS, LEFT_OUT = ("p", "title", "tr"), "ref-list"


def _line(element: ET.Element) -> str:
    return " ".join(" ".join(element.itertext()).split())


def _blocks(element: ET.Element, out: list[str]) -> None:
    """Blocks in the order of the document; an element inside a block is part of it. The stack holds what is still to come."""
    stack = [element]
    while stack:
        e = stack.pop()
        if e.tag == LEFT_OUT:
            continue
        if e.tag in BLOCKS:
            cells = [_line(c) for c in e if c.tag in ("th", "td")]
            text = (" | ".join(cells) if any(cells) else "") if e.tag == "tr" else _line(e)
            if text:
                out.append(text)
                continue
        stack.extend(reversed(e))


def article_text(xml: str | None) -> str | None:
    """The blocks of the body, then of the groups of floats, a line each; null if it is no XML, or has no body or text."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    body = root.find(".//body")
    if body is None:
        return None
    out: list[str] = []
    for part in (body, *root.iterfind(".//floats-group")):
        _blocks(part, out)
    return "\n".join(out).strip() or None


#: Records whose texts are held in Python before they go to Arrow.
SLICE = 200


@F.arrow_udf(StringType())
def full_text(xml: pa.Array) -> pa.Array:
    """article_text of each record of a batch; they stay in Arrow but for one at a time, and the texts of SLICE records."""
    parts = [pa.array([article_text(x.as_py()) for x in xml[i : i + SLICE]], pa.string()) for i in range(0, len(xml), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
