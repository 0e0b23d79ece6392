"""Column functions over nulls, blanks and odd texts, and every query over empty tables."""

import pytest
from pyspark.sql import functions as F

from curalake import catalog
from curalake.functions import agents as A
from curalake.functions import evidence as E
from curalake.functions import omics as O
from curalake.functions import text as T
from curalake.functions import wording as W
from curalake.operators import reports, sync

ODD = [None, "", "  ", "x (y", "a) b)", "日本 (é)", "1e5", "-", ";;,", "a" * 5000]
TYPES = ["eQTL", "pQTL"]
TEXTS = {
    "parse": lambda c: E.to_wire(E.parse(c)),
    "balanced": E.balanced,
    "cell": lambda c: E.evidence_cell(c, TYPES),
    "coerced": lambda c: E.coerced(F.array(c), {"x": "X"}),
    "agent": A.agent_name,
    "stored": lambda c: O.label(O.entry(c)),
    "wire": lambda c: O.to_wire(c, c, F.array(F.struct(c.alias("text"), F.lit(True).alias("colocalized")))),
    "entries": O.cell_entries,
    "stem": E.trade_stem,
    "acronyms": lambda c: E.acronyms(c, TYPES),
    "uncovered": lambda c: E.uncovered(c, TYPES),
    "chain": E.chain,
    "group": E.trailing_group,
    "leading": lambda c: E.leading_type(c, TYPES),
    "registry": lambda c: W.registry(c, {"A": "b"}),
    "author": W.first_author,
    "short": lambda c: W.short_citation(c, c, F.lit(1)),
    "formatted": lambda c: W.formatted_citation(c, c, c, c, c),
    "doi": W.doi_link,
    "lines": W.citation_lines,
    "located": lambda c: W.located(c, c),
    "front": lambda c: W.without_back_matter(c, "x"),
    "issues": W.field_issues,
    "pmids": T.pmids,
    "targets": T.targets,
    "xref": lambda c: T.canonical_xref(c, c),
    "roman": T.roman_tokens,
    "rank": T.chromosome_rank,
    "union": lambda c: sync.offset_union(c, c, ";"),
}


@pytest.mark.parametrize("name", TEXTS)
def test_odd_texts(spark, name):
    df = spark.createDataFrame([(x,) for x in ODD], "c string")
    assert df.select(TEXTS[name](F.col("c")).alias("x")).count() == len(ODD)
    assert len(df.select(TEXTS[name](F.col("c")).cast("string").alias("x")).collect()) == len(ODD)


@pytest.mark.parametrize("cell,want", [("x (y", "x (y)"), ("a) b)", "a) b"), ("((a)", "((a))"), ("a", "a")])
def test_balanced(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(E.balanced(F.col("c")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("text,quote,at", [("One two  three", "two\nthree", 5), ("bone two", "one two", 0), ("a", "", 0)])
def test_located(spark, text, quote, at):
    assert spark.createDataFrame([(text, quote)], "t string, q string").select(W.located(F.col("t"), F.col("q")).alias("x")).first()["x"] == at


def test_clamped(spark):
    df = spark.createDataFrame([([1.0, 2.0, 30.0],), ([],), ([99.0, 99.0],)], "y array<double>")
    assert [r.x for r in df.select(sync.clamped(F.col("y"), 5.0, 0.0, 90.0).alias("x")).collect()] == [[1.0, 6.0, 30.0], [], [85.0, 90.0]]


def test_windows():
    assert reports.windows(30, 7) == [7, 14, 21, 28, 30] and reports.windows(0, 7) == [] and reports.windows(7, 7) == [7]


def test_empty_tables(spark, tmp_path):
    """Every query gives a result over tables without rows, but for the one whose precondition is that there are rows."""
    from tests.test_catalog import DATA, TABLES

    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in catalog.QUERIES.items():
        if name == "round_checks":
            with pytest.raises(Exception, match="round can't be read: no rows"):
                f(spark, str(tmp_path)).collect()
        else:
            f(spark, str(tmp_path)).collect()
