"""Nulls, sentinels, ties, repeats and empty inputs."""

import pytest
from pyspark.sql import functions as F

from curalake.functions import sentinel as S
from curalake.functions import text as T
from curalake.operators import diff, interval, lookup, merge, predicates, quality, review, rollup, windows
from curalake.sources import files


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def one(spark, column, **row):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,want", [(None, "(unknown)"), ("", "(unknown)"), ("  ", "(unknown)"), ("n/a", "(unknown)"), ("NA ", "(unknown)"), ("-", "-"), (" x ", " x ")])
def test_fill(spark, value, want):
    assert one(spark, S.fill(F.col("c"), S.UNKNOWN), c=value) == want


@pytest.mark.parametrize("value,want", [("II/III", True), ("Ib", False), ("Clinical Trial Phase II", True), ("(unknown)", False), (None, False), ("XII", False)])
def test_phase(spark, value, want):
    assert one(spark, predicates.matches_phase(F.col("c"), ["II"]), c=value) is want


@pytest.mark.parametrize("value,want", [("Industry (X)", True), ("industry", True), ("Industry-Sponsored", True), ("industrywide", False), (None, False)])
def test_prefix(spark, value, want):
    assert one(spark, predicates.matches_prefix(F.col("c"), ["Industry"]), c=value) is want


def test_selection_activity():
    assert predicates.active([]) is None
    assert predicates.active(["x", "all"]) is None
    assert predicates.active(["Yes", "No"], "binary") is None
    assert predicates.active([" Yes "], "binary") == ["yes"]


@pytest.mark.parametrize("value,want", [("Xq22.1", 22), ("10q24.33-q25.1", 9), ("23q11", 24), ("7q31.1x", 24), ("7", 6), ("yq1", 23), ("99999999999", 24)])
def test_chromosome(spark, value, want):
    assert one(spark, T.chromosome_rank(F.col("c")), c=value) == want


@pytest.mark.parametrize("value,want", [("123, 4567", ["123", "4567"]), ("in 1999 we", []), ("PMID:12; 12345678", ["12", "12345678"]), ("2,606,365,833", []), (None, []), ("10.1000/12345678", [])])
def test_pmids(spark, value, want):
    assert one(spark, T.pmids(F.col("c")), c=value) == want


@pytest.mark.parametrize("value,want", [("2/2031", 24373), ("02/2031 ", 24373), ("13/2031", None), ("(unknown)", None)])
def test_month_year(spark, value, want):
    assert one(spark, T.month_year(F.col("c")), c=value) == want


@pytest.mark.parametrize("path,want", [("/v2/10.1093/brain/awx", "/v2/:id"), ("/api/v2/studies/NCT01", "/api/v2/studies/:id"), ("", "/"), ("/a//b", "/a/b")])
def test_path(spark, path, want):
    assert one(spark, T.path_template(F.col("c")), c=path) == want


@pytest.mark.parametrize("source,ref,want", [("mondo", "MONDO:14768", "MONDO:0014768"), ("ORPHA", "12", "Orphanet:12"), ("omim", "12", None), ("none", "1", None), (None, "1", None)])
def test_xref(spark, source, ref, want):
    assert one(spark, T.canonical_xref(F.col("a"), F.col("b")), a=source, b=ref) == want


def test_top_level_split(spark):
    assert one(spark, T.split_top_level(F.col("c")), c="a (b, (c, d)), e)x, f") == ["a (b, (c, d))", "e)x", "f"]


def test_completion_join_keeps_order_and_repeats(spark):
    requested = spark.createDataFrame([(0, "b"), (1, "z"), (2, "b")], "pos int, k string")
    rows = spark.createDataFrame([("b", None), ("c", "2")], "k string, v string")
    out = lookup.complete(requested, rows, "k", {"v": F.lit("?")}).orderBy("pos")
    assert [tuple(r) for r in out.collect()] == [(0, "b", None, True), (1, "z", "?", False), (2, "b", None, True)]


def test_upsert_and_append_are_idempotent(spark):
    t = spark.createDataFrame([(1, " ", None), (2, "x", True)], "k int, a string, b boolean")
    s = spark.createDataFrame([(1, "n", True), (3, "m", None)], "k int, a string, b boolean")
    rules = {"a": merge.fill_blank, "b": merge.either}
    once = merge.upsert(t, s, "k", rules)
    assert values(once, "k", "a", "b", "change") == [(1, "n", True, "update"), (2, "x", True, "keep"), (3, "m", None, "insert")]
    assert values(merge.upsert(once, s, "k", rules), "k", "a") == values(once, "k", "a")
    have = spark.createDataFrame([(1, 1, "a")], "p int, ordinal long, value string")
    more = spark.createDataFrame([(1, 5, "a"), (1, 6, "c"), (1, 7, "c"), (2, 1, "z")], "p int, pos int, value string")
    grown = merge.append_ordered(have, more, "p")
    assert values(grown, "p", "ordinal", "value") == [(1, 1, "a"), (1, 2, "c"), (2, 1, "z")]
    assert merge.append_ordered(grown.select("p", "ordinal", "value"), more, "p").where("added").count() == 0


def test_ties(spark):
    df = spark.createDataFrame([("g", "b", 0.9, 2), ("g", "a", 0.9, 1), ("g", "c", 0.5, 0)], "k string, v string, s double, p int")
    assert values(rollup.arg_max(df, ["k"], "v", "s", "p"), "v") == [("a",)]
    assert values(rollup.mode(df, ["k"], "v", "m"), "m") == [("a",)]
    split = spark.createDataFrame([("g", 1, 2), ("g", 2, 2), ("g", 3, 2), ("g", 4, 0)], "k string, p int, s int")
    assert values(windows.best_split(split, ["k"], ["p"], "s"), "cut", "larger") == [(2, 4)]


def test_diff_of_nulls_and_empty(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (3, "y")], "k int, v string")
    assert values(diff.diff(a, b, "k", ["v"]), "k", "kind", "fields") == [(2, "changed", "v"), (3, "added", "")]
    assert diff.diff(a.limit(0), b.limit(0), "k", ["v"]).count() == 0


def test_corrections_conflict(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    bad = spark.createDataFrame([(1, "v", "a", "b"), (1, "v", "a", "c")], "k int, name string, old string, new string")
    with pytest.raises(Exception, match="two corrections"):
        quality.apply_corrections(df, "k", ["v"], bad).collect()


@pytest.mark.parametrize("votes,want", [((2, 0, 0, 1), "accepted"), ((1, 1, 0, 1), "open"), ((0, 2, 0, 1), "rejected"), ((0, 0, 3, 0), "undecided"), ((1, 0, 2, 0), "accepted")])
def test_standing(spark, votes, want):
    df = spark.createDataFrame([votes], "a int, r int, b int, o int")
    assert df.select(review.standing(*map(F.col, "arbo"))).first()[0] == want


def test_clamp(spark):
    df = spark.createDataFrame([([1.0, 1.0, 9.5],)], "x array<double>")
    assert df.select(windows.clamp(F.col("x"), 1.0, 0.0, 10.0)).first()[0] == [1.0, 2.0, 9.5]


def test_as_of_before_first_start(spark):
    rows = spark.createDataFrame([(1, 5), (1, 10), (2, 7)], "k int, t int")
    starts = spark.createDataFrame([(1, 6, "a"), (1, 10, "b")], "k int, s int, v string")
    assert values(interval.as_of(rows, starts, ["k"], "t", "s", "v"), "k", "t", "v") == [(1, 10, "b"), (1, 5, None), (2, 7, None)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a</b>"), (2, None)], "k int, v string")
    files.append_checkpoint(df, f"{tmp_path}/c", "f")
    rows = next((tmp_path / "c" / "rows").iterdir())
    with open(next(p for p in rows.iterdir() if p.name.startswith("part")), "a") as f:
        f.write('{"k": 3, "v"')
    for p in rows.glob(".*.crc"):
        p.unlink()
    spark.createDataFrame([('{"k": 9, "v": "cut off"}',)], "value string").write.text(f"{tmp_path}/c/rows/batch=torn")  # without a header
    assert values(files.read_checkpoint(spark, f"{tmp_path}/c", df.schema, "f"), "k", "v") == [(1, "a</b>"), (2, None)]
    assert files.read_checkpoint(spark, f"{tmp_path}/c", df.schema, "g").count() == 0
    files.write_rows(df, f"{tmp_path}/j")
    assert '<\\/b>' in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    (tmp_path / "x.csv").write_text("﻿k,v\n1,a  b\n", encoding="utf-8")
    assert values(files.read_csv(spark, f"{tmp_path}/x.csv", df.schema), "k", "v") == [(1, "a b")]


@pytest.mark.parametrize("value,want", [(" x \t", "x"), ("﻿x　", "x"), ("   ", ""), (None, None)])
def test_strip(spark, value, want):
    assert one(spark, S.strip(F.col("c")), c=value) == want


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("c")), c="a  b\r\n  c \n") == "a b\nc"


def test_new_ids_over_many_partitions(spark):
    """Adaptive execution coalesces narrow and wide rows differently; ids must still be without gaps and repeats."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(before, ("40", "64k")):
            spark.conf.set(k, v)
        existing = spark.createDataFrame([(7,)], "id long")
        incoming = spark.range(0, 20000, 1, 8).select(((F.col("id") * 7919) % 20000).alias("k"), F.concat(*(F.sha2((F.col("id") + n).cast("string"), 256) for n in range(8))).alias("wide"))
        got = values(merge.new_ids(existing, incoming, "id", ["k"]).selectExpr("k", "id - k AS ahead", "wide"), "k", "ahead")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 20000 and {a for _, a in got} == {8}


def test_page_texts(spark):
    """The text of a page is what a parser finds outside scripts and styles."""
    from html.parser import HTMLParser

    from curalake import catalog
    from tests.test_catalog import DATA

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], False

        def handle_starttag(self, tag, attrs):
            self.skip = tag in ("script", "style") or self.skip
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.skip = self.skip and tag not in ("script", "style")
            self.out.append(" ")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_data(self, data):
            self.out.append("" if self.skip else data)

    html = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in catalog.QUERIES["page_texts"](spark, DATA).collect():
        own = Texts()
        own.feed(html[r.page_id])
        own.close()
        assert r.plain.split() == "".join(own.out).split()
        assert (r.html_chars, r.text_chars) == (len(html[r.page_id]), len(r.plain))


def test_numbered(spark):
    """Numbers follow the order over many partitions, and start after the last one."""
    from curalake.operators import ordering

    df = spark.createDataFrame([((n * 7919) % 1009, n) for n in range(1009)], "a long, b long").repartition(7)
    got = {r.b: r.n for r in ordering.numbered(df, ["a"], "n", 100).collect()}
    assert got == {n: (n * 7919) % 1009 + 101 for n in range(1009)}
    assert ordering.numbered(df.limit(0), ["a"], "n").count() == 0


def test_patches_that_disagree(spark):
    from curalake.operators import sync

    cells = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "row int, col string, value string")
    fix = spark.createDataFrame([(1, "a", "x", "z"), (1, "a", "x", "w")], "row int, col string, old string, new string")
    with pytest.raises(Exception, match="corrections disagree"):
        sync.patched(cells, fix, ["row", "col"]).collect()


def test_settings():
    from curalake.operators import studies

    with pytest.raises(ValueError, match="version 1 instead of 2; floor is missing"):
        studies.checked_settings({"version": 1}, 2, ["floor"])
