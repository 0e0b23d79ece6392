"""Null keys, empty cells and odd texts in operators that match rows."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curalake.functions import text as T
from curalake.operators import diff, merge, predicates, sync


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_upsert_with_null_keys(spark):
    t = spark.createDataFrame([(None, "a"), (1, "b")], "k int, a string")
    s = spark.createDataFrame([(1, "c"), (2, "d")], "k int, a string")
    rules = {"a": merge.newest}
    assert rows(merge.upsert(t, s, "k", rules), "k", "a", "change") == [(1, "c", "update"), (2, "d", "insert"), (None, "a", "keep")]
    own = spark.createDataFrame([(None, "z")], "k int, a string")
    assert rows(merge.upsert(t, own, "k", rules), "k", "a", "change") == [(1, "b", "keep"), (None, "z", "update")]
    assert rows(merge.upsert(t.limit(0), own, "k", rules), "k", "a", "change") == [(None, "z", "insert")]


def test_diff_with_null_keys(spark):
    old, new = (spark.createDataFrame(x, "k int, a string") for x in ([(None, "a"), (1, None)], [(None, "b"), (2, "c")]))
    assert rows(diff.diff(old, new, "k", ["a"]), "k", "kind", "fields") == [(1, "removed", ""), (2, "added", ""), (None, "changed", "a")]


def test_empty_cells_are_corrected(spark):
    cells = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (None, "a", "y"), (3, "a", "x")], "row int, col string, value string")
    fix = spark.createDataFrame([(1, "a", "x", None), (2, "a", None, "n"), (None, "a", "y", "w"), (3, "a", None, "no")], "row int, col string, old string, new string")
    assert rows(sync.patched(cells, fix, ["row", "col"]), "row", "value", "corrected") == [(1, None, True), (2, "n", True), (3, "x", False), (None, "w", True)]
    both = fix.unionByName(spark.createDataFrame([(1, "a", "x", "other")], fix.schema))
    with pytest.raises(Exception, match="corrections disagree: 1 a"):
        sync.patched(cells, both, ["row", "col"]).collect()


def test_digests_of_different_rows_differ(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("1:a", ""), ("", "1:a"), (None, "-"), ("-", None), (None, None)], "a string, b string")
    assert df.select(diff.digest(F.col("a"), F.col("b")).alias("d")).distinct().count() == 7
    assert df.fillna("").select(T.fingerprint(F.col("a"), F.col("b")).alias("d")).distinct().count() == 7


def test_a_gate_that_is_null_rejects(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False)], "k int, ok boolean")
    kept, rejected = predicates.gates(df, {"ok": F.col("ok")})
    assert rows(kept, "k") == [(1,)] and rows(rejected, "gate", "rejected") == [("ok", 2)]


def targets(cell):
    """The rule in plain Python."""
    out, cell = {}, re.sub(r"\bN/A\b", "", cell or "", flags=re.I)
    for part in re.split("[,;]", cell):
        stem = ""
        for x in part.split("/"):
            x = x.strip()
            if re.fullmatch("[0-9]+", x) and stem:
                x = stem + x
            else:
                found = re.search("([A-Z][A-Z0-9]*[A-Z0-9])[0-9]$", x)
                stem = found.group(1) if found else ""
            x = x.rsplit(": ", 1)[-1].strip()
            if x.upper() not in T.NO_TARGET:
                out.setdefault(x)
    return list(out)


@pytest.mark.parametrize(("cell", "want"), [("COL4A1, 2", ["COL4A1", "2"]), ("COL4A1/2", ["COL4A1", "COL4A2"]), ("A1/2", ["A1", "2"]), ("N, A; APP", ["N", "A", "APP"]), ("N/A", []), ("N/A, APP", ["APP"]), (None, []), ("x disease: APP/APOE", ["APP", "APOE"])])
def test_targets(spark, cell, want):
    assert targets(cell) == want
    assert spark.createDataFrame([(cell,)], "c string").select(T.targets(F.col("c")).alias("t")).first()["t"] == want


def test_targets_of_odd_texts(spark):
    found = []

    @given(st.lists(st.text(alphabet="AB12 /,;:nN-x", max_size=14), min_size=1, max_size=200))
    @settings(max_examples=8, deadline=None)
    def check(cells):
        got = [r["t"] for r in spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string").orderBy("k").select(T.targets(F.col("c")).alias("t")).collect()]
        assert got == [targets(c) for c in cells]
        found.extend(got)

    check()
    assert found


def test_folded_texts(spark):
    """Any letters, against Python's own tables."""

    def fold(text):
        bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", " ", bare.lower())

    texts = ["Łódź Žižka", "Behçet's  Disease", "ＡＢＣ ﬁne ①", "Ǆ İ ß Σς", "", " a ", "日本 é", "Å\u030a\u0301x"] + [chr(c) + "a" for c in range(0xC0, 0x250)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r["f"] for r in df.select(T.fold_accents(F.col("t")).alias("f")).collect()] == list(map(fold, texts))
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(T.fold_accents(F.col("t")).alias("f")).first()["f"] is None
