"""Orders of first appearance and held keys: ties, nulls, empty tables."""

from pyspark.sql import functions as F

from curalake.operators import first_seen


def test_collapsed(spark):
    rows = [(1, "b", 5, "x"), (2, "a", 7, "y"), (3, "b", 4, "z"), (4, "a", 7, "w"), (5, None, 1, "n"), (6, None, 0, "m")]
    df = spark.createDataFrame(rows, "pos int, k string, r int, first_name string")
    got = first_seen.collapsed(df, ["k"], [F.col("r")], "pos").orderBy("first_seen").collect()
    assert [(r.k, r.pos, r.first_seen) for r in got] == [("b", 3, 1), ("a", 2, 2), (None, 6, 5)]
    assert first_seen.collapsed(df.limit(0), ["k"], [F.col("r")], "pos").count() == 0


def test_pairs(spark):
    rows = [(1, "g", "O:2", "x"), (2, "g", "O:1", "x"), (3, "g", "O:2", "x"), (4, "g", "P:3", "x"), (5, "g", None, "x"), (6, "h", "O:", None)]
    df = spark.createDataFrame(rows, "pos int, k string, c string, o string")
    got = {r.k: [tuple(p) for p in r.pairs] for r in first_seen.pairs_in_order(df, "k", "c", "o", "pos", "O:").collect()}
    assert got == {"g": [("2", "x"), ("1", "x")], "h": [("", None)]}


def test_held(spark):
    rows = spark.createDataFrame([(1, "ab1"), (2, " AB2 "), (3, "c"), (4, None), (5, "")], "i int, s string")
    aliases = spark.createDataFrame([("AB1", "AB"), ("ab2", "ab")], "alias string, name string")
    holds = spark.createDataFrame([("Ab",), (None,), (" ",)], "s string")
    assert {r.i: r.held for r in first_seen.held(rows, holds, "s", aliases).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_suspects(spark):
    df = spark.createDataFrame([(1, "C9orf72"), (2, "c9"), (3, None), (4, ""), (5, "HLA-A"), (6, "C9orf")], "i int, s string")
    assert sorted(r.row for r in first_seen.symbol_suspects(df, "i", {"s": F.col("s")}).collect()) == [2, 4, 6]
