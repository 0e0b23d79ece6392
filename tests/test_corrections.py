"""Corrections of sheets: problems, merged cells, empty cells, disagreement, empty tables."""

from curalake.operators import corrections

CELLS = [("s", r, c, v) for r, a, b in [(1, "x", "m"), (2, None, "m"), (3, "x", None)] for c, v in [("a", a), ("b", b)]]
PRINTS = [("s", 1, "f1"), ("s", 2, "f2"), ("s", 3, "f3")]
MERGED = [("s", "b", 1, 1), ("s", "b", 2, 1)]


def run(spark, fixes, cells=CELLS):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out, verdicts = corrections.corrected(
        df(cells, "sheet string, row long, col string, value string"),
        df(PRINTS, "sheet string, row long, fingerprint string"),
        df(fixes, "line int, sheet string, col string, row long, fingerprint string, old string, new string"),
        df(MERGED, "sheet string, col string, row long, anchor long"),
    )
    changed = {(r.row, r.col): r.value for r in out.collect() if r.corrected}
    return changed, {r.line: (r.problem, r.moved_to, r.cells) for r in verdicts.collect()}


def test_sound(spark):
    fixes = [(1, "s", "a", 2, "f2", None, "new"), (2, "s", "b", 2, "f2", "m", None), (3, "s", "a", None, None, "x", "y"), (4, "s", "b", 3, "f3", None, None)]
    changed, verdicts = run(spark, fixes)
    assert changed == {(2, "a"): "new", (1, "b"): None, (2, "b"): None, (1, "a"): "y", (3, "a"): "y", (3, "b"): None}
    assert verdicts == {1: (None, None, 1), 2: (None, None, 2), 3: (None, None, 2), 4: (None, None, 0)}


def test_refused(spark):
    fixes = [
        (1, "s", "a", 1, "f2", "x", "y"), (2, "s", "a", 1, "zz", "x", "y"), (3, "s", "a", 9, "zz", "x", "y"), (4, "s", "a", 1, None, "x", "y"),
        (5, "s", "z", 1, "f1", "x", "y"), (6, "s", "a", 1, "f1", None, "y"), (7, "s", "a", 2, "f2", "x", "y"), (8, "s", "a", None, "f1", "x", "y"),
        (9, "s", "a", None, None, None, "y"), (10, "s", "a", None, None, "q", "y"), (11, None, "a", 1, "f1", "x", "y"),
    ]
    changed, verdicts = run(spark, fixes)
    assert not changed and all(v[2] == 0 for v in verdicts.values())
    problems = ["the row has moved", "the row has changed", "no such row", "a row needs its fingerprint", "no such column", "the cell is not empty", "the cell holds another value", "a fingerprint needs its row", "a column needs the value to replace", "no cell holds the value", "no such row"]
    assert [verdicts[i + 1][0] for i in range(11)] == problems and verdicts[1][1] == 2


def test_disagreement(spark):
    """A merged cell and a column that give one cell two values: neither is applied; equal answers are."""
    changed, verdicts = run(spark, [(1, "s", "b", 1, "f1", "m", "n"), (2, "s", "b", None, None, "m", None), (3, "s", "a", 1, "f1", "x", "y"), (4, "s", "a", None, None, "x", "y")])
    assert changed == {(1, "a"): "y", (3, "a"): "y"}
    assert verdicts == {1: ("fixes disagree", None, 0), 2: ("fixes disagree", None, 0), 3: (None, None, 1), 4: (None, None, 2)}


def test_empty(spark):
    assert run(spark, [], []) == ({}, {})


def test_column_fixes_share_cells(spark):
    """Column fixes of one value name the same cells: equal ones apply together, others are all refused, also with a fix of one of the cells."""
    cells = [("s", r, c, v) for r in (1, 2, 3) for c, v in (("a", "x"), ("b", "m"), ("c", "q"))]
    fixes = [(1, "s", "a", None, None, "x", "y"), (2, "s", "a", None, None, "x", "y"), (3, "s", "b", None, None, "m", "n"), (4, "s", "b", None, None, "m", None), (5, "s", "c", None, None, "q", "r"), (6, "s", "c", 3, "f3", "q", "t"), (7, "s", "a", None, None, "z", "y")]
    changed, verdicts = run(spark, fixes, cells)
    assert changed == {(r, "a"): "y" for r in (1, 2, 3)}
    torn = ("fixes disagree", None, 0)
    assert verdicts == {1: (None, None, 3), 2: (None, None, 3), 3: torn, 4: torn, 5: torn, 6: torn, 7: ("no cell holds the value", None, 0)}


def test_nothing_is_broadcast(spark, tmp_path):
    """Tables of few bytes on disk may have many rows: joins neither broadcast them nor pair each column fix with each cell."""
    spark.range(300).selectExpr("'s' AS sheet", "'a' AS col", "id AS row", "'x' AS value").write.parquet(f"{tmp_path}/cells")
    spark.range(300).selectExpr("CAST(id AS INT) AS line", "'s' AS sheet", "'a' AS col", "CAST(NULL AS LONG) AS row", "CAST(NULL AS STRING) AS fingerprint", "'x' AS old", "'y' AS new").write.parquet(f"{tmp_path}/fixes")
    cells, fixes = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("cells", "fixes"))
    prints = cells.selectExpr("sheet", "row", "'f' AS fingerprint")
    results = corrections.corrected(cells, prints, fixes, cells.selectExpr("sheet", "col", "row", "row AS anchor"))
    for df in results:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
        assert df.count() == 300
    assert {r.cells for r in results[1].collect()} == {300}
