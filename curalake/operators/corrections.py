"""Corrections of sheets: each is checked against the sheets as they were, then all are applied at once.

Tables: cells (sheet, row, col, value), an empty cell being null; prints (sheet, row, fingerprint), a row for each row of a
sheet; fixes (line, sheet, col, row, fingerprint, old, new), lines being unique; merged (sheet, col, row, anchor), the rows
that one merged cell fills. A fix with a row names that row by number and fingerprint, and the value that its cell holds; one
without changes every cell of the column that holds its old value. A fix of a merged cell is one of all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.sources.shared import stored

CELL = ["sheet", "col", "row"]
#: What fixes of a column have in common if they name the same cells.
RULE = ["sheet", "col", "old"]


def _placed(cells: DataFrame, prints: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes that name a row, with their problem, and where the row of their fingerprint is now."""
    here = prints.select("sheet", "row", F.col("fingerprint").alias("_here"))
    now = prints.where("fingerprint is not null").groupBy("sheet", "fingerprint").agg(F.min("row").alias("moved_to"))
    held = cells.select(*CELL, F.col("value").alias("_held"), F.lit(True).alias("_cell"))
    rows = fixes.where("row is not null")
    for other, on in ((here, ["sheet", "row"]), (now, ["sheet", "fingerprint"]), (held, CELL)):
        rows = rows.join(other.hint("merge"), on, "left")
    missing = F.when(F.col("moved_to").isNotNull(), "the row has moved").when(F.col("_here").isNull(), "no such row").otherwise("the row has changed")
    problem = (
        F.when(F.col("fingerprint").isNull(), "a row needs its fingerprint")
        .when(~F.col("_here").eqNullSafe(F.col("fingerprint")), missing)
        .when(F.col("_cell").isNull(), "no such column")
        .when(F.col("old").isNull() & F.col("_held").isNotNull(), "the cell is not empty")
        .when(~F.col("old").eqNullSafe(F.col("_held")), "the cell holds another value")
    )
    return rows.select("line", *CELL, "old", "new", problem.alias("problem"), F.when(problem == "the row has moved", F.col("moved_to")).alias("moved_to"))


def _wide(fixes: DataFrame) -> DataFrame:
    """Fixes of a whole column, with their problem."""
    problem = F.when(F.col("fingerprint").isNotNull(), "a fingerprint needs its row").when(F.col("old").isNull(), "a column needs the value to replace")
    return fixes.where("row is null").select("line", "sheet", "col", "old", "new", problem.alias("problem"))


def _own(placed: DataFrame, merged: DataFrame) -> DataFrame:
    """Each cell that a sound fix of a row names: line, sheet, col, row, new, changed."""
    spans = merged.select("sheet", "col", "anchor", F.col("row").alias("_row"))
    own = placed.where("problem is null").join(merged.select(*CELL, "anchor").hint("merge"), CELL, "left").join(spans.hint("merge"), ["sheet", "col", "anchor"], "left")
    return own.select("line", "sheet", "col", F.coalesce("_row", "row").alias("row"), "new", (~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def _rules(wide: DataFrame) -> DataFrame:
    """Sound fixes of a column by the value that they replace: one row however many they are, as they name the same cells."""
    return wide.where("problem is null").groupBy(*RULE).agg(F.count_distinct(F.struct("new")).alias("_kinds"), F.first("new").alias("_rule"))


def _seen(cells: DataFrame, own: DataFrame, rules: DataFrame) -> DataFrame:
    """Each cell that sound fixes name, with the value of its rule (null without one), and whether they disagree on it."""
    answers = own.groupBy(*CELL).agg(F.count_distinct(F.struct("new")).alias("_n"), F.first("new").alias("_own"))
    ruled = cells.select(*CELL, F.col("value").alias("old")).join(rules.hint("merge"), RULE)
    both = F.col("_n").isNotNull() & F.col("_kinds").isNotNull() & ~F.col("_own").eqNullSafe(F.col("_rule"))
    torn = F.coalesce(F.col("_n") > 1, F.lit(False)) | F.coalesce(F.col("_kinds") > 1, F.lit(False)) | both
    return ruled.join(answers.hint("merge"), CELL, "full").select(*CELL, "old", torn.alias("_torn"))


def corrected(cells: DataFrame, prints: DataFrame, fixes: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells with `corrected`, and a verdict on each fix: line, problem (null if it was applied), moved_to, cells (changed ones).

    Fixes that give one cell different values are all refused; an empty value differs from any other. A fix that keeps its
    value is sound and changes no cell. Refused fixes change nothing.
    """
    placed, wide = stored(_placed(cells, prints, fixes), "placed"), _wide(fixes)
    own, rules = _own(placed, merged), _rules(wide)
    seen = stored(_seen(cells, own, rules), "seen")
    torn = own.join(seen.where("_torn").select(*CELL).hint("merge"), CELL).select("line").distinct().withColumn("_torn", F.lit(True))
    counts = own.groupBy("line").agg(F.count_if("changed").alias("_cells"))
    fates = rules.join(seen.where("old is not null").groupBy(*RULE).agg(F.bool_or("_torn").alias("_torn"), F.count("*").alias("_found")).hint("merge"), RULE)
    of_rows = placed.join(counts.hint("merge"), "line", "left").join(torn.hint("merge"), "line", "left").select("line", "problem", "moved_to", "_torn", "_cells")
    changed = F.when(F.col("new").eqNullSafe(F.col("old")), F.col("_found") * 0).otherwise(F.col("_found"))
    of_columns = wide.join(fates.hint("merge"), RULE, "left").select("line", "problem", "_torn", changed.alias("_cells"))
    sound = F.when(F.col("_torn"), "fixes disagree").when(F.col("_cells").isNull(), "no cell holds the value")
    problem = F.coalesce("problem", sound)
    both = of_rows.unionByName(of_columns, allowMissingColumns=True)
    verdicts = both.select("line", problem.alias("problem"), "moved_to", F.when(problem.isNull(), F.col("_cells")).otherwise(0).alias("cells"))
    plan = own.join(torn.hint("merge"), "line", "left_anti").groupBy(*CELL).agg(F.first("new").alias("_new"), F.lit(True).alias("_hit"))
    kept = fates.where("not _torn").select("sheet", "col", F.col("old").alias("value"), "_rule", F.lit(True).alias("_ruled"))
    hit, ruled = F.coalesce("_hit", F.lit(False)), F.coalesce("_ruled", F.lit(False))
    value = F.when(hit, F.col("_new")).when(ruled, F.col("_rule")).otherwise(F.col("value"))
    out = cells.join(kept.hint("merge"), ["sheet", "col", "value"], "left").join(plan.hint("merge"), CELL, "left")
    return out.select(*CELL, value.alias("value"), (hit | ruled).alias("corrected")), verdicts
