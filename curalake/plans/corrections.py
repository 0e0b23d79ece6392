"""Corrections of a sheet that is made of the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.operators import corrections
from curalake.plans.registry import query, read

#: The columns of a sheet by part; `type` is a merged cell of ten rows.
_COLUMNS = {"name": "p_name", "brand": "CASE WHEN p_partkey % 5 > 0 THEN p_brand END", "size": "CAST(p_size AS STRING)", "type": "concat('T', CAST(floor(p_partkey / 10) AS BIGINT))"}
_PRINT = "md5(concat(p_partkey, '/', p_name))"
_KIND = "CAST(floor(p_partkey / 7) AS BIGINT) % 8"
#: A fix from each seventh part, of eight kinds.
_FIX = {
    "line": "p_partkey",
    "sheet": "'part'",
    "col": f"CASE {_KIND} WHEN 3 THEN 'brand' WHEN 4 THEN 'type' WHEN 5 THEN 'type' WHEN 7 THEN 'size' ELSE 'name' END",
    "row": f"CASE {_KIND} WHEN 1 THEN p_partkey + 1 WHEN 6 THEN -1 - p_partkey WHEN 7 THEN NULL ELSE p_partkey END",
    "fingerprint": f"CASE {_KIND} WHEN 2 THEN 'gone' WHEN 6 THEN 'gone' WHEN 7 THEN CASE WHEN p_partkey % 3 = 1 THEN 'x' END ELSE {_PRINT} END",
    "old": f"CASE {_KIND} WHEN 3 THEN NULL WHEN 4 THEN {_COLUMNS['type']} WHEN 5 THEN {_COLUMNS['type']} WHEN 7 THEN CASE WHEN p_partkey % 3 = 0 THEN {_COLUMNS['size']} ELSE 'none' END ELSE p_name END",
    "new": f"CASE {_KIND} WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'fixed' END WHEN 3 THEN 'B' WHEN 4 THEN NULL WHEN 5 THEN 'U' WHEN 7 THEN concat({_COLUMNS['size']}, '0') ELSE 'new' END",
}
_CELLS = " UNION ALL ".join(f"SELECT 'part' AS sheet, '{c}' AS col, p_partkey AS row, {e} AS value FROM part" for c, e in _COLUMNS.items())
_HITS = f"""cells AS MATERIALIZED ({_CELLS}), fixes AS MATERIALIZED (SELECT {', '.join(f'{e} AS {c}' for c, e in _FIX.items())}, {_KIND} AS kind FROM part WHERE p_partkey % 7 = 0),
    keys AS (SELECT max(p_partkey) AS last FROM part),
    said AS (SELECT *, CASE kind WHEN 1 THEN 'the row has moved' WHEN 2 THEN 'the row has changed' WHEN 6 THEN 'no such row' WHEN 3 THEN CASE WHEN line % 5 > 0 THEN 'the cell is not empty' END
        WHEN 7 THEN CASE WHEN fingerprint IS NOT NULL THEN 'a fingerprint needs its row' WHEN NOT EXISTS (FROM cells c WHERE c.col = 'size' AND c.value = fixes.old) THEN 'no cell holds the value' END END AS fault FROM fixes),
    hits AS (SELECT line, c.col, c.row, new, new IS DISTINCT FROM value AS changed FROM said f JOIN cells c ON c.col = f.col AND fault IS NULL AND CASE kind WHEN 7 THEN c.value = f.old WHEN 4 THEN c.value = f.old WHEN 5 THEN c.value = f.old ELSE c.row = f.row END),
    torn AS (SELECT DISTINCT line FROM hits JOIN (SELECT col, row FROM hits GROUP BY col, row HAVING count(DISTINCT coalesce(new, '<null>')) > 1) USING (col, row))"""


def _corrected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    row, sheet = F.col("p_partkey").alias("row"), F.lit("part").alias("sheet")
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.expr(e).alias("value")) for c, e in _COLUMNS.items()))
    cells = part.select(sheet, row, F.inline(pairs))
    prints = part.select(sheet, row, F.expr(_PRINT).alias("fingerprint"))
    fixes = part.where("p_partkey % 7 = 0").select(*(F.expr(e).alias(c) for c, e in _FIX.items()))
    merged = part.select(sheet, F.lit("type").alias("col"), row, F.floor(F.col("p_partkey") / 10).alias("anchor"))
    return corrections.corrected(cells, prints, fixes, merged)


@query(f"""WITH {_HITS} SELECT line, coalesce(fault, CASE WHEN line IN (FROM torn) THEN 'fixes disagree' END) AS problem, CASE WHEN kind = 1 THEN line END AS moved_to,
    CASE WHEN fault IS NULL AND line NOT IN (FROM torn) THEN (SELECT count(*) FROM hits h WHERE h.line = said.line AND changed) ELSE 0 END AS cells FROM said""")
def correction_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each fix: applied, moved, changed, refused; and the cells it changes."""
    return _corrected(spark, sf_dir)[1]


@query(f"""WITH {_HITS}, plan AS (SELECT DISTINCT col, row, new, true AS hit FROM hits WHERE line NOT IN (FROM torn))
    SELECT sheet, c.col, c.row, CASE WHEN hit THEN new ELSE value END AS value, coalesce(hit, false) AS corrected FROM cells c LEFT JOIN plan p ON p.col = c.col AND p.row = c.row""")
def corrected_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet after all sound fixes, by row, by merged cell and by column."""
    return _corrected(spark, sf_dir)[0]
