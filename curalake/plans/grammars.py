"""Stored evidence entries, names of agents and citations by their grammar, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import agents as A
from curalake.functions import omics as O
from curalake.functions import wording as W
from curalake.plans.registry import query, read

#: Letters of the turns that become signs, so that whole texts are entries with any nesting.
_LETTERS, _SIGNS = "aeilo", "(:,)*"
_TURNS = f"""t AS MATERIALIZED (SELECT row_number() OVER () AS k, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    d AS (SELECT *, trim(translate(regexp_replace(text, '\\s+', ' ', 'g'), '{_LETTERS}', '{_SIGNS}')) AS d FROM t)"""


def _chars(of: str) -> str:
    """Characters of texts (k, x) with their place and depth: a walk over the parentheses that never falls below zero."""
    walk = "SELECT k, unnest(string_split(x, '')) AS ch, generate_subscripts(string_split(x, ''), 1) AS i FROM " + of
    total = f"SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS s FROM ({walk})"
    return f"SELECT k, ch, i, s, s - least(0, min(s) OVER (PARTITION BY k ORDER BY i)) AS depth FROM ({total})"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    return read(spark, sf_dir, "conversations").withColumn("detail", F.trim(F.translate(text, _LETTERS, _SIGNS)))


@query(f"""WITH {_TURNS}, c AS ({_chars("(SELECT k, d AS x FROM d)")}),
    colon AS (SELECT k, min(i) AS place FROM c WHERE ch = ':' AND depth = 0 GROUP BY k),
    parts AS (SELECT c.k, i, ch, ch = ',' AND depth = 0 AS cut, count(*) FILTER (ch = ',' AND depth = 0) OVER (PARTITION BY c.k ORDER BY i) AS part FROM c LEFT JOIN colon USING (k) WHERE i > coalesce(place, 0)),
    items AS (SELECT k, part, trim(replace(string_agg(ch, '' ORDER BY i), '*', '')) AS item, bool_or(ch = '*') AS star FROM parts WHERE NOT cut GROUP BY k, part),
    lists AS (SELECT k, string_agg(item, '|' ORDER BY part) AS items, string_agg(item, ', ' ORDER BY part) AS listed, string_agg(item, '|' ORDER BY part) FILTER (star) AS stars FROM items WHERE item <> '' GROUP BY k),
    e AS (SELECT d.*, nullif(trim(replace(left(d, place - 1), '*', '')), '') AS biomarker, items, listed, stars FROM d LEFT JOIN colon USING (k) LEFT JOIN lists USING (k))
    SELECT conv_id, turn, role AS type, biomarker, coalesce(items, '') AS items, coalesce(replace(stars, '[?]', '?'), '') AS colocalized,
    replace(role || CASE WHEN biomarker IS NULL AND listed IS NULL THEN '' ELSE ' (' || concat_ws(': ', biomarker, listed) || ')' END, '[?]', '?') AS label FROM e""")
def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read, the marked items, and the printed form; each turn of the conversations is an entry."""
    e = F.col("e")
    rows = _entries(spark, sf_dir).select("conv_id", "turn", O.entry(F.concat("role", F.lit("; "), "detail")).alias("e"))
    items = F.array_join(F.transform(e["items"], lambda x: x["text"]), "|")
    return rows.select("conv_id", "turn", "e.type", "e.biomarker", items.alias("items"), F.array_join(O.colocalized(e), "|").alias("colocalized"), O.label(e).alias("label"))


@query(f"""WITH {_TURNS}, raw AS (SELECT 2 * k AS k, replace(d, '*', '') AS x FROM d UNION ALL SELECT 2 * k + 1, replace(reverse(d), '*', '') FROM d),
    odd AS (SELECT k, min(s) < 0 OR arg_max(s, i) <> 0 AS odd FROM ({_chars("raw")}) GROUP BY k),
    safe AS (SELECT k, trim(regexp_replace(replace(CASE WHEN odd THEN translate(x, '()', '') ELSE x END, ';', ','), '\\s+', ' ', 'g')) AS x FROM raw JOIN odd USING (k)),
    c AS (SELECT *, CASE k % 2 WHEN 0 THEN ':' ELSE ',' END AS separator FROM ({_chars("safe")})),
    parts AS (SELECT *, count(*) FILTER (ch = separator AND depth = 0) OVER (PARTITION BY k ORDER BY i) AS part FROM c),
    joined AS (SELECT k, part, trim(coalesce(string_agg(ch, '' ORDER BY i) FILTER (NOT (ch = separator AND depth = 0)), '')) AS x, bool_or(k % 2 = 1 AND ch = ':' AND depth = 0) AS colon FROM parts GROUP BY k, part),
    sides AS (SELECT k, bool_or(colon) AS colon, string_agg(x || CASE WHEN k % 2 = 1 AND turn % 2 = 0 THEN '*' ELSE '' END, ', ' ORDER BY part) FILTER (x <> '') AS x FROM joined JOIN (SELECT k AS own, turn FROM t) ON own = k // 2 GROUP BY k)
    SELECT conv_id, turn, role || CASE WHEN b.x IS NULL AND i.x IS NULL THEN '' WHEN b.x IS NULL AND i.colon THEN ';: ' || i.x ELSE ';' || concat_ws(': ', b.x, i.x) END AS wire
    FROM t LEFT JOIN sides b ON b.k = 2 * t.k LEFT JOIN sides i ON i.k = 2 * t.k + 1""")
def written_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written from a biomarker and items with any signs in them: unmatched parentheses go, colons and commas are kept apart."""
    item = F.struct(F.reverse("detail").alias("text"), (F.col("turn") % 2 == 0).alias("colocalized"))
    return _entries(spark, sf_dir).select("conv_id", "turn", O.to_wire(F.col("role"), F.col("detail"), F.array(item)).alias("wire"))


@query(f"""WITH {_TURNS} SELECT conv_id, turn, r || '|' || r || ';x|' || coalesce(nullif(replace(d, ';', ','), '') || '|', '') || '[' || coalesce(turn, 0) AS entries FROM (SELECT *, coalesce(role, '?') AS r FROM d)""")
def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of prose and JSON arrays: an array keeps its semicolons, what only looks like one is a text, repeated entries count once."""
    own, role = F.replace("detail", F.lit(";"), F.lit(",")), F.coalesce("role", F.lit("?"))
    array = O.stored(F.filter(F.array(F.concat(role, F.lit(";x")), own), lambda x: x != ""))
    cell = F.concat(role, F.lit("; "), array, F.lit(" ;; ["), F.coalesce("turn", F.lit(0)).cast("string"), F.lit(";"), role)
    return _entries(spark, sf_dir).select("conv_id", "turn", F.array_join(O.cell_entries(cell), "|").alias("entries"))


_RAW = """CASE p_partkey % 12 WHEN 0 THEN p_name || ' ' || p_size || '.5 Mg/kg Oral Tablet' WHEN 1 THEN 'high dose group of ' || p_name || ' soft capsules' WHEN 2 THEN p_name || ' (ABC-' || p_size || ')'
    WHEN 3 THEN p_name || ' ' || p_size || ' mg/' || lower(p_type) || ' 20 mg' WHEN 4 THEN p_name || ' and self-generated memory training' WHEN 5 THEN 'Usual ' || lower(p_type) || ' and ISMN XL + ' || p_name WHEN 6 THEN 'the control group'
    WHEN 7 THEN ' +' || p_size || ' mg ' WHEN 8 THEN 'Donepezil Hydrochloride ' || p_size || '%' WHEN 9 THEN 'zydena (Udenafil) plus regular care' WHEN 10 THEN p_brand || ' treatment' ELSE 'NACA plus ' || p_name || ' (delta-X) for injection' END"""


@query("""WITH n AS (SELECT *, upper(left(p_name, 1)) || substr(p_name, 2) AS n FROM part)
    SELECT p_partkey, CASE p_partkey % 12 WHEN 3 THEN n || ' and ' || lower(p_type) WHEN 5 THEN 'Usual ' || lower(p_type) || ', isosorbide mononitrate and ' || p_name WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN 'Donepezil'
    WHEN 9 THEN 'Udenafil' WHEN 10 THEN p_brand WHEN 11 THEN 'NACA and ' || p_name || ' (delta-X)' ELSE n END AS agent FROM n""")
def agent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents without doses, forms, arms, acronyms and what is done beside them; combinations; listed salts and brands."""
    return read(spark, sf_dir, "part").select("p_partkey", A.agent_name(F.expr(_RAW)).alias("agent"))


_AUTHORS = "CASE c_custkey % 5 WHEN 0 THEN 'van Abel K.J.' WHEN 1 THEN 'Abel K, Dorn LM' WHEN 2 THEN 'TEAM Consortium, Dorn LM, Eck P' WHEN 3 THEN 'Abel J-P, Dorn LM, Eck P, Fry O' ELSE '' END"
_DATE = "CASE c_custkey % 3 WHEN 0 THEN 'Nov ' || (1990 + c_nationkey) WHEN 1 THEN '12345' ELSE '' END"
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TITLE = "'the  ' || c_name || ' <' || c_nationkey || '> & co'"


@query(f"""WITH a AS (SELECT *, {_AUTHORS} AS authors, {_DATE} AS date, 'T' || substr(replace({_TITLE}, '  ', ' '), 2) AS title, CASE WHEN c_custkey % 7 > 0 THEN '10.1234/x#' || c_custkey ELSE '' END AS doi FROM customer),
    b AS (SELECT *, CASE c_custkey % 5 WHEN 3 THEN 'Abel J-P, Dorn LM, Eck P, et al.' ELSE authors END AS listed FROM a)
    SELECT c_custkey, CASE WHEN authors = '' THEN 'PMID ' || c_custkey ELSE CASE c_custkey % 5 WHEN 0 THEN 'van Abel, K.' WHEN 1 THEN 'Abel, K., et al.' WHEN 2 THEN 'TEAM Consortium, et al.' ELSE 'Abel, J., et al.' END || CASE WHEN c_custkey % 3 = 0 THEN ' (' || (1990 + c_nationkey) || ')' ELSE '' END END AS short,
    concat_ws('<br>', '<b>' || nullif(listed, '') || '</b>', '<i>' || {_ESCAPED.format("title")} || '</i>', {_ESCAPED.format("c_mktsegment")} || coalesce(' (' || nullif(date, '') || ')', ''), 'DOI: ' || nullif(doi, '')) AS formatted,
    CASE WHEN listed = '' OR doi = '' THEN 'Reference=' || concat_ws(' ', nullif(listed, ''), title, c_mktsegment || coalesce(' (' || nullif(date, '') || ')', ''), 'DOI: ' || nullif(doi, ''))
    ELSE 'Authors=' || listed || '|Title=' || title || '|Journal=' || c_mktsegment || coalesce(' (' || nullif(date, '') || ')', '') || '|DOI=' || doi END AS lines,
    CASE WHEN doi <> '' THEN 'https://doi.org/10.1234/x%23' || c_custkey END AS doi FROM b""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and formatted citations, labelled lines of the formatted ones, and links of DOIs."""
    authors, date, title = F.expr(_AUTHORS), F.expr(_DATE), F.expr(_TITLE)
    names = F.filter(F.split(authors, r"\s*,\s*"), lambda x: x != "")
    doi = F.expr("CASE WHEN c_custkey % 7 > 0 THEN '10.1234/x#' || c_custkey ELSE '' END")
    formatted = W.formatted_citation(W.author_list(names), title, F.col("c_mktsegment"), date, doi)
    lines = F.array_join(F.transform(W.citation_lines(F.col("formatted")), lambda x: F.concat(x["label"], F.lit("="), x["value"])), "|")
    rows = read(spark, sf_dir, "customer").select("c_custkey", W.short_citation(authors, date, F.col("c_custkey")).alias("short"), formatted.alias("formatted"), W.doi_link(doi).alias("doi"))
    return rows.select("c_custkey", "short", "formatted", lines.alias("lines"), "doi")
