"""Orders of first appearance, held keys and shapes of symbols over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.operators import first_seen
from curalake.plans.registry import query, read


@query("""SELECT user_id, event_type, event_id, value, first_seen FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_seen,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value / 10) DESC, props, event_id) AS n FROM events) WHERE n = 1 ORDER BY first_seen""")
def collapsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked row of each key, in the order in which keys were first seen."""
    out = first_seen.collapsed(read(spark, sf_dir, "events"), ["user_id", "event_type"], [-F.floor(F.col("value") / 10), F.col("props")], "event_id")
    return out.select("user_id", "event_type", "event_id", "value", "first_seen").orderBy("first_seen")


@query("""SELECT user_id, string_agg(code || '=' || event_type, ',' ORDER BY first) AS pairs FROM (SELECT user_id, substr(props, 7) AS code, event_type, min(event_id) AS first FROM events WHERE starts_with(props, '{"k": ') GROUP BY ALL) GROUP BY 1""")
def pairs_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of each key, each once, in the order in which they were first seen."""
    out = first_seen.pairs_in_order(read(spark, sf_dir, "events"), "user_id", "props", "event_type", "event_id", '{"k": ')
    return out.select("user_id", F.array_join(F.transform("pairs", lambda x: F.concat(x["code"], F.lit("="), x["other"])), ",").alias("pairs"))


@query("""WITH a AS (SELECT DISTINCT upper(s_name) AS alias, 'S' || s_nationkey AS name FROM supplier),
    k AS (SELECT l_orderkey, l_linenumber, l_quantity, coalesce(name, 'SUPPLIER#' || lpad(l_suppkey::VARCHAR, 9, '0')) AS key FROM lineitem LEFT JOIN a ON alias = 'SUPPLIER#' || lpad(l_suppkey::VARCHAR, 9, '0')),
    h AS (SELECT DISTINCT 'S' || s_nationkey AS key FROM supplier WHERE s_acctbal < 500)
    SELECT l_orderkey, l_linenumber, l_quantity, key IN (FROM h) AS held FROM k""")
def held_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key, by its alias, a review holds back."""
    supplier = read(spark, sf_dir, "supplier")
    aliases = supplier.select(F.col("s_name").alias("alias"), F.concat(F.lit("s"), "s_nationkey").alias("name"))
    symbol = F.concat(F.lit(" supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", symbol.alias("symbol"))
    return first_seen.held(rows, supplier.where("s_acctbal < 500").select(F.col("s_name").alias("symbol")), "symbol", aliases).drop("symbol")


_SYMBOLS = {"gene": "CASE p_partkey % 4 WHEN 0 THEN 'C' || p_size || 'orf' || p_size WHEN 1 THEN p_type || '-' || p_size WHEN 2 THEN p_brand END", "gene_target": "CASE p_partkey % 3 WHEN 0 THEN p_type || 'orf' WHEN 1 THEN p_type || ' ' ELSE 'A' || p_size END"}


@query(" UNION ALL ".join(f"""SELECT p_partkey AS row, '{name}' AS "column", v AS value, 'gene_symbol' AS kind, 'not a gene symbol' AS detail FROM (SELECT p_partkey, {c} AS v FROM part) WHERE v IS NOT NULL AND NOT regexp_full_match(v, '[A-Z0-9-]+(orf[0-9]+[A-Z0-9-]*)?')""" for name, c in _SYMBOLS.items()))
def symbol_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two columns that have no symbol's shape."""
    return first_seen.symbol_suspects(read(spark, sf_dir, "part"), "p_partkey", {name: F.expr(c) for name, c in _SYMBOLS.items()})
