"""Run documents of several versions, and names in the order and equality of a locale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import documents as D
from curalake.operators import ordering
from curalake.plans.registry import query, read, typed

_DOCUMENT = """CASE event_id % 7
    WHEN 0 THEN '{"version":1,"id":"run-' || event_id || '","search":"searched the last ' || (event_id % 20 + 1) || ' days of entries","findings":["article of user ' || user_id || '"," ",7],"counts":{"read":' || user_id || ',"kept":-3}}'
    WHEN 1 THEN '{"version":2,"id":"run-' || event_id || '","window_days":' || (event_id % 30) || ',"findings":[{"kind":"' || event_type || '","text":"article and full text"},{"text":"no kind"},{"kind":"empty"}],"counts":{"read":"many","kept":' || event_id || '}}'
    WHEN 2 THEN '{"version":3,"id":"run-' || event_id || '","window":{"days":' || (event_id % 9) || '},"findings":[{"kind":5,"text":"article stays"}],"props":' || props || '}'
    WHEN 3 THEN '{"version":3,"window":{"days":1}}'
    WHEN 4 THEN '{"version":4,"id":"later"}'
    WHEN 5 THEN '{"version":1,"id":" '
    ELSE '{"version":2,"id":"run-' || event_id || '"}' END"""


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 6) THEN 'run-' || event_id END AS id, CAST(CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 6 THEN 2 END AS INTEGER) AS written_as,
    CAST(CASE event_id % 7 WHEN 0 THEN event_id % 20 + 1 WHEN 1 THEN event_id % 30 WHEN 2 THEN event_id % 9 END AS INTEGER) AS days,
    CASE event_id % 7 WHEN 0 THEN 'note=paper of user ' || user_id WHEN 1 THEN event_type || '=paper and full text|note=no kind' WHEN 2 THEN '5=article stays' WHEN 6 THEN '' END AS findings,
    CAST(CASE event_id % 7 WHEN 0 THEN user_id WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 6 THEN 0 END AS BIGINT) AS n_read, CAST(CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN event_id WHEN 2 THEN 0 WHEN 6 THEN 0 END AS BIGINT) AS n_kept FROM events""")
def run_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three versions in one shape; without an id, of a later version, or broken, they are null as a whole."""
    d = read(spark, sf_dir, "events").select("event_id", D.run_document(F.expr(_DOCUMENT), [("^article", "paper")]).alias("d"))
    findings = F.array_join(F.transform("d.findings", lambda x: F.concat(x["kind"], F.lit("="), x["text"])), "|")
    return d.select("event_id", "d.id", "d.written_as", "d.days", findings.alias("findings"), F.col("d.counts.read").alias("n_read"), F.col("d.counts.kept").alias("n_kept"))


_NAMES = "CASE c_custkey % 6 WHEN 0 THEN 'Émile ' WHEN 1 THEN 'emile ' WHEN 2 THEN 'ÉMILE ' WHEN 3 THEN 'Zoé ' WHEN 4 THEN 'zoe ' END || c_nationkey"


@query(f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 < 5 THEN CASE WHEN c_custkey % 6 < 3 THEN 'emile ' ELSE 'zoe ' END END AS word, c_nationkey AS n, {_NAMES} AS name FROM customer)
    SELECT c_custkey, name, row_number() OVER (ORDER BY word NULLS LAST, CASE WHEN word IS NOT NULL THEN n END, c_custkey) AS up, row_number() OVER (ORDER BY word DESC NULLS LAST, CASE WHEN word IS NOT NULL THEN n END DESC, c_custkey DESC) AS down FROM c""")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by letters whatever their case and accents, numbers in them by value, missing names last both ways."""
    df = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAMES).alias("name"))
    up = ordering.numbered(df, ordering.locale_order("name") + [F.col("c_custkey").asc()], "up")
    down = ordering.numbered(df, ordering.locale_order("name", descending=True) + [F.col("c_custkey").desc()], "down")
    return up.join(down.select("c_custkey", "down"), "c_custkey").select("c_custkey", "name", "up", "down")


@query(typed(f"""WITH c AS (SELECT c_custkey, {_NAMES} AS name, lower(strip_accents({_NAMES})) AS k FROM customer), s AS (SELECT k, name, count(*) AS n FROM c WHERE k IS NOT NULL GROUP BY 1, 2)
    SELECT arg_max(name, n * 1000000 - rank) AS spelling, sum(n) AS rows, count(*) AS spellings FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY name) AS rank FROM s) GROUP BY k""", rows="BIGINT", spellings="BIGINT"))
def locale_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ in case or accents are one group, under its most frequent spelling (of ties the first by code point)."""
    return ordering.spellings(read(spark, sf_dir, "customer").select(F.expr(_NAMES).alias("name")), "name")


@query(f"""SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, lower(strip_accents({_NAMES})) AS k FROM customer) JOIN (SELECT s_suppkey, 'emile ' || s_nationkey AS k FROM supplier WHERE s_suppkey % 2 = 0) USING (k)""")
def locale_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names joined whatever their case and accents."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAMES).alias("name"))
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("EmilÉ "), F.col("s_nationkey").cast("string")).alias("other"))
    return ordering.locale_join(c, s, "name", "other").select("c_custkey", "s_suppkey")
