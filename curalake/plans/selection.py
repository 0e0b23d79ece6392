"""Selection, search, sorting and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import sentinel as S
from curalake.functions import text as T
from curalake.operators import ordering, predicates, rollup
from curalake.plans.registry import query, read

_FILTERED = """
    o AS (SELECT o_orderkey, c_name, c_mktsegment, o_orderstatus, o_orderpriority, o_totalprice
          FROM orders JOIN customer ON o_custkey = c_custkey),
    f AS (SELECT * FROM o WHERE lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') AND lower(trim(o_orderstatus)) IN ('f'))
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "o_totalprice")


def _filtered(df: DataFrame) -> DataFrame:
    return df.where(predicates.matches(F.col("o_orderpriority"), ["1-URGENT", " 2-High "]) & predicates.matches(F.col("o_orderstatus"), ["F"], "binary"))


@query(f"WITH {_FILTERED} SELECT * FROM f WHERE contains(lower(c_name), '00') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 25")
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, search, sort and the second page of 25."""
    found = predicates.search(_filtered(_orders(spark, sf_dir)), "00", ["c_name"])
    return ordering.page(found, [F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")], 2, 25)


@query(f"""WITH {_FILTERED}, t AS (SELECT c_mktsegment, count(*) AS total FROM o GROUP BY 1), s AS (SELECT c_mktsegment, count(*) AS shown FROM f GROUP BY 1)
    SELECT c_mktsegment, total, coalesce(shown, 0) AS shown FROM t LEFT JOIN s USING (c_mktsegment)""")
def segment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and shown rows by segment."""
    df = _orders(spark, sf_dir)
    return rollup.histogram(df.select("c_mktsegment").distinct(), df, _filtered(df), "c_mktsegment")


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def headline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5."""
    df = read(spark, sf_dir, "lineitem")
    return df.agg(*(F.count_distinct(c).alias(n) for c, n in (("l_partkey", "parts"), ("l_suppkey", "suppliers"), ("l_orderkey", "orders"), ("l_returnflag", "flags"))))


_PHASES = "CASE p_size % 6 WHEN 0 THEN 'Phase II/III' WHEN 1 THEN 'Ib' WHEN 2 THEN 'Clinical Trial Phase II' WHEN 3 THEN '(unknown)' WHEN 4 THEN 'Phase IV' ELSE NULL END"


@query(f"""SELECT p_partkey, {_PHASES} AS phase FROM part
    WHERE len(list_filter(regexp_extract_all(regexp_replace({_PHASES}, '\\b(I{{1,3}}|IV)[ab]\\b', '\\1', 'g'), '(?i)\\b(IX|IV|V?I{{1,3}}|X)\\b'), lambda x: lower(x) IN ('i', 'ii', '(unknown)'))) > 0
    OR lower({_PHASES}) = '(unknown)'""")
def phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """any phase number, or the whole text where there is none."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.expr(_PHASES).alias("phase"))
    return df.where(predicates.matches_phase(F.col("phase"), ["I", "II", "(unknown)"]))


@query("""SELECT s_suppkey, kind FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Industry' WHEN 1 THEN 'Industry (X)' WHEN 2 THEN 'industrywide' WHEN 3 THEN 'Industry-Sponsored' ELSE 'NIH' END AS kind FROM supplier)
    WHERE lower(kind) = 'industry' OR regexp_matches(lower(kind), '^industry\\b')""")
def sponsor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    kind = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'Industry' WHEN 1 THEN 'Industry (X)' WHEN 2 THEN 'industrywide' WHEN 3 THEN 'Industry-Sponsored' ELSE 'NIH' END")
    return read(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind")).where(predicates.matches_prefix(F.col("kind"), ["Industry"]))


_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '(unknown)' WHEN 2 THEN 'Completed' ELSE o_orderstatus END"


@query(f"SELECT o_orderkey, {_STATUS} AS status FROM orders WHERE {_STATUS} IS NULL OR {_STATUS} = '(unknown)' OR lower({_STATUS}) = 'o'")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an absent status counts as UNKNOWN."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_STATUS).alias("status"))
    return df.where(predicates.matches_status(F.col("status"), ["UNKNOWN", "O"]))


@query(f"SELECT o_orderkey, {_STATUS} AS status FROM orders WHERE coalesce(upper(trim({_STATUS})) NOT IN ('COMPLETED', 'F'), true)")
def running_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lets null and unknown values through."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_STATUS).alias("status"))
    return df.where(predicates.not_denied(F.col("status"), ["COMPLETED", "F"]))


@query(f"""SELECT gate, count(*) AS rejected FROM (SELECT CASE WHEN NOT (o_totalprice > 100000) THEN 'small' WHEN NOT coalesce(upper(trim({_STATUS})) NOT IN ('COMPLETED'), true) THEN 'completed' END AS gate FROM orders) WHERE gate IS NOT NULL GROUP BY gate""")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: how many rows each gate in turn rejects."""
    df = read(spark, sf_dir, "orders").withColumn("status", F.expr(_STATUS))
    return predicates.gates(df, {"small": F.col("o_totalprice") > 100000, "completed": predicates.not_denied(F.col("status"), ["COMPLETED"])})[1]


_SEGMENT = "CASE c_custkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL WHEN 3 THEN 'NA' ELSE c_mktsegment END"


@query(f"SELECT c_custkey, CASE WHEN {_SEGMENT} IS NULL OR upper(trim({_SEGMENT})) IN ('', 'NA', 'N/A') THEN '(unknown)' ELSE {_SEGMENT} END AS segment, nullif(trim({_SEGMENT}), '') AS stored FROM customer")
def sentinel_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2."""
    c = F.expr(_SEGMENT)
    return read(spark, sf_dir, "customer").select("c_custkey", S.fill(c, S.UNKNOWN).alias("segment"), S.blank_to_null(c).alias("stored"))


_YES = "CASE l_linenumber % 4 WHEN 0 THEN 'y' WHEN 1 THEN ' No ' WHEN 2 THEN 'YES' ELSE l_returnflag END"


@query(f"SELECT answer, count(*) AS n FROM (SELECT CASE WHEN upper(trim({_YES})) IN ('Y', 'YES') THEN 'Yes' WHEN upper(trim({_YES})) IN ('N', 'NO') THEN 'No' ELSE {_YES} END AS answer FROM lineitem) GROUP BY answer")
def yes_no_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3."""
    return read(spark, sf_dir, "lineitem").select(S.yes_no(F.expr(_YES)).alias("answer")).groupBy("answer").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, label, CAST(CASE WHEN regexp_matches(label, '^(0?[1-9]|1[0-2])/[0-9]{4}$') THEN CAST(split_part(label, '/', 2) AS INTEGER) * 12 + CAST(split_part(label, '/', 1) AS INTEGER) - 1 END AS INTEGER) AS date_key
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '(unknown)' ELSE regexp_replace(strftime(o_orderdate, '%Y-%m'), '^([0-9]{4})-0?([0-9]{1,2})$', '\\2/\\1') END AS label FROM orders)
    ORDER BY date_key NULLS LAST, o_orderkey""")
def completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By month of completion, rows without one last."""
    label = F.when(F.col("o_orderkey") % 3 == 0, S.UNKNOWN).otherwise(T.completion_label(F.date_format("o_orderdate", "yyyy-MM")))
    df = read(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    return df.withColumn("date_key", T.month_year(F.col("label"))).orderBy(F.asc_nulls_last("date_key"), "o_orderkey")


_LOCATION = "CASE p_partkey % 5 WHEN 0 THEN 'Xq22.1' WHEN 1 THEN (p_size % 30) || 'q24.33-q25.1' WHEN 2 THEN '7q31.1x' ELSE (p_size % 25) || 'p' || (p_size % 9) END"


@query(f"""SELECT p_partkey, CAST(CASE WHEN raw = 'X' THEN 22 WHEN raw = 'Y' THEN 23 WHEN regexp_matches(raw, '^[0-9]+$') AND CAST(raw AS INTEGER) BETWEEN 1 AND 22 THEN CAST(raw AS INTEGER) - 1 ELSE 24 END AS INTEGER) AS chromosome_rank
    FROM (SELECT p_partkey, upper(regexp_extract({_LOCATION}, '(?i)^\\s*(\\d+|[XY])(?:[pq]\\d+(?:\\.\\d+)?(?:-[pq]\\d+(?:\\.\\d+)?)?)?\\s*$', 1)) AS raw FROM part)""".replace("CAST(raw AS INTEGER)", "TRY_CAST(raw AS INTEGER)"))
def karyotype_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3."""
    return read(spark, sf_dir, "part").select("p_partkey", T.chromosome_rank(F.expr(_LOCATION)).alias("chromosome_rank"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY coalesce(list_position(['view', 'click', 'purchase'], event_type), 99), event_type")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed buckets first, others behind them."""
    order = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase"))), F.col("event_type"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.when(order > 0, order).otherwise(99), "event_type")


@query("SELECT CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned, CAST(count_if(l_quantity > 25) AS BIGINT) AS large, count(DISTINCT trim(l_linestatus)) AS statuses FROM lineitem")
def kpi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return read(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.count_distinct(F.trim("l_linestatus")).alias("statuses"))


@query("SELECT DISTINCT c_mktsegment AS choice FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
def carried_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the choices that rows carry."""
    big = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select(F.col("c_mktsegment").alias("choice")).distinct()


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN known AND l_discount >= 0.02 THEN 'update' WHEN NOT known AND l_discount >= 0.07 THEN 'insert' ELSE 'hold' END AS route
    FROM (SELECT *, l_partkey % 3 = 0 AS known FROM lineitem)""")
def confidence_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower floor for stored keys than for new ones."""
    route = predicates.confidence_verdict(F.col("l_discount"), F.col("l_partkey") % 3 == 0, 0.02, 0.07)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", route.alias("route"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal BETWEEN 0 AND 5000 THEN s_acctbal END AS balance FROM supplier WHERE s_nationkey BETWEEN 3 AND 20")
def range_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a value out of range is null; a row whose place is out of range goes."""
    df = read(spark, sf_dir, "supplier").where(predicates.in_range(F.col("s_nationkey"), 3, 20).isNotNull())
    return df.select("s_suppkey", predicates.in_range(F.col("s_acctbal"), 0, 5000).alias("balance"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 150000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS flags FROM orders""")
def record_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the reasons that hold, in order."""
    flags = predicates.first_of(large=F.col("o_totalprice") > 150000, open=F.col("o_orderstatus") == "O", urgent=F.col("o_orderpriority").startswith("1"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(flags, ",").alias("flags"))


@query("SELECT source, median(n_chars) AS median_chars FROM documents GROUP BY source")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O15."""
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.median("n_chars").alias("median_chars"))


@query("""WITH g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CAST(least(len(l), 3) AS INTEGER) AS shown, CAST(len(l) AS INTEGER) AS total, array_to_string(l[1:3], ',') AS items FROM g""")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each list, and how many there are."""
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(ordering.capped(F.sort_array(F.collect_list("o_orderkey")), 3).alias("c"))
    return lists.select("o_custkey", "c.shown", "c.total", F.array_join(F.col("c.items").cast("array<string>"), ",").alias("items"))
