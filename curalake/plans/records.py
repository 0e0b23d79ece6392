"""Article records, rounds of review, labels and limits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import evidence as E
from curalake.functions import text as T
from curalake.operators import records, studies
from curalake.plans.registry import query, read, typed
from curalake.sources.shared import dealt


@query("""SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN p_brand || ' AB, Smith C' END AS authors, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '19' || (10 + p_size) ELSE '20' || (10 + p_size) END AS year, CASE WHEN p_partkey % 2 = 0 THEN '10.1000/' || p_partkey END AS doi, p_type || ' first & second' AS body FROM part""")
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of article records in XML."""
    xml = F.expr("""'<article><title> ' || p_name || ' </title>' || CASE WHEN p_partkey % 3 > 0 THEN '<authors><author><last>' || p_brand || '</last><initials>AB</initials></author><author><last>Smith</last><initials>C</initials></author></authors>' ELSE '' END ||
        '<pubdate>' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '<other>Spring 19' || (10 + p_size) || '</other>' ELSE '<year>20' || (10 + p_size) || '</year>' END || '</pubdate>' || CASE WHEN p_partkey % 2 = 0 THEN '<id type="doi">10.1000/' || p_partkey || '</id>' ELSE '<id type="pmid">1</id>' END || '<p>' || p_type || '</p><p>first &amp; second</p></article>'""")
    return dealt(read(spark, sf_dir, "part")).select("p_partkey", records.article(xml).alias("a")).select("p_partkey", "a.*")


@query("""SELECT column_name AS name, left(column_name, 1) || ' ' || upper(substr(column_name, 3, 1)) || substr(column_name, 4) AS label, left(column_name, 1) || upper(substr(column_name, 3, 1)) || substr(column_name, 4) AS wire FROM (DESCRIBE customer)""")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table with their labels and wire keys."""
    rows = [(c, T.title_label(c), T.camel(T.title_label(c))) for c in read(spark, sf_dir, "customer").columns]
    return spark.createDataFrame(rows, "name string, label string, wire string")


@query(typed("""SELECT c_custkey, CASE upper(trim(c_mktsegment)) WHEN 'BUILDING' THEN 'HOUSES' WHEN 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END AS k, to_json(list_distinct([c_mktsegment, c_name])) AS stored FROM customer""".replace("to_json(list_distinct([c_mktsegment, c_name]))", "to_json([c_mktsegment, c_name])"), stored="VARCHAR"))
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by their alias, others as they are; a distinct list as it is stored."""
    own = F.concat(F.lit(" "), F.lower("c_mktsegment"))
    key = E.lookup(own, {"Building": "HOUSES", "MACHINERY": "TOOLS"}, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", key.alias("k"), F.to_json(F.array_distinct(F.array("c_mktsegment", "c_name", "c_mktsegment"))).alias("stored"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'MONDO:000000' || s_suppkey % 10 || '|HP:0000001' ELSE '' END AS refs, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS n FROM supplier""")
def disease_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a trait that names a disease, in their canonical form."""
    xrefs = F.expr("array(CASE WHEN s_suppkey % 3 = 0 THEN 'MONDO:' ELSE 'HP:' END || s_suppkey % 10, 'HP:1', '', 'HP:1')")
    kept = records.bearing(xrefs, ["MONDO", "OMIM"])
    canonical = F.array_distinct(F.transform(kept, lambda x: T.canonical_xref(F.substring_index(x, ":", 1), x)))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(canonical, "|").alias("refs"), F.size(canonical).alias("n"))


@query("SELECT count(*) AS rows, true AS ready FROM orders")
def round_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round is only read if its preconditions hold."""
    checks = {"no rows": F.count("*") > 0, "keys repeat": F.count_distinct("o_orderkey") == F.count("*"), "status missing": F.count("o_orderstatus") == F.count("*")}
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), records.preconditions(checks).alias("ready"))


@query("""SELECT event_id, CAST(7 + event_id % 20 AS INTEGER) AS days, 'paper|no text in ' || event_type AS notes FROM events""")
def reworded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window read back from its wording, and wordings of nested notes brought up to date."""
    days = F.regexp_extract(F.concat(F.lit("searched the last "), (7 + F.col("event_id") % 20).cast("string"), F.lit(" days of entries")), r"last (\d+) days", 1).cast("int")
    notes = F.transform(F.array(F.lit("article"), F.concat(F.lit("full text missing in "), "event_type")), lambda x: F.regexp_replace(F.regexp_replace(x, "^article$", "paper"), "^full text missing", "no text"))
    return read(spark, sf_dir, "events").select("event_id", days.alias("days"), F.array_join(notes, "|").alias("notes"))


@query("""SELECT l_suppkey, count(*) AS entries, md5(string_agg(l_orderkey || ':' || l_linenumber || ':' || l_returnflag, ';' ORDER BY l_orderkey, l_linenumber, l_returnflag)) AS summary FROM lineitem GROUP BY 1""")
def paper_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows of a paper's results, in order."""
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_returnflag")))
    text = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string"), x["l_returnflag"])), ";")
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("entries"), F.md5(text.cast("binary")).alias("summary"))


@query("""SELECT o_custkey, string_agg(o_orderkey || ' ' || o_orderpriority, ',' ORDER BY o_orderkey) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS notes, bool_or(o_totalprice > 300000) AS large, greatest(0, count(*) - 12) AS more FROM orders GROUP BY 1""")
def notes_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of given kinds in order, whether a column is needed, and how many more there are than shown."""
    note = F.struct("o_orderkey", F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("t"))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), note))), lambda x: x["t"]), ",")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.nullif(notes, F.lit("")).alias("notes"), F.bool_or(F.col("o_totalprice") > 300000).alias("large"), F.greatest(F.lit(0), F.count("*") - 12).alias("more"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*example\.com/fr/') THEN NULL END AS none, CASE WHEN starts_with(url, 'https://a') THEN 'secure a' WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://t') THEN 'plain t' END AS service FROM pages".replace("CASE WHEN regexp_matches(url, '^https?://[^/]*example\\.com/fr/') THEN NULL END AS none, ", ""))
def page_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service of an address, by its longest known prefix."""
    prefixes = spark.createDataFrame([("https://", "secure"), ("https://a", "secure a"), ("http://t", "plain t")], "prefix string, service string")
    return records.service(read(spark, sf_dir, "pages").select("page_id", "url"), "url", prefixes).select("page_id", "service")


@query(typed("""WITH a AS (SELECT l_partkey % 200 AS subject, l_suppkey % 7 AS voter, l_linenumber % 2 AS version, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos, l_orderkey AS day, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'pass' END AS answer FROM lineitem),
    c AS (SELECT subject, max(version) AS now FROM a GROUP BY 1), l AS (SELECT a.subject, a.voter, arg_max(answer, pos) AS v FROM a JOIN c ON a.subject = c.subject AND a.version = c.now GROUP BY ALL),
    t AS (SELECT subject, count_if(v = 'yes') AS yes, count_if(v = 'no') AS no, max(v) FILTER (voter = 0) AS ruling FROM l GROUP BY 1)
    SELECT t.subject, yes, no, CASE WHEN ruling IN ('yes', 'no') THEN 'chair: ' || ruling WHEN yes >= 5 THEN 'accepted' WHEN no >= 5 THEN 'rejected' ELSE 'open' END AS standing, c.last.l_orderkey AS last_day FROM t JOIN c ON c.subject = t.subject""".replace("c.last.l_orderkey", "(SELECT max(day) FROM a WHERE a.subject = t.subject)"), yes="BIGINT", no="BIGINT"))
def review_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest answers to the current version, the chair's alone where there is one, and the last activity."""
    answer = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").otherwise("pass")
    a = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("subject"), (F.col("l_suppkey") % 7).alias("voter"), (F.col("l_linenumber") % 2).alias("version"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"), answer.alias("answer"))
    return records.rulings(a, "subject", "voter", "version", "at", "answer", F.col("voter") == 0, 7).select("subject", "yes", "no", "standing", F.col("last_at.l_orderkey").alias("last_day"))


@query("""WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS second, count_if(value > 60) AS n FROM events GROUP BY 1) SELECT second, CAST(sum(n) OVER (ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS held, sum(n) OVER (ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) <= 5 AS allowed FROM s""")
def global_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of all clients together in the last hour, and whether one more is allowed."""
    return records.in_last(read(spark, sf_dir, "events"), "ts", 3600, F.col("value") > 60).withColumn("allowed", F.col("held") <= 5)


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27'""")
def late_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entered in the look-back is found, however early it is dated."""
    day = lambda n: F.lit(f"2024-01-{n} 00:00:00").cast("timestamp")
    df = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("entered")).withColumn("dated", F.col("entered") - F.make_dt_interval(days=(F.col("event_id") % 50).cast("int")))
    return df.where((F.col("entered") >= day(20)) & (F.col("entered") < day(27)) & (F.col("dated") <= F.col("entered"))).select("event_id")


@query("""WITH f AS (SELECT l_returnflag AS source, l_linestatus AS verdict, list_filter([CASE WHEN l_discount > 0.08 THEN 'cheap' END, CASE WHEN l_quantity > 40 THEN 'many' END], lambda x: x IS NOT NULL) AS flags FROM lineitem)
    SELECT source, 'flag ' || name AS figure, count(*) AS n FROM (SELECT source, unnest(flags) AS name FROM f) GROUP BY ALL UNION ALL SELECT source, 'verdict ' || verdict, count(*) FROM f GROUP BY ALL""")
def verdict_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and flags counted."""
    flags = F.filter(F.array(F.when(F.col("l_discount") > 0.08, "cheap"), F.when(F.col("l_quantity") > 40, "many")), lambda x: x.isNotNull())
    df = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("verdict"), flags.alias("flags"))
    return records.flag_counts(df, ["source"], "flags", "verdict")


@query("""SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS pos, first_pos FROM (SELECT *, min(l_orderkey * 1000000 + l_partkey * 10 + l_linenumber) OVER (PARTITION BY l_suppkey, l_returnflag, l_quantity, l_discount) AS first_pos FROM lineitem) WHERE l_orderkey * 1000000 + l_partkey * 10 + l_linenumber > first_pos""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an earlier one in four columns."""
    df = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_suppkey", "l_returnflag", "l_quantity", "l_discount")
    return records.duplicate_rows(df, ["l_suppkey", "l_returnflag", "l_quantity", "l_discount"], "pos")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells pivoted to rows of a sheet."""
    c = read(spark, sf_dir, "customer")
    cells = c.select("c_custkey", F.explode(F.create_map(F.lit("A"), F.col("c_name"), F.lit("B"), F.col("c_mktsegment"), F.lit("C"), F.lit("x"))).alias("col", "value"))
    return records.pivoted(cells, ["c_custkey"], "col", "value", {"A": "name", "B": "segment"})


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def configured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by settings of a version that is understood."""
    settings = studies.checked_settings({"version": 2, "floor": 250000, "status": "F"}, 2, ["floor", "status"])
    return read(spark, sf_dir, "orders").where((F.col("o_totalprice") > settings["floor"]) & (F.col("o_orderstatus") == settings["status"])).select("o_orderkey")


@query("""SELECT count(DISTINCT p_partkey) AS parts, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS kinds, (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w NOT IN ('red', 'blue')) AS words FROM part""")
def reference_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: four distinct counts, one of them over exploded and filtered references."""
    df = read(spark, sf_dir, "part")
    words = df.select(F.explode(F.split("p_name", " ")).alias("w")).where(~F.col("w").isin("red", "blue")).agg(F.count_distinct("w").alias("words"))
    return df.agg(F.count_distinct("p_partkey").alias("parts"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("kinds")).join(F.broadcast(words))
