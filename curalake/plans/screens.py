"""Scans, filters and nested records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import evidence as E
from curalake.functions import sentinel as S
from curalake.functions import text as T
from curalake.operators import ordering, predicates, studies
from curalake.plans.registry import query, read, typed


@query("SELECT n_nationkey, n_name FROM nation")
def published_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allowed table in the order of its key, without its hidden columns."""
    return studies.scan(spark, sf_dir, "nation", ["nation", "region"], ["n_nationkey"], ["n_regionkey"])


@query("SELECT p_partkey, p_name, CAST(NULL AS VARCHAR[]) AS tags, CAST(NULL AS VARCHAR[]) AS notes FROM part")
def placeholder_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    return studies.with_placeholders(read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["tags", "notes"])


@query("SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_totalprice > 400000)")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a set of keys, compared as text."""
    keys = read(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return studies.of_keys(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), keys, "c_custkey", "o_custkey")


@query("""SELECT user_id, event_type, max(ts) >= TIMESTAMP '2024-01-20' AS fresh, CAST(arg_max(CAST(floor(value) AS BIGINT) % 3, ts) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING max(ts) >= TIMESTAMP '2024-01-10'""")
def status_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each key and source that is young enough; one that found nothing counts as known too."""
    df = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"), F.max_by(F.floor("value").cast("long") % 3, "ts").alias("n"))
    limit = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
    return df.where(F.col("at").cast("timestamp") >= limit(10)).select("user_id", "event_type", (F.col("at").cast("timestamp") >= limit(20)).alias("fresh"), "n")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND value > 50 AND json_extract_string(props, '$.k') <> ''")
def edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two relations with a group that isn't empty, in total order."""
    df = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase") & (F.col("value") > 50) & (F.get_json_object("props", "$.k") != ""))
    return df.orderBy("event_type", "user_id", "event_id").select("event_id", "user_id", "event_type")


@query(r"SELECT DISTINCT upper(w) AS k FROM (SELECT unnest(regexp_extract_all(p_name, '[a-z]+')) AS w FROM part) WHERE w IS NOT NULL")
def sync_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys of a text column, in capitals."""
    words = F.explode(F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0)))
    return read(spark, sf_dir, "part").select(words.alias("w")).select(F.upper("w").alias("k")).distinct()


@query(r"SELECT DISTINCT 'NCT' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id FROM supplier WHERE s_suppkey % 3 > 0")
def registry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of the shape, in order."""
    c = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'X' || s_suppkey ELSE 'NCT' || lpad(CAST(s_suppkey AS STRING), 8, '0') END")
    return read(spark, sf_dir, "supplier").select(c.alias("id")).where(F.col("id").rlike("^NCT[0-9]{8}$")).distinct().orderBy("id")


@query("""SELECT c_custkey, coalesce(s_name, n_name) AS name, CAST(CASE WHEN s_name IS NOT NULL THEN 1 WHEN n_name IS NOT NULL THEN 2 END AS INTEGER) AS registry FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey - 90""")
def fallback_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first registry that has the key."""
    first = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    second = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 90).cast("long").alias("c_custkey"), F.col("n_name").alias("name"))
    return studies.fallback(read(spark, sf_dir, "customer").select("c_custkey"), [first, second], "c_custkey", "name")


_TAGS = "split(p_name || ';' || CASE WHEN p_partkey % 4 = 0 THEN '(none found)' ELSE p_type END, ';')"
_TAGS_SQL = "[p_name, CASE WHEN p_partkey % 4 = 0 THEN '(none found)' ELSE p_type END]"


@query(f"SELECT p_partkey, len(list_filter({_TAGS_SQL}, lambda x: x <> '(none found)')) > 0 AS real FROM part WHERE len(list_filter({_TAGS_SQL}, lambda x: lower(trim(x)) IN ('economy', 'red widget'))) > 0 AND p_size % 2 = 1 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def gene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one of two flags, any of the tags, any of the kinds; a filter with all or no choices is off."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 1, "Yes").otherwise("No").alias("flag"), F.expr(_TAGS).alias("tags"), F.array("p_brand").alias("kinds"))
    out = predicates.grouped(df, [("flag", predicates.matches, ["yes"], {"mode": "binary"}), ("tags", predicates.matches_any, [" Economy", "RED WIDGET"], {}), ("kinds", predicates.matches_any, ["Brand#1", "Brand#2", "brand#3"], {}), ("kinds", predicates.matches_any, ["all", "x"], {})])
    return out.select("p_partkey", S.has_real_values(F.col("tags")).alias("real"))


_TRIAL = """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS genetic, CASE o_orderkey % 3 WHEN 0 THEN 'NCT' WHEN 1 THEN 'ISRCTN' ELSE 'jRCT' END AS registry,
    CASE o_orderkey % 5 WHEN 0 THEN 'Phase I/II' WHEN 1 THEN 'Phase IIb' WHEN 2 THEN 'III' WHEN 3 THEN '(unknown)' ELSE NULL END AS phase, o_orderpriority AS population,
    CASE o_orderkey % 7 WHEN 0 THEN 'Industry' WHEN 1 THEN 'Industry - X' WHEN 2 THEN 'NIH' ELSE 'Other' END AS sponsor, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 'COMPLETED' ELSE '(unknown)' END AS status FROM orders"""


@query(f"""SELECT o_orderkey FROM ({_TRIAL}) WHERE genetic = 'Yes' AND registry IN ('NCT', 'jRCT') AND coalesce(o_orderkey % 5 IN (0, 1) OR phase = '(unknown)', false) AND sponsor IN ('Industry', 'Industry - X', 'NIH') AND coalesce(status, '(unknown)') = '(unknown)'""")
def trial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """six groups at once, with the rules of F7 to F9."""
    read_orders = read(spark, sf_dir, "orders")
    df = read_orders.selectExpr(*(x.strip() for x in _select_items(_TRIAL)))
    groups = [("genetic", predicates.matches, ["Yes"], {"mode": "binary"}), ("registry", predicates.matches, ["nct", "jrct"], {}), ("phase", predicates.matches_phase, ["II", "(unknown)"], {}), ("population", predicates.matches, ["all"], {}), ("sponsor", predicates.matches_prefix, ["Industry", "NIH"], {}), ("status", predicates.matches_status, ["Unknown"], {})]
    return predicates.grouped(df, groups).select("o_orderkey")


def _select_items(sql: str) -> list[str]:
    """The select list of a statement without subqueries, item by item."""
    body = sql.split("SELECT", 1)[1].rsplit(" FROM ", 1)[0]
    items, depth = [""], 0
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append("")
        else:
            items[-1] += ch
    return items


@query(typed(f"""SELECT registry, count(*) AS n, count_if(coalesce(status, 'UNKNOWN') NOT IN ('COMPLETED', '(unknown)', 'UNKNOWN')) AS visible, 'registry: NCT, jRCT; status: UNKNOWN' AS summary FROM ({_TRIAL}) WHERE registry <> 'ISRCTN' AND coalesce(status, '(unknown)') = '(unknown)' GROUP BY 1""", visible="BIGINT"))
def facility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of some states, those that are shown at first, and the filter in words."""
    df = read(spark, sf_dir, "orders").selectExpr(*_select_items(_TRIAL))
    chosen = {"registry": ["NCT", "jRCT"], "population": ["all"], "status": ["UNKNOWN"]}
    found = df.where(predicates.matches(F.col("registry"), chosen["registry"]) & predicates.matches_status(F.col("status"), chosen["status"]))
    shown = predicates.visible(F.col("status"), ["COMPLETED", "SUSPENDED", "UNKNOWN"])
    return found.groupBy("registry").agg(F.count("*").alias("n"), F.count_if(shown).alias("visible"), F.lit(predicates.summary(chosen)).alias("summary"))


_SEGMENTS = "CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE c_mktsegment END"


@query(f"SELECT c_custkey FROM customer WHERE length(trim({_SEGMENTS})) > 0")
def curation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    return read(spark, sf_dir, "customer").where(predicates.curated(F.expr(_SEGMENTS))).select("c_custkey")


_STUDY = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('Small vessel stroke') WHEN 2 THEN array('Migraine', 'vascular  Dementia of type ' || o_orderstatus) ELSE array('Asthma') END AS conditions,
    CASE o_orderkey % 3 WHEN 0 THEN 'Interventional' WHEN 1 THEN NULL ELSE 'OBSERVATIONAL' END AS type,
    array(named_struct('kind', 'DRUG', 'name', o_orderpriority, 'other_names', CAST(NULL AS ARRAY<STRING>)), named_struct('kind', 'drug', 'name', 'X' || o_custkey % 7, 'other_names', array(CASE WHEN o_custkey % 5 = 0 THEN 'Placebo oral' ELSE 'y' END)), named_struct('kind', 'DEVICE', 'name', 'stent', 'other_names', array('z')), named_struct('kind', 'DRUG', 'name', o_orderpriority, 'other_names', array('a'))) AS interventions,
    array(named_struct('place', 'p1', 'lat', o_custkey % 100 + 0.5D, 'lon', 10.0D), named_struct('place', 'p2', 'lat', CAST(NULL AS DOUBLE), 'lon', 20.0D), named_struct('place', 'p3', 'lat', -5.0D, 'lon', o_custkey % 200 * 1.0D)) AS locations FROM {orders}"""


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_STUDY, orders=read(spark, sf_dir, "orders"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 3 < 2")
def relevant_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by condition, or without any; interventional, or not stated."""
    df = _studies(spark, sf_dir)
    return df.where(studies.relevant(F.col("conditions"), ["small vessel"], [("vascular", "dementia")]) & studies.interventional(F.col("type"))).select("id")


@query("SELECT o_orderkey AS id, o_orderpriority AS agent FROM orders UNION ALL SELECT o_orderkey, 'X' || o_custkey % 7 FROM orders WHERE o_custkey % 5 > 0")
def study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each agent of a study, comparators and other kinds left out."""
    return studies.agent_rows(_studies(spark, sf_dir), ["DRUG", "BIOLOGICAL"]).select("id", "agent")


@query(typed("""WITH l AS (SELECT o_orderkey AS id, 'p1' AS place, o_custkey % 100 + 0.5 AS lat, 10.0 AS lon FROM orders UNION ALL SELECT o_orderkey, 'p2', NULL, 20.0 FROM orders UNION ALL SELECT o_orderkey, 'p3', -5.0, o_custkey % 200 FROM orders),
    g AS (SELECT *, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS good FROM l)
    SELECT id, count_if(good) AS kept, count_if(NOT good) AS dropped, string_agg(place, ',' ORDER BY place) FILTER (good) AS places FROM g GROUP BY id""", kept="BIGINT", dropped="BIGINT"))
def facility_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facilities with coordinates, and how many were dropped."""
    rows, dropped = studies.facility_rows(_studies(spark, sf_dir))
    kept = rows.groupBy("id").agg(F.count("*").alias("kept"), F.array_join(F.array_sort(F.collect_list("place")), ",").alias("places"))
    return dropped.join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(0)).alias("kept"), "dropped", "places")


@query("""SELECT DISTINCT p_partkey, 'name' AS relation, unnest(string_split(p_name, ' ')) AS value FROM part UNION SELECT p_partkey, 'kind', p_type FROM part UNION SELECT p_partkey, 'brand', p_brand FROM part WHERE p_size > 25""")
def annotation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges of three relations, each once."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("names"), F.array("p_type", F.lit(" "), "p_type").alias("kinds"), F.when(F.col("p_size") > 25, F.array("p_brand")).alias("brands"))
    return studies.edges(df, {"name": "names", "kind": "kinds", "brand": "brands"}, "p_partkey")


@query("SELECT p_partkey, p_size BETWEEN 1 AND 20 AND p_type <> 'PROMO' AND p_partkey % 50 <= 30 AS describes FROM part")
def record_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few symbols, no barred kind, a short span."""
    symbols = F.when(F.col("p_size") < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.col("p_size")))
    spans = F.array(F.struct(F.lit("100").alias("start"), (100 - F.col("p_partkey") % 50).cast("string").alias("stop")), F.struct(F.lit("").alias("start"), F.lit("9999").alias("stop")))
    return read(spark, sf_dir, "part").select("p_partkey", studies.describes(symbols, F.array("p_type"), spans, 20, ["PROMO"], 30).alias("describes"))


@query(r"SELECT s_suppkey, s_suppkey % 4 = 0 AS doi, s_suppkey % 4 = 1 AS pmid, s_suppkey % 4 = 2 AS symbol, s_suppkey % 4 = 3 AS series FROM supplier")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the shapes of a DOI, an article id, a symbol and a series."""
    c = F.expr("CASE s_suppkey % 4 WHEN 0 THEN '10.1000/a' || s_suppkey WHEN 1 THEN '1234' || s_suppkey WHEN 2 THEN 'ABC' || s_suppkey ELSE 'PS10000' || s_suppkey % 10 END")
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.is_doi(c).alias("doi"), T.is_pmid(c).alias("pmid"), (T.is_symbol(c) & ~T.is_series(c)).alias("symbol"), T.is_series(c).alias("series"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders UNION SELECT o_custkey + 1 FROM orders)")
def referenced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows that any link names."""
    links = read(spark, sf_dir, "orders").select(F.array("o_custkey", F.col("o_custkey") + 1).alias("links"))
    return studies.referenced(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), links, "c_custkey", "links")


_RAW = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'n/a' ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_name END AS name FROM {customer}"


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '(unknown)' WHEN 1 THEN '(unknown)' ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey < 5 THEN '(none)' ELSE c_name END AS name,
    CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment END AS stored_segment, CASE WHEN c_nationkey >= 5 THEN c_name END AS stored_name FROM customer""")
def normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent texts as sentinels on the wire, and as null again when they are stored."""
    texts = {"segment": S.UNKNOWN, "name": S.NONE}
    wire = studies.normalised(spark.sql(_RAW, customer=read(spark, sf_dir, "customer")), texts, ["c_custkey"])
    back = studies.stored_form(wire, texts, ["c_custkey"]).toDF("c_custkey", "stored_segment", "stored_name")
    return wire.join(back, "c_custkey")


@query("""SELECT s_suppkey, 'S' || s_suppkey || ' ' || s_name AS label, CASE WHEN s_nationkey % 2 = 0 THEN 'a|b' ELSE 'c' END AS parts, coalesce(nullif(CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE s_name END, ''), 'S' || s_suppkey) AS name FROM supplier""")
def curated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """columns of a curated sheet joined, split and completed."""
    df = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'S' || s_suppkey AS code", "s_name", "CASE WHEN s_nationkey % 2 = 0 THEN 'a; b ;a' ELSE ' c' END AS cell", "CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE s_name END AS own")
    return df.select("s_suppkey", F.concat_ws(" ", "code", "s_name").alias("label"), F.array_join(E.in_order(F.split("cell", ";")), "|").alias("parts"), F.coalesce(S.blank_to_null(F.col("own")), F.col("code")).alias("name"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a document without an identity is null as a whole."""
    doc = F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    df = read(spark, sf_dir, "events").select("event_id", doc.alias("d")).withColumn("d", F.when(F.col("d.kind").isNotNull(), F.col("d")))
    return df.select("event_id", "d.kind", "d.k")


@query("""WITH h AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_returnflag = 'R' AS exact FROM lineitem), a AS (SELECT l_orderkey, arg_min(l_suppkey, ROW(NOT exact, l_linenumber, l_suppkey)) AS any_hit FROM h GROUP BY 1), b AS (SELECT l_orderkey, arg_min(l_suppkey, ROW(l_linenumber, l_suppkey)) AS exact_hit FROM h WHERE exact GROUP BY 1)
    SELECT l_orderkey, any_hit, exact_hit FROM a LEFT JOIN b USING (l_orderkey)""")
def exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact hit if there is one, else the first, or none."""
    hits = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.struct("l_linenumber", "l_suppkey").alias("pos"))
    exact = F.col("l_returnflag") == "R"
    either, only = studies.best_hit(hits, "l_orderkey", exact, "pos", "l_suppkey"), studies.best_hit(hits, "l_orderkey", exact, "pos", "l_suppkey", True)
    return either.withColumnRenamed("l_suppkey", "any_hit").join(only.withColumnRenamed("l_suppkey", "exact_hit"), "l_orderkey", "left")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def flagged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows first, then by a listed order, then the surest, rows without a figure last."""
    price = F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice"))
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("late"), ordering.listed(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]).alias("ring"), F.coalesce(-price, F.lit(float("inf"))).alias("less"))
    return ordering.numbered(df, ["late", "ring", "less", "o_orderkey"], "place").select("o_orderkey", "place")
