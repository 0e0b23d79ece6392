"""Merge groups, run reports, ledgers and lists over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalake.functions import wording as W
from curalake.operators import reports
from curalake.plans.registry import query, read, typed

#: The distinct values of a list in the order of their first places, in DuckDB.
_FIRSTS = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), '|')"


@query(f"""WITH e AS (SELECT l_partkey % 97 AS k, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos, l_discount * 10 AS confidence, l_returnflag || l_linenumber % 3 AS trait, CAST(l_suppkey % 11 AS VARCHAR) AS pmid, CASE WHEN l_linenumber % 2 = 0 THEN repeat('x', 300) WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'P' || l_suppkey END AS protein, l_tax > 0.07 AS mr FROM lineitem),
    g AS (SELECT k, list(trait ORDER BY pos) FILTER (confidence >= 0.5) AS t, list(pmid ORDER BY pos) AS p, arg_min(protein, pos) FILTER (trim(protein) <> '' AND length(protein) <= 255) AS protein, coalesce(bool_or(mr) FILTER (confidence >= 0.5), false) AS mr, max(confidence) AS confidence, count(*) AS entries FROM e GROUP BY k)
    SELECT k, {_FIRSTS.format('t')} AS traits, {_FIRSTS.format('p')} AS pmids, protein, CASE WHEN k % 5 > 0 THEN mr END AS mr, confidence, entries FROM g""")
def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims above a floor, articles of all entries, the first name that fits; rows that only bring citations lose their claims."""
    e = read(spark, sf_dir, "lineitem").selectExpr("l_partkey % 97 AS k", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos", "l_discount * 10 AS confidence", "l_returnflag || l_linenumber % 3 AS traits", "CAST(l_suppkey % 11 AS STRING) AS pmids", "CASE WHEN l_linenumber % 2 = 0 THEN repeat('x', 300) WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'P' || l_suppkey END AS protein", "l_tax > 0.07 AS mr")
    out = reports.merged_entries(e, "k", "pos", "confidence", 0.5, ["traits"], ["pmids"], ["protein"], ["mr"])
    out = reports.masked(out, F.col("k") % 5 == 0, ["mr"])
    return out.withColumns({c: F.array_join(c, "|") for c in ("traits", "pmids")})


@query("""WITH r AS (SELECT l_suppkey % 20 AS gene, l_returnflag AS trait, l_linestatus || l_linenumber % 2 AS label, [l_linenumber % 4, l_suppkey % 3] AS refs FROM lineitem), l AS (SELECT gene, trait, label, count(*) AS n FROM r GROUP BY ALL),
    u AS (SELECT gene, trait, arg_min(label, ROW(-n, label)) AS label, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY ALL), x AS (SELECT gene, trait, array_to_string(list_sort(list_distinct(flatten(list(refs)))), ',') AS refs FROM r GROUP BY ALL)
    SELECT gene, trait, label, n, refs, CAST(row_number() OVER (PARTITION BY gene ORDER BY n DESC, trait) AS INTEGER) AS rank FROM u JOIN x USING (gene, trait)""")
def trait_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a trait counted and ranked, with their usual label and all references."""
    r = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 AS gene", "l_returnflag AS trait", "l_linestatus || l_linenumber % 2 AS label", "array(CAST(l_linenumber % 4 AS BIGINT), l_suppkey % 3) AS refs")
    return reports.trait_groups(r, "gene", "trait", "label", "refs").withColumn("refs", F.array_join("refs", ","))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 500 AS registry, o_orderpriority AS name, o_orderstatus AS curated FROM orders), g AS (SELECT registry, name, count(DISTINCT curated) AS kinds, min(id) AS first FROM r GROUP BY ALL)
    SELECT r.id, CASE WHEN kinds > 1 THEN 'conflict' WHEN id = first THEN 'keep' ELSE 'delete' END AS action FROM r JOIN g USING (registry, name)""")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    r = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 500 AS registry", "o_orderpriority AS name", "o_orderstatus AS curated")
    return reports.rename_plan(r, ["registry", "name"], ["curated"], "id").select("id", "action")


@query("SELECT p_name AS drug, min(p_type) AS mechanism, min(p_partkey) AS first_pos, arg_min(p_brand, p_partkey) FILTER (p_size > 25) AS identifier, count(*) FILTER (p_size > 25) AS with_id FROM part GROUP BY 1")
def one_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mechanism a drug, its first identifier, and where it first comes."""
    df = read(spark, sf_dir, "part").select(F.col("p_name").alias("drug"), "p_type", "p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("identifier"))
    firsts = reports.first_identifiers(df, "drug", "identifier", "p_partkey").drop("rows")
    return df.groupBy("drug").agg(F.min("p_type").alias("mechanism")).join(firsts, "drug").orderBy("drug")


@query("""WITH u AS (SELECT event_type, count(*) AS attempts, CAST(coalesce(sum(t) FILTER (b), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(o) FILTER (b), 0) AS BIGINT) AS output, CAST(coalesce(sum(t) FILTER (NOT b), 0) AS BIGINT) AS fallback_tokens, CAST(coalesce(sum(o) FILTER (NOT b), 0) AS BIGINT) AS fallback_output
    FROM (SELECT event_type, CAST(floor(value * 10) AS BIGINT) AS t, user_id % 50 AS o, event_id % 6 > 0 AS b FROM events) GROUP BY 1) SELECT *, (tokens * 3.0 + output * 15.0) / 1e6 AS cost FROM u""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed and fallback usage, and its cost."""
    df = read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 10).cast("long").alias("tokens"), (F.col("user_id") % 50).alias("output"), (F.col("event_id") % 6 > 0).alias("billed"))
    return reports.cost(reports.usage(df, ["event_type"], F.col("billed"), ["tokens", "output"]), {"tokens": 3.0, "output": 15.0}, "cost")


@query("""WITH e AS (SELECT l_suppkey AS paper, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_discount >= 0.07 THEN 'accepted' WHEN l_discount >= 0.03 THEN 'held' ELSE 'rejected' END AS verdict FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY paper, verdict ORDER BY id) AS r FROM e)
    SELECT paper, verdict, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS shown FROM n GROUP BY ALL""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a paper accepted, held and rejected, with the first of each."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount")
    verdict = F.when(F.col("l_discount") >= 0.07, "accepted").when(F.col("l_discount") >= 0.03, "held").otherwise("rejected")
    return reports.routed(e, verdict, ["paper"], 5).withColumn("shown", F.array_join("shown", ","))


@query("""WITH v AS (SELECT event_type AS step, event_id, floor(value) AS s, CASE WHEN value > 99.9 THEN 'e' || event_id END AS error FROM events WHERE event_type <> 'signup'), g AS (SELECT step, min(event_id) AS started, sum(s) AS seconds, arg_min(error, event_id) FILTER (error IS NOT NULL) AS error FROM v GROUP BY 1),
    k AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'purchase'), (3, 'publish')) t(ord, step)) SELECT k.ord, k.step, started, CAST(seconds AS BIGINT) AS seconds, error, CASE WHEN started IS NULL THEN 'skipped' WHEN error IS NOT NULL THEN 'failed' ELSE 'completed' END AS status FROM k LEFT JOIN g USING (step)""")
def step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits added up, the first error kept, steps that nothing reached as skipped."""
    v = read(spark, sf_dir, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("step"), F.col("event_id").alias("at"), F.floor("value").cast("long").alias("seconds"), F.when(F.col("value") > 99.9, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), F.array().cast("array<string>").alias("notes"))
    return reports.step_records(v, ["view", "click", "purchase", "publish"]).select("ord", "step", "started", "seconds", "error", "status")


@query(typed("""SELECT o_orderpriority AS kind, CASE WHEN bool_or(o_totalprice > 499000) THEN NULL ELSE count(*) END AS n, CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS ord FROM orders GROUP BY 1""", ord="BIGINT"))
def rejection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind in the declared order, unknown where a list was cut."""
    return reports.by_kind(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "kind"), "kind", ["2-HIGH", "1-URGENT"], F.col("o_totalprice") > 499000).select("kind", "n", "ord")


@query(typed("""SELECT l_returnflag AS source, count(DISTINCT l_partkey) AS keys, count_if(l_discount > 0.05) AS verbatim, count_if(l_tax > 0.02) AS cited, count_if(l_discount > 0.05) / count(*) AS share FROM lineitem GROUP BY 1""", verbatim="BIGINT", cited="BIGINT"))
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, verbatim and cited quotes of each source."""
    return reports.provenance(read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "source"), ["source"], "l_partkey", F.col("l_discount") > 0.05, F.col("l_tax") > 0.02)


@query("SELECT l_partkey AS id, arg_max(l_orderkey, ROW(l_orderkey, l_linenumber)) AS run, arg_max(l_returnflag, ROW(l_orderkey, l_linenumber)) AS outcome FROM lineitem GROUP BY 1")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all runs that name a key the latest one counts."""
    line = F.struct(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("outcome"))
    logs = read(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("run"), F.array(line).alias("items"))
    return reports.replayed(logs, "id", "run", "items").select("id", F.col("run.l_orderkey").alias("run"), "outcome")


@query("""WITH f AS (SELECT event_id AS fine_id, ts, event_type FROM events WHERE event_id % 3 > 0), c AS (SELECT event_id AS coarse_id, date_trunc('second', ts) AS s, user_id FROM events WHERE event_id % 5 > 0),
    u AS (SELECT s, min(coarse_id) AS coarse_id FROM c GROUP BY s), v AS (SELECT date_trunc('second', ts) AS s, min(fine_id) AS fine_id, min(ts) AS ts FROM f GROUP BY 1)
    SELECT CAST(epoch_us(coalesce(v.ts, u.s)) AS BIGINT) AS at, fine_id, coarse_id FROM v FULL JOIN u ON v.s = u.s""")
def two_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a fine and a coarse log, matched at the second."""
    df = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    fine = df.where("event_id % 3 > 0").groupBy(F.date_trunc("second", "ts").alias("s")).agg(F.min("event_id").alias("fine_id"), F.min("ts").alias("ts")).select("ts", "fine_id", F.lit(None).cast("long").alias("coarse_id"))
    coarse = df.where("event_id % 5 > 0").groupBy(F.date_trunc("second", "ts").alias("ts")).agg(F.min("event_id").alias("coarse_id")).withColumn("fine_id", F.lit(None).cast("long"))
    return reports.merged_precision(fine, coarse, "ts", ["fine_id", "coarse_id"]).select(F.unix_micros("ts").alias("at"), "fine_id", "coarse_id")


@query("""WITH p AS (SELECT p_partkey, unnest(x) AS part, unnest(range(len(x))) AS pos FROM (SELECT p_partkey, list_transform(string_split(p_name || ' ; ' || p_type || ';' || p_name || ';', ';'), lambda y: trim(y)) AS x FROM part)), f AS (SELECT p_partkey, part, min(pos) AS pos FROM p WHERE part <> '' GROUP BY ALL)
    SELECT p_partkey, part, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS INTEGER) AS n FROM f""")
def numbered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parts of a cell, numbered."""
    df = read(spark, sf_dir, "part").withColumn("cell", F.concat("p_name", F.lit(" ; "), "p_type", F.lit(";"), "p_name", F.lit(";")))
    return reports.numbered_parts(df, "p_partkey", "cell", ";")


@query("SELECT l_orderkey, string_agg(l_returnflag, '/' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS flags, coalesce(string_agg(CAST(CASE WHEN l_tax > 0.04 THEN l_suppkey END AS VARCHAR), '/' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag), '') AS suppliers FROM lineitem GROUP BY 1")
def keyed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a record as one."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("pos"), F.col("l_returnflag").alias("flags"), F.when(F.col("l_tax") > 0.04, F.col("l_suppkey").cast("string")).alias("suppliers"))
    return reports.keyed_records(df, "l_orderkey", "pos", ["flags", "suppliers"], "/")


@query("""SELECT count(*) AS rows, count(DISTINCT c_nationkey) AS countries, count(DISTINCT nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END, '')) AS segments, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS pending, max(length(c_name) + 2 * length(c_mktsegment)) AS width FROM customer""")
def map_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct places, blanks left out, rows still to write, and the widest label."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    pending = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").agg(F.count("*").alias("pending"))
    segment = F.nullif(F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")), F.lit(""))
    heads = c.agg(F.count("*").alias("rows"), F.count_distinct("c_nationkey").alias("countries"), F.count_distinct(segment).alias("segments"), F.max(F.length("c_name") + 2 * F.length("c_mktsegment")).cast("long").alias("width"))
    return heads.join(F.broadcast(pending))  # a row each


@query("""SELECT event_type, user_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL HAVING sum(CAST(floor(value) AS BIGINT)) > 10 ORDER BY total DESC, user_id, event_type LIMIT 12""")
def ranked_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve zones of the longest total time, noise left out."""
    df = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.sum(F.floor("value").cast("long")).alias("total"))
    return df.where("total > 10").orderBy(F.desc("total"), "user_id", "event_type").limit(12)


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS k, o_custkey % 40 AS paper FROM orders), c AS (SELECT c_custkey AS k, c_name AS change FROM customer WHERE c_custkey % 3 > 0), p AS (SELECT CAST(n_nationkey AS BIGINT) AS paper, n_name AS title FROM nation)
    SELECT f.id, c.change, p.title, (SELECT count(*) FROM f WHERE k NOT IN (SELECT k FROM c)) AS unmatched FROM f JOIN c USING (k) LEFT JOIN p USING (paper)""")
def attached_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their changes and papers; those without a change are counted."""
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), (F.col("o_custkey") % 40).alias("paper"))
    c = read(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("change"))
    p = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("paper"), F.col("n_name").alias("title"))
    rows, unmatched = reports.attached(f, c, p, "k", "paper")
    return rows.join(F.broadcast(unmatched)).select("id", "change", "title", "unmatched")


@query("""WITH a AS (SELECT user_id, max(ts) AS a FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, max(ts) AS b FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, coalesce(a > b, false) AS moved FROM b LEFT JOIN a USING (user_id)""")
def moved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one source is newer than another."""
    df = read(spark, sf_dir, "events")
    return reports.moved(df.where("event_type = 'purchase'"), df.where("event_type = 'click'"), "user_id", "ts")


@query("""SELECT DISTINCT o_orderpriority AS phase FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def unplaced_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of curated rows that no ring has."""
    curated = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    rings = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "phase string")
    return read(spark, sf_dir, "orders").join(curated, "o_custkey", "left_semi").select(F.col("o_orderpriority").alias("phase")).join(F.broadcast(rings), "phase", "left_anti").distinct().orderBy("phase")


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents), h AS (SELECT doc_id % 50 AS batch, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE digest END AS digest FROM d UNION ALL SELECT doc_id % 50 + 3, doc_id, digest FROM d WHERE doc_id % 2 = 0) SELECT doc_id, min(batch) AS batch FROM h JOIN d USING (doc_id, digest) GROUP BY 1""")
def claimed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by the first batch that has its content."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    h = d.select((F.col("doc_id") % 50).alias("batch"), "doc_id", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("digest")).alias("digest"))
    h = h.unionByName(d.where("doc_id % 2 = 0").select((F.col("doc_id") % 50 + 3).alias("batch"), "doc_id", "digest"))
    return reports.claimed(d, h.withColumn("pos", F.col("batch")), "doc_id", "digest", "pos", "batch")


@query("""SELECT o_custkey, array_to_string(list(DISTINCT o_orderstatus ORDER BY o_orderstatus), '') AS codes, list(o_orderkey ORDER BY o_orderkey)[1] AS first_key, count(*) AS n FROM orders GROUP BY 1""")
def code_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct codes of a key, and all rows by key."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("codes"), F.min("o_orderkey").alias("first_key"), F.count("*").alias("n"))


@query("""SELECT p_partkey, r_name, n_name FROM part LEFT JOIN nation ON n_nationkey = p_size LEFT JOIN region USING (r_regionkey)""".replace("USING (r_regionkey)", "ON r_regionkey = n_regionkey"))
def trait_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lookups one after the other; what isn't known stays null."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return read(spark, sf_dir, "part").join(F.broadcast(n), F.col("p_size") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("p_partkey", "r_name", "n_name")


@query("""WITH s AS (SELECT s_suppkey, substr(md5(length(s_name) || ':' || s_name || length(CAST(s_nationkey AS VARCHAR)) || ':' || s_nationkey), 1, 8) AS print FROM supplier) SELECT l_orderkey, l_linenumber, print FROM lineitem LEFT JOIN s ON s_suppkey = l_suppkey AND l_linenumber % 2 = 0""")
def fingerprinted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the fingerprint of where they come from."""
    from curalake.functions.text import fingerprint

    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(0).alias("sheet"), fingerprint(F.col("s_name"), F.col("s_nationkey")).alias("print"))
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_linenumber") % 2).alias("sheet"))
    return df.join(s, ["l_suppkey", "sheet"], "left").select("l_orderkey", "l_linenumber", "print")


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
    c AS (SELECT l_orderkey, i, 0 AS chunk, 1 AS n, q AS s FROM r WHERE i = 1 UNION ALL SELECT r.l_orderkey, r.i, chunk + CASE WHEN n >= 3 OR s + q > 60 THEN 1 ELSE 0 END, CASE WHEN n >= 3 OR s + q > 60 THEN 1 ELSE n + 1 END, CASE WHEN n >= 3 OR s + q > 60 THEN q ELSE s + q END FROM c JOIN r ON r.l_orderkey = c.l_orderkey AND r.i = c.i + 1)
    SELECT l_orderkey, CAST(i AS INTEGER) AS i, CAST(chunk AS INTEGER) AS chunk FROM c""")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group in chunks of at most three, and of a bounded size."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("i"), F.col("l_quantity").alias("q"))
    return reports.greedy_chunks(df, "l_orderkey", "i", "q", 3, 60)


@query(typed("SELECT l_orderkey, kind, added, removed, CASE kind WHEN 'added' THEN 'new row' WHEN 'removed' THEN 'row goes' ELSE CASE WHEN added + removed = 0 THEN 'no value changes' ELSE concat_ws(', ', CASE WHEN added > 0 THEN 'adds ' || added || CASE added WHEN 1 THEN ' value' ELSE ' values' END END, CASE WHEN removed > 0 THEN 'drops ' || removed || CASE removed WHEN 1 THEN ' value' ELSE ' values' END END) END END AS headline FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 'added' WHEN l_orderkey % 10 = 1 THEN 'removed' ELSE 'changed' END AS kind, count_if(l_returnflag = 'A') AS added, count_if(l_returnflag = 'R') AS removed FROM lineitem GROUP BY 1)", added="BIGINT", removed="BIGINT"))
def change_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z22."""
    kind = F.when(F.col("l_orderkey") % 10 == 0, "added").when(F.col("l_orderkey") % 10 == 1, "removed").otherwise("changed")
    df = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("added"), F.count_if(F.col("l_returnflag") == "R").alias("removed")).withColumn("kind", kind)
    return df.withColumn("headline", W.headline(F.col("kind"), F.col("added"), F.col("removed")))


@query("""SELECT o_custkey % 100 AS voter, o_orderstatus AS kind, md5(to_json(list(DISTINCT o_orderpriority ORDER BY o_orderpriority))) AS edits, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2""")
def edit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits as one key whatever their order, and the last activity."""
    return read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("voter"), F.col("o_orderstatus").alias("kind")).agg(F.md5(F.to_json(F.array_sort(F.collect_set("o_orderpriority"))).cast("binary")).alias("edits"), F.max("o_orderkey").alias("last_key"))


@query("""SELECT o_custkey AS k, o.n IS NOT DISTINCT FROM p.n AND o.l IS NOT DISTINCT FROM p.l AS same FROM (SELECT o_custkey, count(*) AS n, list(o_orderstatus ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) o LEFT JOIN (SELECT o_custkey, count(*) AS n, list(CASE WHEN o_orderkey % 40 = 0 THEN 'Z' ELSE o_orderstatus END ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) p USING (o_custkey)""")
def same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows compared with their lists, nulls equal."""
    by = lambda c: F.struct(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("s")))), lambda x: x["s"]).alias("l"))
    df = read(spark, sf_dir, "orders")
    a = df.groupBy(F.col("o_custkey").alias("k")).agg(by(F.col("o_orderstatus")).alias("a"))
    b = df.groupBy(F.col("o_custkey").alias("k")).agg(by(F.when(F.col("o_orderkey") % 40 == 0, "Z").otherwise(F.col("o_orderstatus"))).alias("b"))
    return a.join(b, "k", "left").select("k", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("SELECT CAST(d AS INTEGER) AS days, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-02-01' - to_days(CAST(d AS INTEGER)) AND ts < TIMESTAMP '2024-02-01') AS n FROM (VALUES (7), (14), (21), (28), (30)) t(d)")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-backs that grow, and what each of them finds."""
    plan = spark.createDataFrame([(d,) for d in reports.windows(30, 7)], "days int")
    end = F.lit("2024-02-01 00:00:00").cast("timestamp")
    seen = read(spark, sf_dir, "events").where(F.col("ts").cast("timestamp") < end).select(F.ceil((F.unix_micros(end) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000).cast("int").alias("age")).groupBy("age").agg(F.count("*").alias("m"))
    return F.broadcast(plan).join(seen, F.col("age") <= F.col("days"), "left").groupBy("days").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


@query("""SELECT doc_id FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS known FROM documents) WHERE digest <> known""")
def drifted_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose digest isn't the known one."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    known = d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("digest")).alias("known"))
    return d.join(known, "doc_id").where("digest <> known").select("doc_id")
