"""Mutations, sweeps, checks and sheets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.operators import sync
from curalake.plans.registry import query, read, typed


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'second' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT o_orderkey, 'only' FROM orders WHERE o_orderkey % 4 = 1""")
def newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: later rows of a batch win over earlier ones and over what is stored."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    batch = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.lit("first").alias("o_orderstatus")), F.struct(F.lit(2).alias("pos"), F.lit("second").alias("o_orderstatus")))).alias("e")).select("o_orderkey", "e.*")
    batch = batch.unionByName(o.where("o_orderkey % 4 = 1").select("o_orderkey", F.lit(1).alias("pos"), F.lit("only").alias("o_orderstatus")))
    return sync.newest_rows(o.where("o_orderkey % 4 <> 1"), batch, "o_orderkey", "pos")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (SELECT min(s_name) FROM supplier WHERE s_nationkey = c_nationkey) WHEN c_custkey % 3 = 1 THEN coalesce((SELECT min(s_name) FROM supplier WHERE s_nationkey = c_nationkey), NULL) ELSE c_mktsegment END AS place FROM customer""")
def filled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks filled from the source row of the key."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), F.expr("CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment END").alias("place"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nation"), F.col("s_name").alias("place"))
    return sync.filled(c, s, F.col("nation"), "nation", ["place"]).select("c_custkey", "place")


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS id FROM lineitem), k AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0)
    SELECT id, max(pos) AS pos, 'refresh' AS route FROM s JOIN k USING (id) GROUP BY id UNION ALL SELECT id, pos, CASE WHEN id IS NULL THEN 'skip' ELSE 'insert' END FROM s WHERE id IS NULL OR id NOT IN (SELECT id FROM k)""")
def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refresh for each known id, inserts for others, null ids skipped."""
    s = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("id"))
    return sync.routed(read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id")), s, "id", "pos").select("id", "pos", "route")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'F' END ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 3 = 0 AND o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS changed FROM orders""")
def status_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: only rows whose stored status differs are changed."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "F").alias("o_orderstatus"))
    out, changed = sync.status_sweep(o, new, "o_orderkey", "o_orderstatus")
    return out.join(changed.withColumn("changed", F.lit(True)), "o_orderkey", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


@query("""WITH k AS (SELECT o_custkey, arg_max(o_orderstatus, ROW(o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1) SELECT c_custkey, c_name, status FROM customer LEFT JOIN k ON o_custkey = c_custkey WHERE c_custkey % 5 > 0""")
def full_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows replaced, the status carried across from the last stored row."""
    old = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    new = read(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select("c_custkey", "c_name")
    return sync.replaced(old, new, "c_custkey", ["status"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS INTEGER) AS ordinal, value FROM (SELECT p_partkey, unnest(range(4)) AS i, trim(unnest([p_name, ' ', p_type, ' ' || p_brand])) AS value FROM part) WHERE value <> ''""")
def backfilled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited cell as child rows."""
    df = read(spark, sf_dir, "part").withColumn("cell", F.concat_ws(";", "p_name", F.lit(" "), "p_type", F.concat(F.lit(" "), "p_brand")))
    return sync.backfilled(df, "p_partkey", "cell", ";")


@query("SELECT s_suppkey, CASE WHEN s_name = 'Supplier#000000003' THEN '(unknown)' ELSE s_name END AS protein, '(none)' AS quote, s_acctbal > 0 AS active FROM supplier")
def migrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older rows brought to today's columns, step by step."""
    old = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("protein"), "s_acctbal")
    steps = {1: {"protein": F.lit("not run")}, 2: {"protein": F.when(F.col("protein") == "Supplier#000000003", "(unknown)").otherwise(F.col("protein")), "quote": F.lit("(none)")}, 3: {"active": F.col("s_acctbal") > 0}}
    return sync.migrated(old, 1, steps).drop("s_acctbal")


@query("""SELECT p_partkey, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ';') AS merged FROM (SELECT p_partkey, list_filter([p_name, p_type, p_brand, p_type, p_name, 'z'], lambda v: v <> '') AS x FROM part)""")
def offset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists with ordinals, the new one behind the old one, each value once."""
    old, new = F.concat_ws(";", "p_name", "p_type", F.lit(""), "p_brand"), F.concat_ws(";", "p_type", "p_name", F.lit("z"))
    return read(spark, sf_dir, "part").select("p_partkey", sync.offset_union(old, new, ";").alias("merged"))


@query("""SELECT s_suppkey AS row, col, CASE WHEN s_suppkey % 4 = 0 AND col = 'name' THEN 'N' || s_suppkey ELSE value END AS value, s_suppkey % 4 = 0 AND col = 'name' AS corrected FROM (SELECT s_suppkey, 'name' AS col, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier)""")
def patched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by row, column, and old value; one that names another value does nothing."""
    s = read(spark, sf_dir, "supplier")
    cells = s.select(F.col("s_suppkey").alias("row"), F.lit("name").alias("col"), F.col("s_name").alias("value")).unionByName(s.select(F.col("s_suppkey").alias("row"), F.lit("nation").alias("col"), F.col("s_nationkey").cast("string").alias("value")))
    fix = s.where("s_suppkey % 4 < 2").select(F.col("s_suppkey").alias("row"), F.lit("name").alias("col"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise("stale").alias("old"), F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("new"))
    return sync.patched(cells, fix, ["row", "col"])


@query("SELECT p_partkey, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, p_brand AS value FROM part, LATERAL (SELECT unnest(range(1, p_partkey % 3 + 2)) AS r), LATERAL (SELECT unnest(range(p_size, p_size + p_partkey % 2 + 1)) AS c)")
def merged_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell of a merged range has its value."""
    df = read(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("top"), (F.col("p_partkey") % 3 + 1).cast("int").alias("bottom"), F.col("p_size").alias("left"), (F.col("p_size") + F.col("p_partkey") % 2).cast("int").alias("right"), F.col("p_brand").alias("value"))
    return sync.rectangle(df, "top", "bottom", "left", "right")


@query(typed("""WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
    SELECT count_if(k IN (SELECT k FROM c)) AS cached, count_if(k NOT IN (SELECT k FROM c) AND k IN (SELECT k FROM f)) AS fetched, count_if(k NOT IN (SELECT k FROM c) AND k NOT IN (SELECT k FROM f)) AS failed FROM k""", cached="BIGINT", fetched="BIGINT", failed="BIGINT"))
def cache_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are cached, fetched, and not found."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return sync.cache_aside(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), c.where("k % 2 = 0"), c.where("k % 3 = 0"), "k")


@query("""SELECT * FROM (SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_type IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 'type' END, CASE WHEN NOT p_size <= 40 THEN 'size' END, CASE WHEN NOT (p_name LIKE '% %') THEN 'name' END, CASE WHEN p_partkey % 50 = 0 THEN 'price' END) AS failures FROM part) WHERE failures <> ''""")
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the rules that a row breaks; a rule that can't be decided is broken."""
    df = read(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_partkey") % 50 > 0, F.col("p_retailprice")))
    rules = {"type": F.col("p_type").isin("ECONOMY", "PROMO", "STANDARD"), "size": F.col("p_size") <= 40, "name": F.col("p_name").contains(" "), "price": F.col("price") > 0}
    return sync.failures(df, rules).select("p_partkey", F.array_join("failures", ",").alias("failures"))


@query("""SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'shape' ELSE 'conflict' END AS rule, l_suppkey FROM lineitem WHERE l_discount > 0.08) WHERE rule = 'conflict' OR l_suppkey % 3 > 0""")
def open_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspects that no review kept; some rules can't be kept, null keys are equal."""
    key = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    df = read(spark, sf_dir, "lineitem").where("l_discount > 0.08").select("l_orderkey", "l_linenumber", key.alias("k"), F.col("l_partkey").alias("part"), "l_suppkey", F.when(F.col("l_partkey") % 2 == 0, "shape").otherwise("conflict").alias("rule"))
    kept = df.where("l_suppkey % 3 = 0").select("l_orderkey", "l_linenumber", "k", "part", "l_suppkey")
    return sync.unsettled(df, kept, ["l_orderkey", "l_linenumber", "k", "part", "l_suppkey"], "rule", ["conflict"]).select("s.l_orderkey", "s.l_linenumber", "s.rule")


@query("""WITH e AS (SELECT o_custkey, min(o_orderkey) AS stop FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o.o_custkey, o_orderkey FROM orders o LEFT JOIN e USING (o_custkey) WHERE stop IS NULL OR o_orderkey < stop""")
def table_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet above its first empty one."""
    return sync.table_extent(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 80 AND user_id % 2 = 0 THEN 'published' WHEN value > 80 THEN 'held' WHEN value > 20 THEN 'checkpoint' ELSE 'nowhere' END AS disposition FROM events""")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an answer lives."""
    high = F.col("value") > 80
    facts = [("failed", F.col("event_type") == "error"), ("published", high & (F.col("user_id") % 2 == 0)), ("held", high), ("checkpoint", F.col("value") > 20)]
    return read(spark, sf_dir, "events").select("event_id", sync.disposition(facts, "nowhere").alias("disposition"))


@query("""WITH RECURSIVE d AS (SELECT s_nationkey AS k, s_suppkey AS id, CAST(floor(s_acctbal / 100) AS DOUBLE) AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 100), s_suppkey) AS i FROM supplier),
    f AS (SELECT k, i, greatest(y, -10.0) AS y FROM d WHERE i = 1 UNION ALL SELECT d.k, d.i, greatest(d.y, f.y + 5) FROM f JOIN d ON d.k = f.k AND d.i = f.i + 1),
    b AS (SELECT k, i, least(y, 90.0) AS y FROM f WHERE i = (SELECT max(i) FROM f g WHERE g.k = f.k) UNION ALL SELECT f.k, f.i, least(f.y, b.y - 5) FROM b JOIN f ON f.k = b.k AND f.i = b.i - 1)
    SELECT k, string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS places FROM b GROUP BY k""")
def clamped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels pushed apart between a top and a bottom."""
    wanted = F.array_sort(F.collect_list(F.floor(F.col("s_acctbal") / 100).cast("double")))
    df = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(wanted.alias("y"))
    return df.select("k", F.array_join(F.transform(sync.clamped(F.col("y"), 5.0, -10.0, 90.0), lambda x: x.cast("long").cast("string")), ",").alias("places"))
