"""Lookups, upserts, comparisons, sets and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import sentinel as S
from curalake.operators import diff, interval, lookup, merge, ordering, rollup
from curalake.plans.registry import query, read


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY k) AS pos, k AS p_partkey FROM (SELECT DISTINCT 2 * l_partkey AS k FROM lineitem))
    SELECT pos, p_partkey, coalesce(p_brand, '(unknown)') AS p_brand, CASE WHEN p.p_partkey IS NULL THEN '#' || r.p_partkey ELSE p_name END AS p_name, p.p_partkey IS NOT NULL AS found
    FROM r LEFT JOIN part p USING (p_partkey)""")
def completion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each requested key, in request order, with defaults."""
    requested = ordering.numbered(read(spark, sf_dir, "lineitem").select((2 * F.col("l_partkey")).alias("p_partkey")).distinct(), ["p_partkey"], "pos")
    defaults = {"p_brand": F.lit(S.UNKNOWN), "p_name": F.concat(F.lit("#"), F.col("p_partkey").cast("string"))}
    return lookup.complete(requested, read(spark, sf_dir, "part"), "p_partkey", defaults)


@query("""SELECT r_regionkey, r_name, coalesce(n_name, CAST(r_regionkey AS VARCHAR)) AS member FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 20""")
def alias_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    members = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("member"))
    return lookup.fan_out(read(spark, sf_dir, "region"), "r_regionkey", members).select("r_regionkey", "r_name", "member")


@query("""SELECT member, owner, ord FROM (SELECT c_mktsegment || '-' || c_nationkey AS member, c_custkey AS owner, c_custkey % 50 AS ord, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey % 50, c_custkey) AS n FROM customer) WHERE n = 1""")
def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several owners of a member the first."""
    members = read(spark, sf_dir, "customer").select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("member"), F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 50).alias("ord"))
    return lookup.first_claim(members, "owner")


@query("SELECT s_suppkey, o_orderkey FROM supplier JOIN orders ON upper('Key' || s_suppkey) = upper('kEY' || o_custkey)")
def folded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality of folded keys."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.upper(F.concat(F.lit("Key"), F.col("s_suppkey").cast("string"))).alias("k"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.upper(F.concat(F.lit("kEY"), F.col("o_custkey").cast("string"))).alias("k"))
    return s.join(o, "k").select("s_suppkey", "o_orderkey")


@query("""SELECT l_orderkey, array_to_string(list(v ORDER BY p, v), ',') AS flags FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS v, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""")
def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child values of a parent, distinct, in the order in which they come."""
    df = read(spark, sf_dir, "lineitem").withColumn("v", F.concat("l_returnflag", "l_linestatus"))
    return rollup.union_of_parts(df, ["l_orderkey"], "l_linenumber", "v", "flags", ",")


@query("""SELECT l_orderkey, l_linenumber, c.o_orderstatus AS status FROM lineitem LEFT JOIN (SELECT o_custkey AS k, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) c ON k = l_suppkey""")
def first_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a key lends its status; null where there is none."""
    firsts = lookup.first_per_key(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")
    df = read(spark, sf_dir, "lineitem")
    return df.join(firsts, df.l_suppkey == firsts.o_custkey, "left").select("l_orderkey", "l_linenumber", F.col("o_orderstatus").alias("status"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return lookup.last_per_key(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20, F22."""
    cache = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.misses(read(spark, sf_dir, "customer"), cache, "c_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders SEMI JOIN customer ON c_custkey = o_custkey AND c_nationkey < 5 WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY AND o_orderpriority IS NOT NULL""")
def fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of wanted keys that are whole and young."""
    cache = read(spark, sf_dir, "orders")
    now = cache.agg(F.max("o_orderdate")).first()[0]
    keys = read(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.fresh(cache, keys, "o_custkey", "o_orderdate", F.lit(now).cast("timestamp_ntz"), 900, ("o_orderpriority",)).select("o_orderkey", "o_custkey")


_T = "(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END AS segment, c_custkey % 3 = 0 AS flag, 'A;' || c_nationkey AS tags, c_acctbal AS balance FROM customer WHERE c_custkey % 5 <> 0)"
_S = "(SELECT c_custkey, c_mktsegment || '!' AS segment, c_custkey % 2 = 0 AS flag, c_nationkey || '; B' AS tags, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal + 1 END AS balance FROM customer WHERE c_custkey % 2 = 0)"


@query(f"""SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey,
    CASE WHEN s.c_custkey IS NULL THEN t.segment WHEN t.c_custkey IS NULL THEN s.segment ELSE coalesce(nullif(trim(t.segment), ''), s.segment) END AS segment,
    CASE WHEN s.c_custkey IS NULL THEN t.flag WHEN t.c_custkey IS NULL THEN s.flag ELSE coalesce(t.flag, false) OR coalesce(s.flag, false) END AS flag,
    CASE WHEN s.c_custkey IS NULL THEN t.tags WHEN t.c_custkey IS NULL THEN s.tags ELSE t.tags || ';B' END AS tags,
    CASE WHEN s.c_custkey IS NULL THEN t.balance WHEN t.c_custkey IS NULL THEN s.balance WHEN t.flag THEN t.balance ELSE coalesce(s.balance, t.balance) END AS balance,
    CASE WHEN t.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'keep' ELSE 'update' END AS change
    FROM {_T} t FULL JOIN {_S} s ON t.c_custkey = s.c_custkey""")
def upsert_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill blanks only, once true stays true, ordered union, new unless null but for frozen rows."""
    target, source = (spark.sql(f"SELECT * FROM {x}".replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer")) for x in (_T, _S))
    rules = {"segment": merge.fill_blank, "flag": merge.either, "tags": merge.union_in_order(), "balance": merge.coalesce_new}
    return merge.upsert(target, source, "c_custkey", rules, frozen=F.col("t.flag"), frozen_columns=("balance",))


@query("""WITH e AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ordinal, l_returnflag || l_suppkey % 5 AS value FROM lineitem WHERE l_linenumber <= 2),
    i AS (SELECT l_orderkey, l_returnflag || l_suppkey % 5 AS value, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2),
    a AS (SELECT i.l_orderkey, coalesce((SELECT max(ordinal) FROM e WHERE e.l_orderkey = i.l_orderkey), 0) + row_number() OVER (PARTITION BY i.l_orderkey ORDER BY pos, value) AS ordinal, value
          FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = i.l_orderkey AND e.value = i.value))
    SELECT *, false AS added FROM e UNION ALL SELECT l_orderkey, CAST(ordinal AS BIGINT), value, true FROM a""")
def ordered_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values behind those that are there, with the ordinals continued."""
    df = read(spark, sf_dir, "lineitem").withColumn("value", F.concat("l_returnflag", (F.col("l_suppkey") % 5).cast("string")))
    existing = df.where("l_linenumber <= 2").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), "value")
    return merge.append_ordered(existing, df.select("l_orderkey", F.col("l_linenumber").alias("pos"), "value"), "l_orderkey")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT o_orderkey, o_custkey, 'X' FROM orders WHERE o_custkey % 10 = 3 AND o_totalprice > 100000""")
def scoped_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: rows of the fetched keys are replaced, by none if there are none."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    mine = df.where("o_custkey % 10 = 3")
    rows = mine.where("o_totalprice > 100000").withColumn("o_orderstatus", F.lit("X"))
    return merge.replace_scoped(df, rows, mine, ["o_custkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS s_suppkey, c_custkey, c_name FROM customer")
def continued_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11."""
    new = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.new_ids(read(spark, sf_dir, "supplier"), new, "s_suppkey", ["c_custkey"])


_OLD = "(SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)"
_NEW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)"


@query(f"""SELECT * FROM (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
    CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'o_orderpriority' END) END AS fields,
    CASE WHEN n.o_orderkey IS NOT NULL THEN left(sha256(coalesce(length(n.o_orderstatus) || ':' || n.o_orderstatus, '-') || coalesce(length(n.o_orderpriority) || ':' || n.o_orderpriority, '-')), 16) END AS version
    FROM {_OLD} o FULL JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey) WHERE kind <> 'changed' OR fields <> ''""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed keys, the fields that differ, and a digest."""
    old, new = (spark.sql(f"SELECT * FROM {x}".replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders")) for x in (_OLD, _NEW))
    return diff.diff(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(f"""SELECT o.o_orderkey FROM {_OLD} o LEFT JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey WHERE n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_orderpriority IS DISTINCT FROM n.o_orderpriority""")
def stale_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals whose base isn't what is stored now."""
    old, new = (spark.sql(f"SELECT * FROM {x}".replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders")) for x in (_OLD, _NEW))
    columns = ["o_orderstatus", "o_orderpriority"]
    proposals = old.select("o_orderkey", F.lit("changed").alias("kind"), diff.digest(*map(F.col, columns)).alias("base_version"))
    return diff.stale(proposals, new, "o_orderkey", columns).select("o_orderkey")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS v FROM lineitem WHERE l_linenumber >= 2),
    j AS (SELECT coalesce(a.k, b.k) AS k, a.v IS NOT NULL AS l, b.v IS NOT NULL AS r FROM a FULL JOIN b ON a.k = b.k AND a.v = b.v),
    c AS (SELECT k AS s, count_if(l AND r) AS "both", count_if(NOT r) AS left_only, count_if(NOT l) AS right_only FROM j GROUP BY k)
    SELECT s, CAST("both" AS BIGINT) AS "both", CAST(left_only AS BIGINT) AS left_only, CAST(right_only AS BIGINT) AS right_only,
    CASE WHEN left_only = 0 AND right_only = 0 THEN 'same' WHEN right_only = 0 THEN 'left has more' WHEN left_only = 0 THEN 'right has more' ELSE 'differ' END AS verdict FROM c""")
def set_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way comparison of value sets by key."""
    df = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("v"), "l_linenumber")
    return diff.reconcile(df.where("l_linenumber <= 2"), df.where("l_linenumber >= 2"), "s", "v")


@query("""SELECT count(*) AS gold, count(o_custkey) AS matched, count(*) - count(o_custkey) AS missed, CAST(count(o_custkey) AS DOUBLE) / count(*) AS recall FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey""")
def recall_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A40, U4."""
    return rollup.recall(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT CAST(k AS BIGINT) AS k FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier) WHERE k > 0")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of three sources."""
    parts = [read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))]
    return parts[0].union(parts[1]).union(parts[2]).where("k > 0").distinct()


_LISTS = """SELECT o_custkey, list(o_orderstatus || o_orderkey % 4 ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0) AS before, list(o_orderstatus || o_orderkey % 4 ORDER BY o_orderkey) AS after FROM orders GROUP BY o_custkey"""


@query(f"SELECT o_custkey, array_to_string(list_filter(after, lambda x: NOT list_contains(coalesce(before, []), x) AND x <> 'F1'), ',') AS gained, len(list_filter(coalesce(before, []), lambda x: NOT list_contains(after, x))) = 0 AS grew FROM ({_LISTS})")
def gained_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list gained, repeats kept; whether nothing was lost."""
    item = F.struct("o_orderkey", F.concat("o_orderstatus", (F.col("o_orderkey") % 4).cast("string")).alias("v"))
    names = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(names(F.when(F.col("o_orderkey") % 2 == 0, item)).alias("before"), names(item).alias("after"))
    return lists.select("o_custkey", F.array_join(diff.gained(F.col("before"), F.col("after"), ["F1"]), ",").alias("gained"), diff.grew_from(F.col("before"), F.col("after")).alias("grew"))


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, p.last_purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase at or before each event."""
    df = read(spark, sf_dir, "events")
    starts = df.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return interval.as_of(df.select("event_id", "user_id", "ts"), starts, ["user_id"], "ts", "ts", "last_purchase").select("event_id", "last_purchase")


@query("""SELECT p_partkey, CAST(b.k AS BIGINT) AS band FROM part JOIN (SELECT k, 900 + 37.5 * k AS low, 900 + 37.5 * (k + 1) AS high FROM range(0, 25) t(k)) b ON p_retailprice >= low AND p_retailprice < high""")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band that a value is in."""
    bands = spark.range(25).select(F.col("id").alias("band"), (900 + 37.5 * F.col("id")).alias("low"), (900 + 37.5 * (F.col("id") + 1)).alias("high"))
    return interval.in_band(read(spark, sf_dir, "part"), bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", "band")


@query("""SELECT a.n AS n, a.k AS left_key, b.k AS right_key FROM (SELECT s_nationkey AS n, s_suppkey AS k, s_acctbal AS lo, s_acctbal + 400 AS hi FROM supplier) a JOIN (SELECT s_nationkey AS n, s_suppkey AS k, s_acctbal AS lo, s_acctbal + 400 AS hi FROM supplier) b
    ON a.n = b.n AND a.k < b.k AND a.lo < b.hi AND b.lo < a.hi""")
def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of one group that overlap."""
    df = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 400).alias("hi"))
    return interval.overlaps(df, "n", "k", "lo", "hi", 500.0)


@query("""SELECT r.g AS chromosome, r.k AS k, least(a.lo, b.lo) AS start, greatest(a.hi, b.hi) AS "end", (least(a.lo, b.lo) + greatest(a.hi, b.hi)) / 2.0 AS midpoint
    FROM (SELECT p_partkey AS k, p_partkey % 5 AS g, 'q' || p_size % 10 AS first, CASE WHEN p_partkey % 3 = 0 THEN 'q' || p_size % 12 END AS last FROM part) r
    JOIN (SELECT c AS g, 'q' || n AS name, n * 100 + c AS lo, n * 100 + c + 90 AS hi FROM range(0, 5) x(c), range(0, 10) y(n)) a ON a.g = r.g AND a.name = r.first
    JOIN (SELECT c AS g, 'q' || n AS name, n * 100 + c AS lo, n * 100 + c + 90 AS hi FROM range(0, 5) x(c), range(0, 10) y(n)) b ON b.g = r.g AND b.name = coalesce(r.last, r.first)""")
def band_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one named band to another; unknown bands are left out."""
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_partkey % 5 AS chromosome", "concat('q', p_size % 10) AS first", "CASE WHEN p_partkey % 3 = 0 THEN concat('q', p_size % 12) END AS last")
    bands = spark.range(50).selectExpr("id div 10 AS chromosome", "concat('q', id % 10) AS name", "(id % 10) * 100 + id div 10 AS lo", "(id % 10) * 100 + id div 10 + 90 AS hi")
    return interval.span(rows, bands, "chromosome", "first", F.col("last"), "name", "lo", "hi").select("chromosome", "k", "start", "end", "midpoint")


@query("SELECT p_partkey, CAST(x AS INTEGER) AS x FROM part, LATERAL (SELECT unnest(range(p_size, p_size + p_partkey % 4 + 1)) AS x)")
def expanded_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19."""
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") + F.col("p_partkey") % 4).cast("int").alias("top"))
    return interval.expand(df, "p_size", "top", "x").select("p_partkey", "x")
