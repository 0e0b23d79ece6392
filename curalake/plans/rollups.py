"""Reductions, windows, votes and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.operators import ordering, quality, review, rollup, windows
from curalake.plans.registry import query, read


@query("SELECT l_partkey, arg_max(l_suppkey, ROW(l_quantity, -((l_orderkey * 10 + l_linenumber) * 10000 + l_suppkey))) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_partkey")
def deciding_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the best score; the earliest of equal ones."""
    df = read(spark, sf_dir, "lineitem").withColumn("pos", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_suppkey"))
    return rollup.arg_max(df, ["l_partkey"], "l_suppkey", "l_quantity", "pos")


@query("""SELECT user_id, event_type AS usual, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def usual_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, O9."""
    return rollup.mode(read(spark, sf_dir, "events"), ["user_id"], "event_type", "usual")


_CASED = "CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE p_brand END"


@query(f"""WITH c AS (SELECT {_CASED} AS brand, count(*) AS n FROM part GROUP BY 1) SELECT brand, n, first_value(brand) OVER w AS spelling, count(*) OVER (PARTITION BY lower(brand)) AS spellings FROM c WINDOW w AS (PARTITION BY lower(brand) ORDER BY n DESC, brand)""")
def majority_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21, A43."""
    return rollup.majority_spelling(read(spark, sf_dir, "part").select(F.expr(_CASED).alias("brand")), "brand")


@query("""SELECT event_type, hour(ts) AS hour, count(*) AS calls, CAST(count_if(value > 50) AS BIGINT) AS ok, CAST(count_if(value <= 50 AND value > 40) AS BIGINT) AS not_found, CAST(count(*) - count_if(value > 40) AS BIGINT) AS errors, CAST(sum(event_id % 100) AS BIGINT) AS millis, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2""")
def traffic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    return _traffic(spark, sf_dir)


def _traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("hour", F.hour("ts").cast("long"))
    missing = (F.col("value") <= 50) & (F.col("value") > 40)
    return rollup.traffic(df, ["event_type", "hour"], F.col("value") > 50, missing, F.col("event_id") % 100, F.length("props").cast("long"))


@query("""SELECT event_type, count(*) AS calls, CAST(count_if(value > 50) AS BIGINT) AS ok, CAST(count(*) - count_if(value > 40) AS BIGINT) AS errors, CAST(sum(event_id % 100) AS BIGINT) AS millis, CAST(count_if(value > 50) AS DOUBLE) / count(*) AS ok_share FROM events GROUP BY 1""")
def traffic_refold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollup folded again, with a guarded ratio."""
    out = rollup.refold(_traffic(spark, sf_dir), ["event_type"], ["calls", "ok", "errors", "millis"])
    return out.withColumn("ok_share", rollup.ratio(F.col("ok"), F.col("calls")))


@query("""SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 END) WHEN 0 THEN 'F' WHEN 1 THEN 'P' WHEN 2 THEN 'O' END AS status FROM orders GROUP BY 1""")
def status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status that occurs."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(rollup.worst(["F", "P", "O"], F.col("o_orderstatus")).alias("status"))


@query("""SELECT s_suppkey, first_pos FROM (SELECT s_suppkey, row_number() OVER w AS n, first_value(s_suppkey) OVER w AS first_pos FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) WHERE n > 1""")
def repeated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A44, A59."""
    df = read(spark, sf_dir, "supplier").withColumn("nation", F.col("s_nationkey").cast("string"))
    return rollup.duplicates(df, "nation", "s_suppkey").select("s_suppkey", "first_pos")


@query("""SELECT l_orderkey, coalesce(arg_max(CASE WHEN l_tax < 0.03 THEN l_partkey END, CASE WHEN l_tax < 0.03 THEN l_linenumber * 1000000 + l_partkey END), arg_min(l_partkey, l_linenumber * 1000000 + l_partkey)) AS code FROM lineitem GROUP BY 1""")
def code_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first code, unless later ones are exact."""
    df = read(spark, sf_dir, "lineitem").withColumn("exact", F.col("l_tax") < 0.03).withColumns({"code": F.col("l_partkey"), "pos": F.col("l_linenumber") * 1000000 + F.col("l_partkey")})
    return rollup.fold_codes(df, ["l_orderkey"], "pos", "code", "exact")


@query("""WITH e AS (SELECT user_id, event_type AS source, CASE event_id % 3 WHEN 0 THEN 'omim' ELSE 'mondo' END AS relation, CAST(event_id % 97 AS VARCHAR) AS value, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS r FROM events)
    SELECT user_id, arg_min(value, ROW(r, value)) FILTER (relation = 'mondo') AS mondo, arg_min(value, ROW(r, value)) FILTER (relation = 'omim') AS omim, array_to_string(list_sort(list(DISTINCT value)), ',') AS related, count(DISTINCT source) AS sources
    FROM e WHERE r IS NOT NULL GROUP BY user_id""")
def annotation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each relation the value of the source that comes first, the set of all values, the versions."""
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 == 0, "omim").otherwise("mondo").alias("relation"), (F.col("event_id") % 97).cast("string").alias("value"), F.lit("1").alias("version"))
    out = rollup.disease_pivot(rows, ["user_id"], ["purchase", "click", "view"], ["mondo", "omim"])
    return out.select("user_id", "mondo", "omim", F.array_join("related", ",").alias("related"), F.size("versions").cast("long").alias("sources"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, W3, O7."""
    df = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ordering.top_per_group(df, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) / (count(*) OVER (PARTITION BY s_nationkey) + 1) AS fraction FROM supplier")
def cell_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", windows.angle_fraction(["s_nationkey"], ["s_name", "s_suppkey"]).alias("fraction"))


@query("""WITH p AS (SELECT c_custkey, c_nationkey % 7 AS x, c_nationkey % 3 AS y FROM customer), q AS (SELECT *, count(*) OVER (PARTITION BY x, y) AS n, row_number() OVER (PARTITION BY x, y ORDER BY c_custkey) - 1 AS i FROM p)
    SELECT c_custkey, CASE WHEN n > 1 THEN round(x + 0.5 * cos(2 * pi() * i / n), 6) ELSE x END AS x, CASE WHEN n > 1 THEN round(y + 0.5 * sin(2 * pi() * i / n), 6) ELSE y END AS y FROM q""")
def jittered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    df = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 7).cast("double").alias("x"), (F.col("c_nationkey") % 3).cast("double").alias("y"))
    x, y = windows.jitter("x", "y", ["c_custkey"], 0.5)
    return df.select("c_custkey", x.alias("x"), y.alias("y"))


@query("""WITH t AS (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT t.user_id, t.event_id, sum(turn) OVER (PARTITION BY t.user_id ORDER BY e.ts, t.event_id ROWS UNBOUNDED PRECEDING) AS run FROM t JOIN events e USING (event_id))
    SELECT event_id, CAST(run AS BIGINT) AS run, CAST(run % 2 AS BIGINT) AS parity, count(*) OVER (PARTITION BY user_id, run) AS span FROM r""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal values, their parity and length."""
    return windows.runs(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "run", "parity", "span")


@query("SELECT p_partkey, CAST(sum(p_size) OVER w - p_size AS BIGINT) AS start, CAST(sum(p_size) OVER w AS BIGINT) AS stop FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)")
def running_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, A47."""
    start, stop = windows.running_span(["p_brand"], ["p_partkey"], "p_size")
    return read(spark, sf_dir, "part").select("p_partkey", start.alias("start"), stop.alias("stop"))


@query("""WITH t AS (SELECT p_brand, row_number() OVER w AS k, sum(p_size) OVER (w ROWS UNBOUNDED PRECEDING) AS head, sum(p_size) OVER (PARTITION BY p_brand) AS whole FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
    SELECT p_brand, CAST(arg_min(k, ROW(greatest(head, whole - head), -k)) AS INTEGER) AS cut, CAST(min(greatest(head, whole - head)) AS BIGINT) AS larger FROM t GROUP BY 1""")
def best_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of equal cuts."""
    return windows.best_split(read(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_size")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS k FROM orders), r AS (SELECT *, max(CASE WHEN k = 10 THEN o_custkey END) OVER (PARTITION BY o_orderpriority) AS reach FROM t)
    SELECT o_orderpriority, o_orderkey FROM r WHERE k <= 10 OR o_custkey = reach""")
def first_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows, and the rest of the block of the last one."""
    return windows.first_batch(read(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_custkey", "o_orderkey"], "o_custkey", 10).select("o_orderpriority", "o_orderkey")


@query("SELECT event_id, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM events".replace("epoch(date_trunc('second', ts))", "CAST(floor(epoch(ts)) AS BIGINT)"))
def recent_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a sliding hour."""
    return read(spark, sf_dir, "events").select("event_id", windows.rate(["user_id"], "ts", 3600, F.round(F.col("value") * 100).cast("long")).alias("recent"))


_VOTES = """
    v AS (SELECT conv_id % 50 AS subject, conv_id % 2 AS version, role || conv_id % 3 AS actor, CASE length(text) % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'abstain' ELSE 'accept' END AS answer, turn AS happened, conv_id * 100 + turn AS pos FROM conversations),
    c AS (SELECT DISTINCT subject, 0 AS version, CAST(subject % 3 AS INTEGER) AS kind FROM v), m AS (SELECT DISTINCT actor FROM v WHERE actor <> 'user2'),
    a AS (SELECT v.subject, v.actor, arg_max(answer, ROW(happened, pos)) AS answer FROM v JOIN c USING (subject, version) WHERE actor IN (SELECT actor FROM m) GROUP BY 1, 2),
    t AS (SELECT c.subject, c.kind, coalesce(count_if(answer = 'accept'), 0) AS accept, coalesce(count_if(answer = 'reject'), 0) AS reject, coalesce(count_if(answer = 'abstain'), 0) AS abstain, (SELECT count(*) FROM m) - count(answer) AS outstanding FROM c LEFT JOIN a ON a.subject = c.subject GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN accept + reject + outstanding = 0 THEN 'undecided' WHEN accept >= ceil(2 * (accept + reject + outstanding) / 3) THEN 'accepted' WHEN accept + outstanding < ceil(2 * (accept + reject + outstanding) / 3) THEN 'rejected' ELSE 'open' END AS standing FROM t)
"""


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.length("text") % 5 == 0, "reject").when(F.length("text") % 5 == 1, "abstain").otherwise("accept")
    v = read(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("subject"), (F.col("conv_id") % 2).alias("version"), F.concat("role", (F.col("conv_id") % 3).cast("string")).alias("actor"), answer.alias("answer"), F.col("turn").alias("at"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"))
    changes = v.select("subject").distinct().select("subject", F.lit(0).cast("long").alias("version"), (F.col("subject") % 3).cast("int").alias("kind"))
    return review.tally(changes, v.select("actor").distinct().where("actor <> 'user2'"), v)


@query(f"WITH {_VOTES} SELECT subject, CAST(accept AS BIGINT) AS accept, CAST(reject AS BIGINT) AS reject, CAST(abstain AS BIGINT) AS abstain, CAST(outstanding AS BIGINT) AS outstanding, standing FROM s")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voter's latest answer to the current version counts."""
    return _tally(spark, sf_dir).select("subject", "accept", "reject", "abstain", "outstanding", "standing")


@query(f"WITH {_VOTES} SELECT kind, CAST(count_if(standing = 'accepted') AS BIGINT) AS accepted, CAST(count_if(standing = 'rejected') AS BIGINT) AS rejected, CAST(count_if(standing = 'open') AS BIGINT) AS open, CAST(count_if(standing = 'undecided') AS BIGINT) AS undecided FROM s GROUP BY kind")
def standing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A37."""
    return review.matrix(_tally(spark, sf_dir), "kind")


@query("""WITH d AS (SELECT count(*) AS n, count(DISTINCT text) AS u, avg(n_chars) AS c FROM documents)
    SELECT 'repeats' AS check_name, CAST(n - u AS DOUBLE) AS value, 3.0::DOUBLE AS limit_value, n - u > 3 AS beyond FROM d UNION ALL SELECT 'mean length', round(c, 3), 1000.0::DOUBLE, c > 1000 FROM d
    UNION ALL SELECT 'no language', (SELECT avg(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) FROM documents), 0.3::DOUBLE, false FROM d""")
def batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    measures = {"repeats": (F.count("*") - F.count_distinct("text"), 3), "mean length": (F.round(F.avg("n_chars"), 3), 1000), "no language": (F.avg(F.when(F.col("lang").isNull(), 1).otherwise(0)), 0.3)}
    return quality.checks(read(spark, sf_dir, "documents"), measures)


@query("""SELECT p_partkey, array_to_string(f, ',') AS failures FROM (SELECT p_partkey, list_filter([CASE WHEN p_size > 45 THEN 'size' END, CASE WHEN p_brand LIKE '%3' THEN 'brand' END, CASE WHEN length(p_name) > 30 THEN 'name' END], lambda x: x IS NOT NULL) AS f FROM part) WHERE len(f) > 0""")
def row_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a row breaks."""
    rules = {"size": F.col("p_size") > 45, "brand": F.col("p_brand").endswith("3"), "name": F.length("p_name") > 30}
    return quality.failures(read(spark, sf_dir, "part"), rules).select("p_partkey", F.array_join("failures", ",").alias("failures"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'fixed' ELSE s_name END AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier""")
def corrected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections that match the value as it is; a correction of another value changes nothing."""
    df = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    good = df.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit("s_name").alias("name"), F.col("s_name").alias("old"), F.lit("fixed").alias("new"))
    bad = df.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("s_nationkey").alias("name"), F.lit("none").alias("old"), F.lit("0").alias("new"))
    return quality.apply_corrections(df, "s_suppkey", ["s_name", "s_nationkey"], good.unionByName(bad))


@query("SELECT s_suppkey, left(md5(length(CAST(s_suppkey AS VARCHAR)) || ':' || s_suppkey || length(s_name) || ':' || s_name || length(CAST(s_nationkey AS VARCHAR)) || ':' || s_nationkey), 8) AS fingerprint FROM supplier")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X42."""
    from curalake.functions.text import fingerprint

    return read(spark, sf_dir, "supplier").select("s_suppkey", fingerprint(F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")).alias("fingerprint"))
