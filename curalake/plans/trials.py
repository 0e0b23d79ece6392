"""The sync of trials over studies made of orders and their lines."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.functions import wording as W
from curalake.functions.sentinel import strip
from curalake.operators import trials
from curalake.plans.registry import query, read, typed

_PHASES = {"PHASE1": "I", "PHASE2": "II", "PHASE3": "III"}
_STATUS = "CASE o_custkey % 4 WHEN 0 THEN ' recruiting ' WHEN 1 THEN 'Completed' WHEN 2 THEN '' END"
_TERMS = ("o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'", "o_custkey % 2 = 0")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Studies by term, with their interventions nested; a table of trials; statuses."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct(
            F.expr("CASE l_returnflag WHEN 'R' THEN 'Drug' WHEN 'N' THEN 'BIOLOGICAL' ELSE 'DEVICE' END").alias("kind"),
            F.expr("CASE WHEN l_linenumber = 3 THEN 'Placebo ' ELSE ' Agent-' END || l_partkey % 50").alias("name"),
            F.expr("CASE WHEN l_linenumber = 4 THEN array('sham') END").alias("other_names"),
        ).alias("i"),
    )
    orders = read(spark, sf_dir, "orders").join(lines.groupBy("o_orderkey").agg(F.collect_list("i").alias("interventions")), "o_orderkey", "left")
    orders = orders.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    rid = "'NCT' || lpad(CAST(o_orderkey AS STRING), 8, '0')"
    studies = orders.select(
        F.expr(f"CASE WHEN o_orderkey % 97 > 0 THEN ' ' || {rid} ELSE ' ' END").alias("registry_id"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderpriority").alias("title"),
        F.expr("CASE WHEN o_orderkey % 11 > 0 THEN array(c_mktsegment, 'other') ELSE array() END").alias("conditions"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Interventional' WHEN 'P' THEN 'OBSERVATIONAL' END").alias("study_type"),
        F.expr("CASE o_custkey % 3 WHEN 0 THEN array('PHASE1', 'PHASE2') WHEN 1 THEN array('NA') END").alias("phases"),
        F.floor(F.col("o_totalprice") / 1000).alias("enrollment"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("completion_date"),
        F.array(F.lit(" "), F.lit(None).cast("string"), "o_orderpriority").alias("outcomes"),
        F.lower("o_orderstatus").alias("sponsor_class"),
        F.expr(_STATUS).alias("status"),
        "interventions",
        *(F.expr(t).alias(f"t{k}") for k, t in enumerate(_TERMS)),
    )
    flags = [f"t{k}" for k in range(len(_TERMS))]
    found = [studies.where(f"t{k}").withColumn("title", F.concat("title", F.lit(f" by {k} "))).drop(*flags) for k in range(len(_TERMS))]
    text = {c: F.lit(None).cast("string").alias(c) for c in ("completion", "primary_outcome", "sponsor_type")}
    held = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    table = held.select(
        F.expr(rid).alias("registry_id"), F.explode(F.array(F.expr("'Agent-' || o_custkey % 50"), F.lit("old name"))).alias("drug"), F.lit("old").alias("trial_name"), F.lit("IV").alias("phase"),
        F.lit(7).cast("long").alias("sample_size"), *text.values(), F.lit("COMPLETED").alias("overall_status"), F.col("o_orderpriority").alias("population"),
    )
    statuses = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.expr(rid).alias("registry_id"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'terminated' WHEN o_orderkey % 4 = 1 THEN 'completed' END").alias("status"))
    return found, table, statuses


def _synced(spark: SparkSession, sf_dir: str) -> trials.TrialSync:
    found, table, statuses = _inputs(spark, sf_dir)
    phase, sponsor = partial(W.phase_label, names=_PHASES), partial(W.sponsor_class, folds={"F": "Industry", "O": "NIH"}, other="Other")
    return trials.sync_trials(found, table, statuses, ["household"], [("auto", "mobile")], ["DRUG", "BIOLOGICAL"], strip, phase, sponsor)


_SYNC = """
    WITH o AS (SELECT *, 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS rid FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
    f AS (SELECT *, 0 AS term FROM o WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT *, 1 FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT *, 2 FROM o WHERE o_custkey % 2 = 0),
    u AS (SELECT * FROM f WHERE o_orderkey % 97 > 0 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY term, o_orderkey) = 1),
    k AS (SELECT * FROM u WHERE o_orderkey % 11 = 0 OR c_mktsegment = 'HOUSEHOLD' OR (lower(c_mktsegment) LIKE '%auto%' AND lower(c_mktsegment) LIKE '%mobile%')),
    a AS (SELECT DISTINCT l_orderkey AS o_orderkey, 'Agent-' || l_partkey % 50 AS drug FROM lineitem WHERE l_returnflag IN ('R', 'N') AND l_linenumber NOT IN (3, 4)),
    r AS (SELECT rid AS registry_id, drug, o_orderpriority || ' by ' || term AS trial_name, CASE o_custkey % 3 WHEN 0 THEN 'I/II' END AS phase, CAST(floor(o_totalprice / 1000) AS BIGINT) AS sample_size, month(o_orderdate) || '/' || year(o_orderdate) AS completion,
        o_orderpriority AS primary_outcome, CASE o_orderstatus WHEN 'F' THEN 'Industry' WHEN 'O' THEN 'NIH' ELSE 'Other' END AS sponsor_type, CASE o_custkey % 4 WHEN 0 THEN 'RECRUITING' WHEN 1 THEN 'COMPLETED' END AS overall_status
        FROM k JOIN a USING (o_orderkey) WHERE o_orderstatus <> 'P'),
    s AS (SELECT DISTINCT ON (registry_id) registry_id, trial_name, phase, sample_size, completion, primary_outcome, sponsor_type, overall_status FROM r),
    t AS (SELECT rid AS registry_id, unnest(['Agent-' || o_custkey % 50, 'old name']) AS drug, o_orderpriority AS population FROM o WHERE o_orderkey % 5 = 0),
    m AS (SELECT t.registry_id, t.drug, coalesce(s.trial_name, 'old') AS trial_name, coalesce(s.phase, 'IV') AS phase, coalesce(s.sample_size, 7) AS sample_size, s.completion, s.primary_outcome, s.sponsor_type, coalesce(s.overall_status, 'COMPLETED') AS overall_status, population, CASE WHEN s.registry_id IS NULL THEN 'kept' ELSE 'refreshed' END AS change FROM t LEFT JOIN s USING (registry_id)
        UNION ALL SELECT *, NULL, 'discovered' FROM r WHERE registry_id NOT IN (SELECT registry_id FROM t)),
    n AS (SELECT rid AS registry_id, CASE WHEN o_orderkey % 2 = 0 THEN 'TERMINATED' WHEN o_orderkey % 4 = 1 THEN 'COMPLETED' END AS now FROM o WHERE o_orderkey % 3 = 0),
    z AS (SELECT m.*, now IS NOT NULL AND overall_status IS DISTINCT FROM now AS moved, coalesce(now, overall_status) AS status FROM m LEFT JOIN n USING (registry_id))
"""


@query(_SYNC + "SELECT registry_id, drug, trial_name, phase, sample_size, completion, primary_outcome, sponsor_type, status AS overall_status, population, change, moved FROM z")
def synced_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of three searches as rows of the table: refreshed, discovered or kept, statuses swept."""
    return _synced(spark, sf_dir).rows


@query(typed(_SYNC + """SELECT unnest(['found', 'without_id', 'unique', 'irrelevant', 'without_agent', 'refreshed', 'discovered', 'kept', 'status_moved']) AS metric,
    unnest([(SELECT count(*) FROM f), (SELECT count(*) FROM f WHERE o_orderkey % 97 = 0), (SELECT count(*) FROM u), (SELECT count(*) FROM u) - (SELECT count(*) FROM k), (SELECT count(*) FROM k) - (SELECT count(*) FROM s),
    (SELECT count(*) FROM z WHERE change = 'refreshed'), (SELECT count(*) FROM z WHERE change = 'discovered'), (SELECT count(*) FROM z WHERE change = 'kept'), (SELECT count(*) FROM z WHERE moved)]) AS n""", n="BIGINT"))
def trial_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the studies of a sync, as its own jobs counted it."""
    return spark.createDataFrame(sorted(_synced(spark, sf_dir).counts.items()), "metric string, n long")
