"""Stores of keyed state over the replayed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.plans.registry import query, read
from curalake.sources.shared import shared_folder
from curalake.streaming import events as streaming
from curalake.streaming import sessions

_TTL = 12 * 3600 * 1000


def _by_time(df: DataFrame, folder: str, parts: int = 4) -> None:
    """The events in files by their time; the name of a file tells its place."""
    bounds = df.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.percentile_approx("t", [k / parts for k in range(1, parts)]).alias("b")).first()["b"] or []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.unix_micros(F.col("ts").cast("timestamp")))) + 1 if bounds else F.lit(1)
    df = df.withColumn("_part", place)
    for k in range(1, parts + 1):
        df.where(F.col("_part") == k).drop("_part").repartition(2).write.mode("append").parquet(f"{folder}/in")


@query(f"""WITH RECURSIVE w AS (
        SELECT CAST(user_id AS VARCHAR) AS key, event_id AS pos, epoch_us(ts) // 1000 AS at_ms, CAST(floor(value) AS BIGINT) % 3 AS base, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events
    ), f AS (
        SELECT key, 0::BIGINT AS n, NULL::BIGINT AS pos, NULL::BIGINT AS at_ms, NULL::VARCHAR AS answer, NULL::BIGINT AS revision, NULL::BIGINT AS saved, NULL::BIGINT AS past_revision, NULL::BIGINT AS past_at FROM (SELECT DISTINCT key FROM w)
        UNION ALL
        SELECT key, n, pos, at_ms, answer, CASE WHEN answer = 'conflict' THEN held ELSE base + 1 END, CASE WHEN answer = 'conflict' THEN saved ELSE at_ms END, CASE WHEN ended THEN had END, CASE WHEN ended THEN saved + {_TTL} END
        FROM (SELECT *, CASE WHEN held IS NULL THEN CASE WHEN base = 0 THEN 'saved' ELSE 'revived' END WHEN held = base THEN 'saved' ELSE 'conflict' END AS answer
            FROM (SELECT w.key, w.n, w.pos, w.at_ms, w.base, f.saved, f.revision AS had, f.saved + {_TTL} <= w.at_ms AS ended, CASE WHEN f.saved + {_TTL} > w.at_ms THEN f.revision END AS held FROM f JOIN w ON w.key = f.key AND w.n = f.n + 1))
    ), l AS (SELECT key, max(n) AS n FROM w GROUP BY key)
    SELECT key, pos, at_ms AS at, answer, revision FROM f WHERE n > 0
    UNION ALL SELECT key, NULL, past_at, 'swept', past_revision FROM f WHERE past_at IS NOT NULL
    UNION ALL SELECT f.key, NULL, f.saved + {_TTL}, 'swept', f.revision FROM f JOIN l ON f.key = l.key AND f.n = l.n WHERE f.saved + {_TTL} <= (SELECT max(epoch_us(ts) // 1000) FROM events)""")
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of all users replayed; a write from a stale revision is a conflict, a session that is over is swept."""
    df, folder = read(spark, sf_dir, "events"), shared_folder(spark, "sessions")
    _by_time(df, folder)
    stream = streaming.replay(spark, f"{folder}/in", df.schema, 2).withColumn("base", F.floor("value").cast("long") % 3)
    with sessions.state_in_rocksdb(spark):
        return streaming.run_to_end(sessions.stored_sessions(stream, "user_id", "ts", "event_id", "base", _TTL, "0 seconds"), folder)


@query("""WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 3 HOUR, false) AS apart FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, count_if(apart) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, trim(arg_max(' ' || event_type || ' ' || event_id || ' ', ROW(ts, event_id))) AS value, count(*) AS n FROM b GROUP BY user_id, burst HAVING max(ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def settled_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each burst of a user that is over, bursts three hours apart."""
    df, folder = read(spark, sf_dir, "events"), shared_folder(spark, "bursts")
    _by_time(df, folder)
    stream = streaming.replay(spark, f"{folder}/in", df.schema, 2).withColumn("draft", F.concat(F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
    return streaming.run_to_end(sessions.settled_inputs(stream, "user_id", "ts", "event_id", "draft", "3 hours", "1 hour"), folder)
