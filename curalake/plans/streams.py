"""Streams replayed to their end; the rows must be those of a batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.plans.registry import query, read
from curalake.sources import files
from curalake.sources.shared import shared_folder
from curalake.streaming import events as streaming


def _split(spark: SparkSession, sf_dir: str, tag: str) -> tuple[DataFrame, str]:
    """The events in files, the last of which bring a third of the events again."""
    df, folder = read(spark, sf_dir, "events"), shared_folder(spark, tag)
    again = df.where("event_id % 3 = 0")
    for part in (df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1"), again):
        part.repartition(2).write.mode("append").parquet(f"{folder}/in")
    return df, folder


@query("SELECT event_id, user_id, event_type FROM events")
def incremental_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping batches give each event once."""
    df, folder = _split(spark, sf_dir, "discover")
    found = streaming.discover(streaming.replay(spark, f"{folder}/in", df.schema), "event_id", "ts", "3650 days")
    return streaming.run_to_end(found.select("event_id", "user_id", "event_type"), folder)


@query("""SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS event_type, CAST(max(epoch_us(ts)) AS BIGINT) AS at FROM events GROUP BY 1""")
def latest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, folded batch by batch."""
    df, folder = _split(spark, sf_dir, "fold")
    stream = streaming.replay(spark, f"{folder}/in", df.schema)
    step = streaming.fold(stream, ["user_id"], "ts", "event_id", "event_type", folder)
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    out = spark.read.parquet(f"{folder}/generation-{last:06d}")
    return out.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("""WITH e AS (SELECT event_id, user_id, ts, value > 60 AS ok FROM events), x AS (SELECT *, coalesce(count_if(ok) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM e)
    SELECT event_id, CAST(count_if(NOT ok) OVER (PARTITION BY user_id, ep ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures,
    count_if(NOT ok) OVER (PARTITION BY user_id, ep ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 864000 PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM x""")
def attempt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures since the last success in the last ten days."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") > 60).alias("ok"))
    return streaming.reserve(df, "user_id", "ts", 864000, 2).select("event_id", "failures", "allowed")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: tumbling days over the replayed stream, in complete mode."""
    df, folder = read(spark, sf_dir, "events"), shared_folder(spark, "windows")
    df.repartition(2).write.parquet(f"{folder}/in")
    out = streaming.windowed(streaming.replay(spark, f"{folder}/in", df.schema), "ts", ["event_type"], "1 day", "1 day", "3650 days", "value")
    return streaming.run_complete(out.select("window.start", "event_type", "n"), folder).select(F.to_date("start").alias("day"), "event_type", "n")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def published_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: tables published together and read through the pointer."""
    folder = shared_folder(spark, "publish")
    files.publish({"nation": read(spark, sf_dir, "nation"), "region": read(spark, sf_dir, "region")}, folder)
    return files.published(spark, folder, "nation")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 12")
def resumed_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended records of the right fingerprint; records of another one are not read."""
    folder = shared_folder(spark, "resume")
    df = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    files.append_checkpoint(df.where("s_nationkey < 6").drop("s_nationkey"), folder, "a")
    files.append_checkpoint(df.where("s_nationkey between 6 and 11").drop("s_nationkey"), folder, "a")
    files.append_checkpoint(df.where("s_nationkey > 11").drop("s_nationkey"), folder, "b")
    return files.read_checkpoint(spark, folder, df.drop("s_nationkey").schema, "a")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 > 0")
def pruned_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint without the rows of some keys."""
    folder, df = shared_folder(spark, "prune"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files.append_checkpoint(df, f"{folder}/a", "x")
    files.prune_checkpoint(spark, f"{folder}/a", df.schema, "x", df.where("s_suppkey % 5 = 0"), "s_suppkey", f"{folder}/b")
    return files.read_checkpoint(spark, f"{folder}/b", df.schema, "x")


@query("SELECT c_custkey, trim(regexp_replace(replace(' ' || c_name || chr(160) || ' x', chr(160), ' '), '[ \\t]+', ' ', 'g')) AS name, c_nationkey AS n FROM customer")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with a header written and read again, no-break spaces folded, numbers typed."""
    folder = shared_folder(spark, "csv")
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit("\u00a0 x")).alias("name"), F.col("c_nationkey").alias("n"))
    files.write_csv(df, folder)
    return files.read_csv(spark, folder, df.schema)


@query("SELECT n_nationkey, n_name || '</b>' AS name, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS region FROM nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON with nulls and escaped slashes, read with a declared schema."""
    folder = shared_folder(spark, "json")
    df = read(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("</b>")).alias("name"), F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")).alias("region"))
    files.write_rows(df, folder)
    return spark.read.schema(df.schema).option("mode", "FAILFAST").json(folder)


@query("SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS id FROM supplier")
def checked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids in which every one has the shape; one that doesn't would fail the job."""
    return files.checked(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("id")), "id", "^[0-9]+$")


@query("SELECT chrom, count(*) AS bands, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM (SELECT 'chr' || p_size % 5 AS chrom, p_partkey AS lo, p_partkey + p_size AS hi FROM part) GROUP BY 1")
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with tabs, grouped by its chromosome."""
    folder = shared_folder(spark, "bands")
    df = read(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string")).alias("chrom"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    df.write.option("header", True).option("sep", "\t").csv(folder)
    return files.read_csv(spark, folder, df.schema, "\t").groupBy("chrom").agg(F.count("*").alias("bands"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("SELECT event_id, event_type, value FROM events")
def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of an event log and of files as one, each once."""
    folder, df = shared_folder(spark, "reports"), read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    files.append_event(df.where("event_id % 2 = 0"), f"{folder}/log", "report")
    files.append_event(df.where("event_id % 4 = 1"), f"{folder}/log", "other")
    files.write_rows(df.where("event_id % 2 = 1 or event_id % 6 = 0"), f"{folder}/files")
    log = spark.read.parquet(f"{folder}/log").where("kind = 'report'").select(F.from_json("payload", df.schema).alias("r")).select("r.*")
    return log.unionByName(spark.read.schema(df.schema).json(f"{folder}/files")).dropDuplicates(["event_id"])


@query("SELECT 'one' AS file, '{\"rows\":' || count(*) || ',\"best\":' || max(s_suppkey) || '}' AS value FROM supplier UNION ALL SELECT 'none', 'null'")
def single_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row as an object, and null where there is none."""
    folder, s = shared_folder(spark, "value"), read(spark, sf_dir, "supplier")
    one = s.agg(F.count("*").alias("rows"), F.max("s_suppkey").alias("best"))
    files.write_value(one, f"{folder}/one")
    files.write_value(one.where("rows < 0"), f"{folder}/none")
    return spark.read.text(f"{folder}/one").select(F.lit("one").alias("file"), "value").unionByName(spark.read.text(f"{folder}/none").select(F.lit("none").alias("file"), "value"))


@query("SELECT name, CAST(ord AS INTEGER) AS ord, n FROM (SELECT 'supplier' AS name, 0 AS ord, count(*) AS n FROM supplier UNION ALL SELECT 'nation', 1, count(*) FROM nation UNION ALL SELECT 'region', 2, count(*) FROM region UNION ALL SELECT 'preview', 3, 0)")
def full_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5-K7: all tables of an export in their order, an empty one among them, published together."""
    folder, names = shared_folder(spark, "export"), ["supplier", "nation", "region"]
    frames = {n: read(spark, sf_dir, n) for n in names} | {"preview": spark.createDataFrame([], "id long")}
    files.publish(frames, folder)
    out = None
    for k, n in enumerate(frames):
        part = files.published(spark, folder, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.lit(k).alias("ord"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT user_id AS id, arg_max(event_type, ROW(ts, event_type)) AS type FROM (SELECT user_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN 'forgotten' ELSE 'saved' END AS kind FROM events) GROUP BY 1 HAVING arg_max(kind, ROW(ts, kind)) = 'saved' AND max(ts) >= TIMESTAMP '2024-01-20'")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved state that is neither forgotten nor expired."""
    df = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "forgotten").otherwise("saved").alias("kind"), "event_type")
    live = files.pending(df, F.lit("2024-01-30 00:00:00").cast("timestamp"), 864_000).select("id")
    return df.groupBy("id").agg(F.max_by("event_type", F.struct("at", "event_type")).alias("type")).join(live, "id", "left_semi")
