"""Incremental forms over event streams, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replay(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def discover(stream: DataFrame, key: str, ts: str, look_back: str) -> DataFrame:
    """Each key once, however often overlapping windows bring it; state is dropped behind the look-back.

    The watermark is on the time of entry, so a record that is dated early but enters late isn't lost.
    """
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, look_back).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, ts: str, keys: list[str], width: str, slide: str, delay: str, amount: str) -> DataFrame:
    """T5: counts and amounts in sliding windows."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))


def fold(stream: DataFrame, keys: list[str], at: str, pos: str, value: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest value of each key as generations of a table below `checkpoint`.

    A batch is folded into the generation of the batch before it, so a batch that runs again writes the same rows.
    """
    columns = [*keys, at, pos, value]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns)
        if number > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{checkpoint}/generation-{number - 1:06d}"))
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(at, pos, value), F.struct(at, pos)).alias("_e")).select(*keys, "_e.*")
        last.write.mode("overwrite").parquet(f"{checkpoint}/generation-{number:06d}")

    return run


def run_complete(df: DataFrame, path: str) -> DataFrame:
    """The whole result of an aggregated stream as a table below path: each batch writes a generation, the last one counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out-{number:06d}")

    q = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out-{q.lastProgress['batchId']:06d}")


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Processes all that is there and returns it as a table below path."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def reserve(attempts: DataFrame, client: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Which attempts are within the limit of their client in the time before them; a success clears earlier failures.

    attempts: client, ts, ok. Failures since the last success, inside the window, count.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(client).orderBy(ts)
    epoch = F.count_if("ok").over(by.rowsBetween(Window.unboundedPreceding, -1))
    second = F.unix_timestamp(ts)
    held = attempts.withColumn("_epoch", F.coalesce(epoch, F.lit(0))).withColumn("_s", second)
    w = Window.partitionBy(client, "_epoch").orderBy("_s").rangeBetween(-seconds, 0)
    return held.withColumn("failures", F.count_if(~F.col("ok")).over(w)).withColumn("allowed", F.col("failures") <= limit).drop("_epoch", "_s")
