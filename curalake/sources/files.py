"""Readers and writers of curated files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curalake.functions.text import clean_text


def read_csv(spark: SparkSession, path: str, schema: StructType, separator: str = ",") -> DataFrame:
    """A CSV file with a header; a byte order mark is dropped, no-break spaces and runs of blanks are folded."""
    df = spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    return df.select(*(clean_text(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in schema))


def checked(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Fails on the first value that doesn't have the shape."""
    bad = F.raise_error(F.concat(F.lit(f"{column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return df.withColumn(column, F.when(F.col(column).rlike(pattern), F.col(column)).otherwise(bad))


def read_json_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An array of objects with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def append_checkpoint(df: DataFrame, path: str, fingerprint: str) -> None:
    """Rows as lines of JSON in a batch of their own, then its header with a fingerprint; earlier batches aren't touched.

    A batch counts from its header on, so one that was cut off isn't read.
    """
    batch = uuid.uuid4().hex
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/rows/batch={batch}")
    df.sparkSession.createDataFrame([(batch, fingerprint)], "batch string, fingerprint string").write.mode("append").json(f"{path}/headers")


def read_checkpoint(spark: SparkSession, path: str, schema: StructType, fingerprint: str) -> DataFrame:
    """Rows of the batches whose header has the fingerprint; a torn line is dropped."""
    good = spark.read.schema("batch string, fingerprint string").json(f"{path}/headers").where(F.col("fingerprint") == fingerprint).select("batch").distinct()
    lines = spark.read.schema("value string, batch string").text(f"{path}/rows").join(F.broadcast(good), "batch", "left_semi")  # a row for each batch
    return lines.where(F.expr("try_parse_json(value) is not null")).select(F.from_json("value", schema).alias("r")).select("r.*")


def prune_checkpoint(spark: SparkSession, path: str, schema: StructType, fingerprint: str, keys: DataFrame, key: str, to: str) -> None:
    """The rows of a checkpoint without those of some keys, as a checkpoint at another path."""
    append_checkpoint(read_checkpoint(spark, path, schema, fingerprint).join(keys.select(key), key, "left_anti").select(*schema.names), to, fingerprint)


def append_event(df: DataFrame, path: str, kind: str) -> None:
    """Rows as events of a kind behind those that are there."""
    df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("payload")).write.mode("append").parquet(path)


def write_value(df: DataFrame, path: str) -> None:
    """K2, K8: the one row of df as an object, or null if there is none; more than one fails."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a single value is written, but there are more")
    df.sparkSession.createDataFrame([(rows[0].value if rows else "null",)], "value string").write.mode("overwrite").text(path)


def pending(state: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Saved rows (id, at, kind: saved or forgotten) that are the last of their id, young enough, and not forgotten."""
    last = state.groupBy("id").agg(F.max_by(F.struct("at", "kind"), F.struct("at", "kind")).alias("_l")).select("id", "_l.*")
    return last.where((F.col("kind") == "saved") & (F.col("at") >= now - F.make_dt_interval(secs=F.lit(seconds))))


def write_rows(df: DataFrame, path: str) -> None:
    """K1, K3: a row of JSON in each line, nulls written, `</` escaped."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(F.replace(text, F.lit("</"), F.lit("<\\/")).alias("value")).write.mode("overwrite").text(path)


def publish(frames: dict[str, DataFrame], folder: str) -> str:
    """K4, K5: all tables of a generation, then a pointer to it; readers of the pointer never see part of one."""
    generation = uuid.uuid4().hex
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{generation}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(generation, list(frames))], "generation string, tables array<string>").write.mode("overwrite").json(f"{folder}/current")
    return generation


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    generation = spark.read.schema("generation string").json(f"{folder}/current").first()[0]
    return spark.read.parquet(f"{folder}/{generation}/{name}")


def write_empty(spark: SparkSession, schemas: dict[str, StructType], folder: str) -> str:
    """K7: a generation of tables without rows."""
    return publish({name: spark.createDataFrame([], schema) for name, schema in schemas.items()}, folder)


def write_csv(df: DataFrame, path: str) -> None:
    """K9: a CSV with a header and empty cells for nulls."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
