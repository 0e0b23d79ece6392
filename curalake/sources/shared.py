"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir; a folder of this machine only where Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_folder, "own", None)
        if base is None:
            base = shared_folder.own = tempfile.mkdtemp(prefix="curalake-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has, or as the cluster has cores: for rows of few bytes that cost much, whose files would make few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and its lineage ends there."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
