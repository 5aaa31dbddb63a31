"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, or under a folder of our own where a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"/tmp/checkpoints/veilframe-{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a scratch path and read again: computed once, no lineage."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small input lies in a few files that a few tasks would read: deal its rows over all cores. An input that fills the cores by itself comes back as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    share = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size_of(df) < cores * share else df


def size_of(df: DataFrame) -> int:
    """Bytes as Spark estimates them: of a written table those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
