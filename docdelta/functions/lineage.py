"""Cutting lineage in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def temporary_folder(spark: SparkSession, prefix: str) -> str:
    """A folder of this machine, for local sessions that set no spark.checkpoint.dir; executors elsewhere could not see it."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=prefix)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared checkpoint folder, or in a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or temporary_folder(spark, "docdelta-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as a table and read again: what several branches of a plan read is not derived in each of them."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the folder in spark.checkpoint.dir; only where that is unset to a temporary one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or temporary_folder(spark, "spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
