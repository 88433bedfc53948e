"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "/tmp/navspark-checkpoints").rstrip("/")


def saved(df: DataFrame, label: str = "graph") -> DataFrame:
    """The rows from a table in the shared folder, which ends the lineage of a loop."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
