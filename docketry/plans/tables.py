"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketry.session import checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    base = spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where one costly result feeds several branches. Unlike a cached frame the
    table survives lost executors, and each reader still gets column pruning.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
