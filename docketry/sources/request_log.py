"""Request and activity logs as JSON lines, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas as S


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r")).filter(F.col("r.ts").isNotNull()).select("r.*")


def read_request_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``ts, request_id, method, path, status, duration_ms, client``; lines that are not
    records are dropped."""
    lines = spark.readStream.text(path) if stream else spark.read.text(path)
    return _parsed(lines, S.REQUEST_LOG).toDF(
        "ts", "request_id", "method", "path", "status", "duration_ms", "client"
    )


def read_activity(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    lines = spark.readStream.text(path) if stream else spark.read.text(path)
    return _parsed(lines, S.ACTIVITY)
