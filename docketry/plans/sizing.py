"""Size guards for everything that is broadcast or shipped to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Rows of a small side (rules, roster, queries) that may be replicated to every task.
SMALL_ROWS = 20_000


def fits(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """True when ``df`` has at most ``limit`` rows. Reads at most ``limit + 1`` rows."""
    return df.limit(limit + 1).count() <= limit


def spread(df: DataFrame) -> DataFrame:
    """Give a costly narrow job enough tasks when its input has few splits.

    Large tables already have more splits than cores and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
