"""Distributed ordinals and global ranks without an un-partitioned window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.plans.hot import join_by_key
from docketry.session import checkpoint_dir


def pinned(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: later reads see one fixed result, also after
    an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def with_ordinal(df: DataFrame, order: Sequence[Column], name: str = "ordinal",
                 partitions: int | None = None) -> DataFrame:
    """Dense 0-based position of every row in ``order``.

    Rows are range-partitioned by the order, numbered inside their partition, and
    shifted by the number of rows in earlier partitions. Only one small row per
    partition takes part in the offset step, so no task sees the whole table. End
    ``order`` with a unique column: range bounds then also split a hot first key.

    Range bounds come from a sample, so the numbered rows are checkpointed before
    they are read a second time for the offsets.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One exchange: a sorted partition's row ids are its number (high bits) and 0, 1, 2 ...
    sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = pinned(sorted_rows.withColumn("__row", F.monotonically_increasing_id())).withColumn(
        "__part", F.shiftright("__row", 33)).withColumn("__local", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__row")
    sizes = numbered.groupBy("__part").agg(F.max("__local").alias("__n"))
    # One row per range partition reaches this window.
    offsets = sizes.select(
        "__part",
        (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"),
    )
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__local") + F.col("__before") - 1).cast("bigint"))
        .drop("__part", "__local", "__before")
    )


def ranked_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position inside each key group, for groups of any size.

    A window would put a whole group in one task; here a hot group spans several range
    partitions and its rank is the global position minus that of its first row.
    """
    numbered = with_ordinal(df, [*[F.col(k) for k in keys], *order], "__at")
    first = numbered.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    return (
        join_by_key(numbered, first, keys, "__rows")
        .withColumn(name, F.col("__at") - F.col("__first") + 1)
        .select(*df.columns, name)
    )
