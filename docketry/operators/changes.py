"""Change application: upsert, partial update and delete logs; overrides; appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.plans.ordinal import ranked_within


def apply_changes(target: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Replay a log onto a table.

    ``changes`` holds ``key, seq, op`` and ``columns``; ``op`` is ``U`` (insert or replace
    all columns), ``P`` (set the given columns; ignored when the row does not exist) or
    ``D``. The outcome per column is the last row that either replaced the record or set
    that column, found by one partially combined aggregate: a key holding a third of the
    log is reduced in every task before it is shuffled.
    """
    base = target.select(key, F.lit(-1).cast("bigint").alias("seq"), F.lit("U").alias("op"), *columns)
    log = base.unionByName(changes.select(key, F.col("seq").cast("bigint").alias("seq"), "op", *columns))
    reset = F.col("op").isin("U", "D")

    def last(c: str) -> Column:
        counts = reset | F.col(c).isNotNull()
        return F.max_by(F.struct(F.col(c).alias("v")), F.when(counts, at))["v"].alias(c)

    # Rows of one key and seq are ordered by op, then by a hash of their columns.
    at = F.struct("seq", "op", F.xxhash64(*columns))
    state = log.groupBy(key).agg(
        F.max_by("op", F.when(reset, at)).alias("__state"), *[last(c) for c in columns]
    )
    return state.filter(F.col("__state") == "U").drop("__state")


def upsert(target: DataFrame, rows: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    return apply_changes(target, rows.withColumn("op", F.lit("U")), columns, key)


def patch(target: DataFrame, rows: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    return apply_changes(target, rows.withColumn("op", F.lit("P")), columns, key)


def delete(target: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti")


def append_events(log: DataFrame, events: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Add activity rows; a missing kind is a view. Titles are whole unless ``title_chars`` is given."""
    title = F.coalesce("title", F.lit(""))
    cut = events.withColumn("title", title if title_chars is None else F.substring(title, 1, title_chars)).withColumn(
        "type", F.coalesce(F.nullif("type", F.lit("")), F.lit("view"))
    )
    return log.unionByName(cut.select(log.columns))


def latest_overrides(overrides: DataFrame) -> DataFrame:
    return overrides.groupBy("case_id").agg(
        F.max_by(F.struct("override_band", "override_score"), F.struct("created_at", "id")).alias("o")
    ).select("case_id", "o.override_band", "o.override_score")


def apply_overrides(cases: DataFrame, overrides: DataFrame) -> DataFrame:
    """Managed cases with their latest band and score override."""
    last = latest_overrides(overrides)
    return cases.join(last, cases["id"] == last["case_id"], "left").select(
        *[cases[c] for c in cases.columns if c not in ("priority_band", "priority_score")],
        F.coalesce("override_band", "priority_band").alias("priority_band"),
        F.coalesce("override_score", "priority_score").alias("priority_score"),
    )


def override_history(overrides: DataFrame) -> DataFrame:
    """Overrides with their place, newest first, inside each case."""
    return ranked_within(
        overrides, ["case_id"], [F.desc("created_at"), F.desc("id")], "newest_first"
    )

